"""Nearest neighbours by inner product from an inverted multi-index.

Vectors are cut in two halves, and each half is quantised by its own list of centroids; a pair of centroids is a
cell, and every vector is entered in one. The distance of a query's half from a centroid is by how much the
centroid's inner product falls short of the best one. A query visits cells by the sum of both distances, with a heap that
holds the next cell of every row of the table of pairs, until the cells visited hold a given number of entries; these are
reranked by the inner product of the whole vectors.

That number is measured, not guessed: for a bounded sample of queries the true neighbours are found by going through all
vectors, and the number is the least with which the wanted share of them would have been visited.

Equal vectors are one entry with its smallest ids, as many as a result can hold. Neighbouring cells of a row make a block
of bounded size and a large cell makes several; a query goes once to each block that holds a cell it visits, and blocks with
many queries are dealt out again by query. Tasks return their best entries for a query, never all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.llm.embedding_dedup import _usable
from leadloom.operators.skew import skew_join
from leadloom.session import stage

K, RECALL = 20, 0.96
#: The index is fitted on this many rows at most, and on this many numbers in all; queries that measure the visits.
FIT_ROWS, FIT_VALUES, MEASURED = 20_000, 4_000_000, 256
#: Centroids of a half at most, entries per cell aimed at, rounds of fitting.
CENTROIDS, PER_CELL, ROUNDS = 512, 16, 10
#: Entries and queries of a block, about.
BLOCK, QUERIES = 4096, 2048
_KEY = ["dim", "block", "split", "part"]


def fit_centroids(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids of ``rows`` by repeated means, begun at evenly spread distinct rows."""
    points = np.unique(rows, axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        near = closest(rows, centroids)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        if rows.shape[1]:
            centroids[near[order][at]] = np.add.reduceat(rows[order], at, axis=0) / np.diff(np.append(at, len(rows)))[:, None]
    return centroids


def closest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's closest centroid by Euclidean distance."""
    return np.argmax(rows @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


class Codebook:
    """Centroids of both halves of the vectors of one length, and the number of entries of each cell."""

    def __init__(self, rows: np.ndarray, k: int):
        self.dim, self.half = rows.shape[1], rows.shape[1] // 2
        self.left, self.right = fit_centroids(rows[:, : self.half], k), fit_centroids(rows[:, self.half :], k)
        self.sizes = [0] * (len(self.left) * len(self.right))
        self.entries = 0  # that a query visits

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return closest(rows[:, : self.half], self.left) * len(self.right) + closest(rows[:, self.half :], self.right)

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each centroid's inner product with the query's half falls short of the best."""
        a, b = self.left @ query[: self.half], self.right @ query[self.half :]
        return a.max() - a, b.max() - b

    def visited(self, query: np.ndarray) -> list[int]:
        """Cells with entries by summed distance, until they hold ``entries``; the last may hold more."""
        a, b = self.distances(query)
        rows, columns = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, width, left = a[rows].tolist(), b[columns].tolist(), len(columns), self.entries
        heap = [(a[0] + b[0], 0, 0)]
        out: list[int] = []
        while heap and left > 0:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * width + columns[j]
            if self.sizes[cell]:
                out.append(cell)
                left -= self.sizes[cell]
            if j + 1 < width:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(rows):  # a row's first cell brings in the next row
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out

    def before(self, query: np.ndarray) -> np.ndarray:
        """By cell, the entries of all cells that are visited up to it."""
        a, b = self.distances(query)
        order = np.argsort((a[:, None] + b[None, :]).reshape(-1), kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.array(self.sizes)[order])
        return out

    def blocks(self) -> tuple[list[int], list[int]]:
        """By cell, the block it belongs to and into how many parts that block is split.

        Consecutive cells of a row share a block; a cell that is larger than one has a block of its own.
        """
        most, width = bounded(BLOCK, self.dim), len(self.right)
        block, splits, number = [], [], 0
        for row in range(len(self.left)):
            filled = 0
            for size in self.sizes[row * width : (row + 1) * width]:
                if filled and filled + size > most:
                    number, filled = number + 1, 0
                block.append(number)
                splits.append(max(1, -(-size // most)))
                filled += size
            number += 1
        return block, splits


def bounded(rows: int, dim: int) -> int:
    """``rows``, or fewer of long vectors."""
    return max(64, min(rows, FIT_VALUES // max(1, dim)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first(rows: np.ndarray, scores: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row number, best first; ties go to the smaller of ``ties``."""
    order = np.lexsort((ties, -scores, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def rerank(
    entries: np.ndarray, cells: np.ndarray, first_ids: np.ndarray, queries: np.ndarray, visits: list[np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, entry, score)`` of the best ``k`` entries for each query among the cells it visits, as places.

    Cells are multiplied in strips. What may be among the best is then summed entry by entry, in an order that
    depends on the length alone, so equal vectors score alike.
    """
    names, cell = np.unique(cells, return_inverse=True)
    allowed = np.zeros((len(queries), len(names)), bool)
    wanted = np.repeat(np.arange(len(queries)), [len(v) for v in visits])
    flat = np.concatenate(visits)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    known = names[at] == flat
    allowed[wanted[known], at[known]] = True
    order = np.argsort(cell, kind="stable")
    # Rounding in products of matrices stays far below this.
    slack = 1e-9 * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((entries * entries).sum(axis=1).max())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(order):
        stop = int(np.searchsorted(cell[order], cell[order[min(start + 255, len(order) - 1)]], side="right"))
        strip = order[start:stop]
        use = np.flatnonzero(allowed[:, cell[strip[0]] : cell[strip[-1]] + 1].any(axis=1))
        scores = np.where(allowed[use][:, cell[strip]], queries[use] @ entries[strip].T, -np.inf)
        least = np.partition(scores, -k, axis=1)[:, -k] if len(strip) > k else np.full(len(use), -np.inf)
        i, j = np.nonzero((scores >= (least - slack[use])[:, None]) & (scores > -np.inf))
        found.append((use[i], strip[j], scores[i, j]))
        start = stop
    query, entry, score = (np.concatenate(c) for c in zip(*found))
    best = _first(query, score, entry, k)
    least = np.full(len(queries), np.inf)
    np.minimum.at(least, query[best], score[best])
    near = score >= least[query] - slack[query]
    query, entry = query[near], entry[near]
    parts = [(queries[query[a : a + 16384]] * entries[entry[a : a + 16384]]).sum(axis=1) for a in range(0, len(query), 16384)]
    exact = np.concatenate([np.zeros(0), *parts])
    best = _first(query, exact, first_ids[entry], k)
    return query[best], entry[best], exact[best]


def _true_neighbours(indexed: DataFrame, asked: dict[int, np.ndarray], k: int) -> DataFrame:
    """``(dim, query, cell, score)``: cells of the best ``k`` of all entries for each row of ``asked`` by length."""
    shared = indexed.sparkSession.sparkContext.broadcast(asked)  # MEASURED rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & shared.value.keys():
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                scores = shared.value[dim] @ _matrix(some.column("embedding")).T
                query, entry = (a.reshape(-1) for a in np.indices(scores.shape))
                held = best.get(dim, (np.zeros(0, np.int64),) * 2 + (np.zeros(0),))
                query, cell, score = (np.concatenate(c) for c in zip(
                    held, (query, some.column("cell").to_numpy()[entry], scores.reshape(-1))))
                first = _first(query, score, cell, k)
                best[dim] = query[first], cell[first], score[first]
        for dim, (query, cell, score) in best.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(query), pa.int32()), "query": query, "cell": cell, "score": score})

    found = indexed.select("dim", "cell", "embedding").mapInArrow(run, "dim int, query bigint, cell bigint, score double")
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "cell")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _fit(rows: DataFrame) -> dict[int, Codebook]:
    """Codebooks by length of vector, fitted on rows that a hash of their ids picks."""
    n, longest = rows.agg(F.count("*"), F.max("dim")).first()
    wanted = min(FIT_ROWS, max(1, FIT_VALUES // (longest or 1)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "a").limit(wanted).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    k = min(CENTROIDS, max(4, round((n / PER_CELL) ** 0.5)))
    return {dim: Codebook(np.array(own, np.float64), k) for dim, own in by_dim.items()}


def _measure(indexed: DataFrame, books: dict[int, Codebook], k: int, recall: float) -> None:
    """Set the entries that queries visit: the least number with which ``recall`` of a sample's neighbours are."""
    sample = indexed.where("asked").orderBy(F.xxhash64("first_id"), "first_id", "rep").limit(MEASURED).select("dim", "embedding").collect()
    asked = {d: np.array([r.embedding for r in sample if r.dim == d], np.float64) for d in {r.dim for r in sample}}
    needed: dict[int, list[int]] = {}
    before: dict[tuple[int, int], np.ndarray] = {}
    for r in _true_neighbours(indexed, asked, k + 1).select("dim", "query", "cell").collect():  # MEASURED * (k + 1) rows
        if (r.dim, r.query) not in before:
            before[r.dim, r.query] = books[r.dim].before(asked[r.dim][r.query])
        needed.setdefault(r.dim, []).append(int(before[r.dim, r.query][r.cell]))
    for dim, book in books.items():
        enough = int(np.quantile(needed[dim], recall, method="higher")) if dim in needed else sum(book.sizes)
        book.entries = max(enough, k + 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` vectors found nearest to each row of ``vectors`` with ``is_query``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Candidates are all rows
    of another id and the same length. Ranks begin at 1 with the largest inner product in double precision; ties go to
    the smaller id. A query with fewer than ``k`` candidates gets them all. Every row is indexed; the
    centroids are fitted on ``FIT_ROWS`` rows at most. ``recall`` is aimed at on a sample of queries; 1.0 visits
    all that this sample needs, not surely all. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, take no part. Rows that repeat both id and vector count once; one id
    with several vectors is that many candidates, and has a list for each as a query. An empty table gives no rows;
    other columns are not read. Starts jobs while it builds.
    """
    spark = vectors.sparkSession
    kept_type = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept_type).alias("embedding"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("embedding")), F.lit(False)))
    hashed = usable.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("a"),
                           F.xxhash64(F.lit(1), F.reverse("embedding")).alias("b"))
    vector = ["dim", "a", "b"]
    own = hashed.select("vec_id", *vector, F.coalesce(is_query, F.lit(False)).alias("asked")).distinct()
    smallest = own.withColumn("n", F.row_number().over(Window.partitionBy(*vector).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = smallest.groupBy(*vector).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    firsts = hashed.groupBy(*vector).agg(F.first("embedding").alias("embedding"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"))
    distinct = firsts.join(ids, vector).withColumn("rep", F.monotonically_increasing_id())

    books = _fit(hashed)
    fitted = spark.sparkContext.broadcast(books)  # two lists of CENTROIDS half vectors, and a number per cell

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in set(dims.tolist()) & fitted.value.keys():
                some = np.flatnonzero(dims == dim)
                cell[some] = fitted.value[dim].cells(_matrix(batch.column("embedding").take(pa.array(some))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    columns = ["dim", "a", "b", "rep", "asked", "ids", "embedding"]
    schema = f"dim int, a bigint, b bigint, rep bigint, asked boolean, ids array<bigint>, embedding {kept_type}, cell bigint"
    indexed = stage(distinct.select(*columns).mapInArrow(assign, schema), "multi-index").withColumn("first_id", F.col("ids")[0])
    for r in indexed.groupBy("dim", "cell").count().collect():  # CENTROIDS ** 2 rows at most of a length
        if r.dim not in books:
            books[r.dim] = Codebook(np.zeros((1, r.dim)), 1)
        books[r.dim].sizes[r.cell] = r["count"]
    _measure(indexed, books, k, recall)

    layout = {dim: book.blocks() for dim, book in books.items()}
    shared = spark.sparkContext.broadcast((books, layout))
    table = pa.table({
        "dim": pa.array([d for d, (b, _) in layout.items() for _ in b], pa.int32()),
        "cell": pa.array([c for b, _ in layout.values() for c in range(len(b))], pa.int64()),
        "block": pa.array([x for b, _ in layout.values() for x in b], pa.int64()),
        "splits": pa.array([x for _, s in layout.values() for x in s], pa.int32())})
    places = spark.createDataFrame(table) if table.num_rows else spark.createDataFrame([], "dim int, cell long, block long, splits int")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_books, own_layout = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                dim, query = batch.column("dim")[at].as_py(), _matrix(batch.column("embedding").slice(at, 1))[0]
                block, splits = own_layout[dim]
                by_block: dict[int, list[int]] = {}
                for cell in own_books[dim].visited(query):
                    by_block.setdefault(block[cell], []).append(cell)
                n = len(by_block)
                repeat = pa.array([at] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * n, pa.int32()), pa.array(by_block, pa.int64()), pa.array([splits[c[0]] for c in by_block.values()], pa.int32()),
                     batch.column("rep").take(repeat), batch.column("embedding").take(repeat), pa.array(by_block.values(), pa.list_(pa.int64()))],
                    names=["dim", "block", "splits", "rep", "embedding", "cells"])

    asking = indexed.where("asked").select("dim", "rep", "embedding").repartition(spark.sparkContext.defaultParallelism * 2, "rep")
    visits = stage(asking.mapInArrow(
        visit, f"dim int, block bigint, splits int, rep bigint, embedding {kept_type}, cells array<bigint>"), "visits")
    # As many rows as blocks, which are no more than cells.
    many = F.ceil(F.col("n") / F.greatest(F.lit(64), F.least(F.lit(QUERIES), F.expr(f"{FIT_VALUES} div dim")))).cast("int")
    parts = F.broadcast(visits.groupBy("dim", "block").agg(F.count("*").alias("n")).select("dim", "block", many.alias("parts")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = indexed.join(F.broadcast(places), ["dim", "cell"]).join(parts, ["dim", "block"])
    entries = entries.withColumn("split", F.pmod(F.xxhash64("rep"), "splits").cast("int")).withColumn("part", spread("parts"))
    queries = visits.join(parts, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("split", spread("splits"))

    def best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        ids = left.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        visits_of = [v.values.to_numpy() for v in right.column("cells").combine_chunks()]
        query, entry, score = rerank(_matrix(left.column("embedding")), left.column("cell").to_numpy(), first,
                                     _matrix(right.column("embedding")), visits_of, k + 1)
        return pa.table({"rep": right.column("rep").take(pa.array(query)), "score": score, "ids": ids.take(pa.array(entry))})

    found = entries.select(*_KEY, "cell", "ids", "embedding").groupBy(*_KEY).cogroup(
        queries.select(*_KEY, "rep", "embedding", "cells").groupBy(*_KEY)).applyInArrow(best_of_block, "rep bigint, score double, ids array<bigint>")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("rep", "score", F.explode("ids").alias("id"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    answers = stage(indexed.select("rep", *vector).join(lists, "rep").drop("rep"), "answers")
    asked = own.where("asked").select(F.col("vec_id").alias("query_id"), *vector)
    answered = skew_join(asked, answers, vector, write_left=True)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("place", "own")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("own.id").alias("vec_id"), F.col("own.score").alias("score"))
