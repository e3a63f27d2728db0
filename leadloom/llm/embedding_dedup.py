"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of well separated vectors serves as reference points. Every vector is described by its
nearest reference points in order. Inverted lists are kept for pairs of reference points among them, so
vectors that share a list share two reference points at least, and a pair is examined in the list of its
first two shared ones only. Pairs are verified by their cosine in double precision.

Equal vectors are indexed once and counted. A list is dealt out as blocks of two bounded chunks, which tasks
multiply; they return counts per vector and a spanning set of links, never the pairs. Every pair of a long
list meets in exactly one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.components import connected_components
from leadloom.session import stage

COSINE = 0.95
#: Reference points at most, nearest ones that describe a vector, least cosine at which two are too alike.
PIVOTS, NEAREST, ALIKE = 2048, 6, 0.8
#: Vectors of a chunk of a list, about.
CHUNK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(rows: np.ndarray) -> np.ndarray:
    """Those rows that are not too alike an earlier chosen one."""
    chosen: list[int] = []
    for i in range(len(rows)):
        if not chosen or (rows[chosen] @ rows[i]).max() < ALIKE:
            chosen.append(i)
    return rows[chosen]


def describe(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each row's nearest pivots in order; fewer columns if there are fewer pivots."""
    k = min(nearest, len(pivots))
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int32)


def pair_keys(described: np.ndarray) -> np.ndarray:
    """One key per row and pair of its pivots, ascending in a row."""
    low = np.sort(described, axis=1).astype(np.int64)
    if low.shape[1] < 2:
        return low * (PIVOTS + 1) if low.shape[1] else np.zeros((len(low), 1), np.int64)
    a, b = np.triu_indices(low.shape[1], 1)
    return low[:, a] * PIVOTS + low[:, b]


def examine(key: int, left: tuple, right: tuple | None, cosine: float):
    """Counts of linked vectors for left and right rows, and spanning links, of one block.

    Each side is ``(ids, weights, vectors, keys)``; ``right`` is None for a chunk against itself. A pair
    counts where ``key`` is the first that both hold.
    """
    ids, weights, rows, keys = left
    ids2, weights2, rows2, keys2 = left if right is None else right
    near = rows @ rows2.T >= cosine
    if right is None:
        near &= ~np.eye(len(rows), dtype=bool)
    i, j = np.nonzero(near)
    if len(i):
        mine = np.ones(len(i), bool)
        for at in range(0, len(i), 100_000):  # an earlier key that both hold examines the pair instead
            p, q = keys[i[at : at + 100_000]], keys2[j[at : at + 100_000]]
            shared = (p[:, :, None] == q[:, None, :]).any(axis=2)
            first = np.where(shared, p, np.iinfo(np.int64).max).min(axis=1)
            mine[at : at + 100_000] = first == key
        i, j = i[mine], j[mine]
    if not len(i):
        return None
    n_left = np.bincount(i, weights=weights2[j], minlength=len(ids)).astype(np.int64)
    n_right = None if right is None else np.bincount(j, weights=weights[i], minlength=len(ids2)).astype(np.int64)
    # A spanning set: labels sink to the smallest place reachable, and each place links to what lowered it.
    places = np.concatenate([ids, ids2]) if right is not None else ids
    a, b = i, (j + len(ids) if right is not None else j)
    label = np.arange(len(places))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(places)))
    return n_left, n_right, places[moved], places[label[moved]]


def _usable(embedding) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors (vec_id, embedding)``.

    ``n_links`` counts the other rows of cosine ``cosine`` or more, ``component_id`` is the smallest id
    reachable by links, and ``kept`` says whether it is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without an id, link with nothing; vectors of different
    lengths never link. Rows that repeat count as different vectors, an empty table gives no rows, and other
    columns are not read. About twice the root of the number of vectors serve as pivots, ``pivots`` at most.
    Starts jobs while it builds.
    """
    spark = vectors.sparkSession
    # Single precision moves as it is stored; tasks compute in double precision either way.
    kept_type = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept_type).alias("embedding"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("embedding")), F.lit(False)))
    hashed = usable.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("a"),
                           F.xxhash64(F.lit(1), F.reverse("embedding")).alias("b"))
    firsts = hashed.groupBy("dim", "a", "b").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    # An id of its own for each distinct vector, since different vectors may carry one ``vec_id``; fixed by writing it.
    distinct = stage(firsts.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")

    n = distinct.count()
    wanted = min(pivots, max(16, math.ceil(2 * math.sqrt(n))))
    sample = distinct.orderBy(F.xxhash64("first_id"), "first_id", "dim", "a").limit(wanted).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    unit = {d: np.array(v) / np.linalg.norm(v, axis=1, keepdims=True) for d, v in by_dim.items()}
    shared = spark.sparkContext.broadcast({d: choose_pivots(v) for d, v in unit.items()})  # ``pivots`` rows at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                some = batch.take(own)
                points = shared.value.get(int(dim), np.zeros((0, int(dim))))
                keys = pair_keys(describe(_matrix(some.column("embedding")), points, NEAREST))
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [some.column("dim"), some.column("rep"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                    names=["dim", "rep", "keys"])

    described = stage(distinct.select("dim", "rep", "embedding").mapInArrow(index, "dim int, rep bigint, keys array<bigint>"), "described")
    posted = described.select("dim", "rep", F.explode("keys").alias("key"))
    lists = posted.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = lists.select("dim", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    member = posted.join(lists, ["dim", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "key"), "chunks").cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    member = member.select("dim", "key", "rep", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                           (F.col("chunk") > F.col("other")).alias("second"))
    loaded = member.join(distinct.select("dim", "rep", "weight", "embedding"), ["dim", "rep"]).join(described, ["dim", "rep"])
    order = ["dim", "key", "i", "j"]
    dealt = loaded.select(*order, "second", "rep", "weight", "embedding", "keys").repartition(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def name(batch: pa.RecordBatch, row: int) -> tuple:
            return tuple(batch.column(c)[row].as_py() for c in order)

        def run(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            where = np.stack([batch.column(c).to_numpy() for c in order])
            ends = np.append(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, batch.num_rows)
            reps, second = batch.column("rep").to_numpy(), batch.column("second").to_numpy(zero_copy_only=False)
            weights = batch.column("weight").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            start = 0
            for end in ends.tolist():
                if end - start > 1:
                    rows, keys = _matrix(batch.column("embedding").slice(start, end - start)), batch.column("keys").slice(start, end - start)
                    keys = keys.flatten().to_numpy().reshape(end - start, -1)
                    side = second[start:end]
                    cut = lambda m: (reps[start:end][m], weights[start:end][m], rows[m], keys[m])
                    own = where[2, start] == where[3, start]
                    got = examine(int(where[1, start]), cut(~side), None if own else cut(side), cosine)
                    if got:
                        for ids, counts in ((cut(~side)[0], got[0]), (cut(side)[0], got[1])):
                            if counts is not None and counts.any():
                                out.append((ids[counts > 0], ids[counts > 0], counts[counts > 0]))
                        out.append((got[2], got[3], np.zeros(len(got[2]), np.int64)))
                start = end
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "n"])

        # A block may go on in the next batch: its rows wait for the rest.
        for batch in batches:
            if not batch.num_rows:
                continue
            last, cut = name(batch, batch.num_rows - 1), batch.num_rows
            if held and name(held[-1], held[-1].num_rows - 1) != name(batch, 0):
                yield from run(held)
                held = []
            low, high = 0, batch.num_rows - 1  # the first row of the batch's last block
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if name(batch, middle) != last else (low, middle)
            cut = low
            if cut:
                yield from run([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from run(held)

    found = stage(dealt.mapInArrow(blocks, "u bigint, v bigint, n bigint"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    classes = connected_components(found.where("n = 0").select(F.col("u").alias("a"), F.col("v").alias("b")))
    known = stage(distinct.select("dim", "a", "b", "rep", "first_id", "weight").join(counts, "rep", "left").join(
        classes, F.col("rep") == F.col("node"), "left"), "linked-vectors")
    named = known.where("component is not null").groupBy("component").agg(F.min("first_id").alias("smallest"))
    known = known.join(named, "component", "left").select(
        "dim", "a", "b", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("smallest", "first_id").alias("component_id"))
    linked = hashed.drop("embedding").join(known, ["dim", "a", "b"]).select("vec_id", "n_links", "component_id")
    usable_row = F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("embedding")), F.lit(False))
    alone = rows.where(~usable_row).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
