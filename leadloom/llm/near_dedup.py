"""Near-duplicate documents by weighted minimum hashing with darts.

A document is a weighted set of word shingles. Every shingle owns a strip of the plane, as wide as its weight;
darts fall on each strip at hashed places, the same for all documents, in the order of their rank. A dart also
names one coordinate of the signature, which keeps the earliest dart that lands on the document's strips.
Two documents agree in a coordinate with a chance equal to their weighted Jaccard similarity. Darts are thrown
until about ``k (ln k + 3)`` of them have hit, and more for documents with a coordinate still empty.

Coordinates are banded into buckets. Documents with equal shingle sets count once. In each bucket documents
are compared with its first document; a bucket that then still holds several components is dealt out as blocks
of two bounded chunks, in which every pair from different components is compared. Blocks return a spanning set
of links, never the pairs. Links are verified exactly on the shingle sets, and classes are their connected
components. No bucket is expanded into its pairs and none is gathered in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import SLICE_ROWS, slices, text_of
from leadloom.llm.components import connected_components
from leadloom.llm.word_hashes import mix, shingle_sets
from leadloom.session import stage

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 6
#: Documents and shingles of a chunk of a bucket, about.
CHUNK, CHUNK_SHINGLES = 1024, 500_000
_STEP, _CELL = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Signatures of ``k`` coordinates of weighted sets laid end to end; zeros for an empty set.

    ``sizes`` holds the number of elements of each set. Weights are positive; a strip of weight 2.5 is two
    whole unit cells and half a cell, of which darts beyond the half miss.
    """
    out = np.zeros((len(sizes), k), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cells = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), cells)
    number = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
    seeds = mix(elements[element] ^ mix(number.astype(np.uint64) * _CELL))
    width = np.minimum(1.0, weights[element] - number)
    of = owner[element]
    total = np.bincount(owner, weights=weights, minlength=len(sizes))
    reach = np.zeros(len(sizes))
    reach[total > 0] = k * (math.log(k) + 3) / total[total > 0]
    pending = total > 0
    while pending.any():
        use = np.flatnonzero(pending[of])
        seed, limit, rank = seeds[use], reach[of[use]], np.zeros(len(use))
        wide, doc = width[use], of[use]
        docs, ranks, darts = [], [], []
        throw = np.zeros(1, np.uint64)
        while len(seed):
            throw += _STEP
            bits = mix(seed + throw)
            rank = rank - np.log(_uniform(bits))
            alive = rank < limit
            if not alive.all():
                seed, limit, rank, wide, doc, bits = (a[alive] for a in (seed, limit, rank, wide, doc, bits))
            dart = mix(bits ^ _CELL)
            hit = slice(None) if (wide >= 1).all() else _uniform(mix(dart ^ _STEP)) < wide
            docs.append(doc[hit])
            ranks.append(rank[hit])
            darts.append(dart[hit])
        doc, rank, dart = np.concatenate(docs), np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(-rank, kind="stable")  # the earliest is written last and stays
        doc, dart = doc[order], dart[order]
        out.reshape(-1)[doc * k + (dart % np.uint64(k)).astype(np.int64)] = dart | np.uint64(1)
        pending &= (out == 0).any(axis=1)
        reach *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of consecutive coordinates."""
    n, k = signatures.shape
    keys = np.zeros((n, bands), np.uint64)
    for c in range(k // bands):
        keys = mix(keys * _STEP + signatures[:, c :: k // bands][:, :bands])
    return keys


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _set_hashes(elements: np.ndarray, repeats: np.ndarray, sizes: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, in two halves."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    salted = mix(elements ^ mix(repeats.astype(np.uint64))) if weighted else elements
    a, b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    np.add.at(a, owner, mix(salted ^ _STEP))
    np.add.at(b, owner, mix(salted ^ _CELL))
    return _signed(a), _signed(b)


#: What tells the texts of one id apart.
_TEXT = ["t1", "t2"]


def _with_text_hashes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def fingerprints(docs: DataFrame, weighted: bool, bands: int, rows: int) -> DataFrame:
    """``(doc_id, t1, t2, a, b, bands)``: hashes of the text and of the shingle set, and the band keys, of every row.

    A text without words has null set hashes and keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                elements, repeats, sizes = shingle_sets(some.column("text").to_pylist(), SHINGLE)
                weights = repeats.astype(float) if weighted else np.ones(len(elements))
                keys = band_keys(dart_signatures(elements, weights, sizes, bands * rows), bands)
                a, b = _set_hashes(elements, repeats, sizes, weighted)
                empty = sizes == 0
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands)
                lists = pa.ListArray.from_arrays(offsets, pa.array(_signed(np.ascontiguousarray(keys).reshape(-1))), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([
                    *(some.column(c) for c in ("doc_id", *_TEXT)), pa.array(a, mask=empty), pa.array(b, mask=empty), lists
                ], names=["doc_id", *_TEXT, "a", "b", "bands"])

    rows_in = _with_text_hashes(text_of(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return rows_in.mapInArrow(run, "doc_id bigint, t1 bigint, t2 bigint, a bigint, b bigint, bands array<bigint>")


def shingles_of(docs: DataFrame, weighted: bool) -> DataFrame:
    """``(doc, shingles)`` as sorted 32-bit hashes; a repeated shingle has one hash per repeat if weighted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                elements, repeats, sizes = shingle_sets(some.column("text").to_pylist(), SHINGLE)
                if weighted:
                    owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), repeats)
                    number = np.arange(len(owner)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
                    elements = mix(np.repeat(elements, repeats) ^ mix(number.astype(np.uint64) * _CELL))
                    sizes = np.bincount(owner, minlength=len(sizes))
                short = (elements >> np.uint64(32)).astype(np.uint32).view(np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc"), pa.ListArray.from_arrays(offsets, pa.array(short))], names=["doc", "shingles"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, shingles array<int>")


def first_of_buckets(members: DataFrame) -> DataFrame:
    """``(x, y)`` pairs of each member ``(doc, bucket...)`` with the first of its bucket."""
    keys = [c for c in members.columns if c != "doc"]
    firsts = members.groupBy(*keys).agg(F.min("doc").alias("x"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(firsts, keys).where("doc <> x").select("x", F.col("doc").alias("y")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """``(x, y, linked)`` by the exact similarity of the shingle sets of each pair of documents."""
    named = lambda n: sets.select(F.col("doc").alias(n), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(named("x"), "x").join(named("y"), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    share = common / (F.size("sx") + F.size("sy") - common)
    return both.select("x", "y", (share >= similar).alias("linked"))


def spanning_links(
    docs: np.ndarray, labels: np.ndarray, sides: np.ndarray, shingles: pa.ListArray, similar: float
) -> list[tuple[int, int]]:
    """Links that join the components of one block's documents, by the similarity of every pair.

    Pairs of one component are skipped, also of one that the block's earlier links have joined; ``sides`` are
    all alike for a chunk against itself, else only pairs across them count. Sets are not empty.
    """
    sizes = np.diff(shingles.offsets.to_numpy()).astype(np.int64)
    words, flat = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(words), np.uint8)
    label = np.unique(labels, return_inverse=True)[1]
    sets = np.split(flat, starts[1:])
    own = bool((sides == sides[0]).all())
    few = sides if 2 * np.count_nonzero(sides) <= len(sides) else ~sides
    out = []
    for d in range(len(docs)) if own else np.flatnonzero(few):
        left = np.flatnonzero(label[d + 1 :] != label[d]) + d + 1 if own else np.flatnonzero(~few & (label != label[d]))
        left = left[np.minimum(sizes[left], sizes[d]) >= similar * np.maximum(sizes[left], sizes[d]) - 1e-6]
        if not len(left):
            continue
        mark[sets[d]] = 1
        ends = np.cumsum(sizes[left])
        at = np.repeat(starts[left] - ends + sizes[left], sizes[left]) + np.arange(ends[-1])
        common = np.add.reduceat(mark[flat[at]], ends - sizes[left], dtype=np.int64)
        mark[sets[d]] = 0
        alike = left[common / (sizes[left] + sizes[d] - common) >= similar]
        joined, first = np.unique(label[alike], return_index=True)
        out += [(int(docs[d]), int(docs[k])) for k in alike[first]]
        label[np.isin(label, joined)] = label[d]
    return out


def links_between(members: DataFrame, labels: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links ``(x, y)`` between components ``labels (node, component)`` that share a bucket of ``members``.

    Every pair of a bucket is compared unless its documents are known to be in one component. The documents of
    a bucket's largest component are not dealt against each other.
    """
    keys = ["band", "key"]
    named = members.join(labels, F.col("doc") == F.col("node"), "left").select(
        *keys, "doc", F.coalesce("component", "doc").alias("label"))
    sized = stage(named.join(sets.select("doc", F.size("shingles").cast("long").alias("size")), "doc"), "members")
    parts = sized.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    chunks = lambda n, size: F.ceil(F.greatest(F.col(n) / CHUNK, F.col(size) / CHUNK_SHINGLES)).cast("int")
    mixed = parts.groupBy(*keys).agg(
        F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")
    ).where("n > most.n").select(
        *keys, F.col("most.label").alias("main"), F.col("most.n").alias("n0"), F.col("most.size").alias("s0"),
        (F.col("n") - F.col("most.n")).alias("n1"), (F.col("size") - F.col("most.size")).alias("s1"))
    mixed = mixed.select(*keys, "main", chunks("n0", "s0").alias("c0"), chunks("n1", "s1").alias("c1"))
    dealt = sized.join(mixed, keys)
    main, place = F.col("label") == F.col("main"), F.xxhash64("doc", "key")
    dealt = dealt.withColumn("chunk", F.when(main, F.pmod(place, "c0")).otherwise(F.col("c0") + F.pmod(place, "c1")).cast("int"))
    low = F.when(main, F.col("c0")).otherwise(F.lit(0))
    dealt = dealt.withColumn("other", F.explode(F.sequence(low, F.col("c0") + F.col("c1") - 1)))
    dealt = dealt.select(
        *keys, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "doc", "label",
        (F.col("chunk") > F.col("other")).alias("second"))
    loaded = dealt.join(sets, "doc")

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("doc").combine_chunks()
        column = lambda n: block.column(n).combine_chunks()
        found = spanning_links(column("doc").to_numpy(), column("label").to_numpy(), column("second").to_numpy(zero_copy_only=False),
                               column("shingles"), similar) if block.num_rows > 1 else []
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    return loaded.groupBy(*keys, "i", "j").applyInArrow(run, "x bigint, y bigint")


def classes_of(
    docs: DataFrame, similar: float = SIMILAR, weighted: bool = False, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(doc_id, t1, t2, class_id, member)`` of every row of ``docs``: its class, and the number of its set.

    ``class_id`` is the smallest ``doc_id`` of the class. Texts without words have a null ``member`` and are each a
    class of their own. ``t1`` and ``t2`` tell texts of one id apart. Starts jobs while it builds.
    """
    prints = stage(fingerprints(docs, weighted, bands, rows), "fingerprints")
    worded = prints.where("a is not null and doc_id is not null")
    # Equal sets are one document from here on, numbered by its being written; its first row lends its keys and text.
    firsts = worded.groupBy("a", "b").agg(F.min(F.struct("doc_id", *_TEXT)).alias("row"), F.first("bands").alias("bands"))
    numbered = firsts.select("a", "b", "row.*", "bands", F.monotonically_increasing_id().alias("doc"))
    distinct = stage(numbered, "distinct")
    members = distinct.select("doc", F.posexplode("bands").alias("band", "key"))
    pairs = stage(first_of_buckets(members), "pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    wanted = stage(distinct.select("doc", "doc_id", *_TEXT).join(wanted, "doc", "left_semi"), "wanted")
    ids = stage(wanted.select("doc_id").distinct(), "wanted-ids")
    # An id may have several texts, which their hashes tell apart, and rows that repeat, of which one counts.
    # Ids alone go first: texts that are not wanted do not move to meet the whole key.
    texts = _with_text_hashes(text_of(docs, F.col("doc_id").cast("long").alias("doc_id")))
    texts = texts.join(ids, "doc_id", "left_semi").join(wanted, ["doc_id", *_TEXT])
    sets = stage(shingles_of(texts, weighted).dropDuplicates(["doc"]), "shingles")
    first = stage(verified(pairs, sets, similar), "verified").where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = stage(connected_components(first), "labels")
    # A bucket's documents may link with each other but not with its first.
    others = stage(links_between(members, labels, sets, similar), "links-between")
    links = first.unionByName(others.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = distinct.select("a", "b", "doc", "doc_id").join(connected_components(links), F.col("doc") == F.col("node"), "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = named.join(least, "component", "left").select("a", "b", F.coalesce("component", "doc").alias("member"),
                                                          F.coalesce("smallest", "doc_id").alias("class_id"))
    own = worded.drop("bands").join(named, ["a", "b"])
    rest = prints.where("a is null or doc_id is null").select(
        "doc_id", *_TEXT, F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("member"))
    return own.select("doc_id", *_TEXT, "class_id", "member").unionByName(rest)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, class_id)`` of every row of ``docs (doc_id, text)``.

    ``class_id`` is the smallest ``doc_id`` that is reachable by links of similarity ``similar`` or more on
    shingles of five words; unweighted, a shingle counts once per document. Null texts and texts without words
    link with nothing, a null id has a null class. Texts shorter than a shingle are one shingle. Different texts under
    one id have each a class of their own; an empty table gives no rows; other columns are not read. ``options`` are
    those of ``classes_of``. Starts jobs while it builds.
    """
    return classes_of(docs, **options).select("doc_id", "class_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whole, that are the first of their class; rows with a null id all stay.

    Of a class the text of the smallest id stays, and of several under that id the one whose hashes are smallest.
    Texts without words all stay. Of rows with the same id and text one stays.
    """
    known = classes_of(docs, **options).where("doc_id is not null")
    firsts = known.where("member is not null").groupBy("member").agg(F.min(F.struct("doc_id", *_TEXT)).alias("first")).select("first.*")
    firsts = firsts.unionByName(known.where("member is null").select("doc_id", *_TEXT).distinct())
    free = [name + "_" * max(map(len, docs.columns)) for name in _TEXT]  # names that ``docs`` has not
    text = F.coalesce("text", F.lit(""))
    hashed = docs.where("doc_id is not null").withColumns({free[0]: F.xxhash64(text), free[1]: F.xxhash64(F.lit(1), text)})
    kept = hashed.join(firsts.withColumnsRenamed(dict(zip(_TEXT, free))), ["doc_id", *free], "left_semi")
    kept = kept.dropDuplicates(["doc_id", *free]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
