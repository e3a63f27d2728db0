"""How far sources of a language differ in their words, by a frequent-pattern tree of term rows.

A term's row holds its counts in the sources of a language. The row's nonzero counts, sources in a fixed order, are
a path ``(source, count), ...`` of a prefix tree, and equal rows are one path with a multiplicity. The
difference of two sources is what it would be if no term occurred in either, plus a correction for each
term that occurs in one of them as if it were alone, plus a correction for each term that occurs in both. Terms with
a common beginning of their rows share nodes, so the corrections of pairs are taken once for a node and each of
its ancestors, times the number of terms below the node.

Paths are dealt out by ranges and sorted, which makes a task's part of the tree a walk in depth: it holds one
path and sums by pair. A node that two tasks share is counted by each with its own terms, which adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.llm.common import slices
from leadloom.llm.term_matrix import local_matrix
from leadloom.session import stage

LEAST_DOCUMENTS, RANKS, SCALE = 10, 10, 1_000_000_000
#: Bytes to lower case, or to the space that separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose terms are counted at once.
COUNTED = 8_000_000
#: Pairs of nodes and ancestors whose corrections are taken at once, and sums that a task holds.
PAIRS, SUMS = 200_000, 1_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)`` over all of ``docs (lang, source, text)``, counted in tasks first."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, indptr, codes, counts = local_matrix(batch.column("text"), FOLD)
        group = batch.column("group").dictionary_encode()
        of_row = np.repeat(group.indices.to_numpy(), np.diff(indptr)).astype(np.int64)
        cells, first, inverse = np.unique(of_row * max(1, len(words)) + codes, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([
            group.dictionary.take(pa.array(of_row[first])), words.take(pa.array(codes[first])),
            pa.array(np.bincount(inverse, weights=counts, minlength=len(cells)).astype(np.int64)),
            pa.array(np.bincount(inverse, minlength=len(cells))),
        ], names=["group", "term", "n", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, bytes_at_once=COUNTED):
                yield count(some)

    # Languages and sources may hold any character; a group's name says where the first ends.
    rows = docs.select(F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source").alias("group"), "text")
    counted = rows.mapInArrow(run, "group string, term string, n bigint, n_docs bigint")
    counted = counted.groupBy("group", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    begin, colon = F.col("begin"), F.instr("group", ":")
    named = counted.withColumn("begin", F.substring_index("group", ":", 1).cast("int")).select(
        F.substring(F.col("group"), colon + 1, begin).alias("lang"),
        F.substring(F.col("group"), colon + 1 + begin, F.length("group")).alias("source"),
        "term", "n", "n_docs")
    return named


def portion(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * n_terms))``, exactly."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * n_terms))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)  # squares stay below 2**63


def pair_corrections(paths: DataFrame) -> DataFrame:
    """``(lang, s, t, value)``: corrections of all terms that occur in both sources ``s`` and ``t``, one row per pair.

    ``paths (lang, path, weight)`` holds distinct paths of ``(place, source, p, p0)``: a source's place and name, its
    portion for the count and for the count 0.
    """
    dealt = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, items, stack = None, [], []  # the open path: its items, and the terms below each
        sums: dict[tuple[str, int, int], int] = {}
        names: dict[tuple[str, int], str] = {}
        low: list[tuple] = []  # nodes that wait, as (language, depth, items, terms)
        waiting = 0

        def settle() -> None:
            """Take the corrections of the waiting nodes with each of their ancestors."""
            nonlocal waiting
            if not low:
                return
            depth = np.array([d for _, d, _, _ in low])
            node = np.repeat(np.arange(len(low)), depth)
            above = np.array([i[:3] for _, d, own, _ in low for i in own[:d]], np.int64)
            own = np.array([own[d][:3] for _, d, own, _ in low], np.int64)[node]
            weight = np.array([w for *_, w in low], np.int64)[node]
            s, p, p0, t, q, q0 = *above.T, *own.T
            value = weight * (_differences(p, q) - _differences(p, q0) - _differences(p0, q) + _differences(p0, q0))
            langs = {}
            of = np.array([langs.setdefault(l, len(langs)) for l, *_ in low])[node]
            order = np.lexsort((t, s, of))
            keys = np.stack([of, s, t])[:, order]
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            back = list(langs)
            for (k, a, b), total in zip(keys[:, starts].T.tolist(), np.add.reduceat(value[order], starts).tolist()):
                key = (back[k], a, b)
                sums[key] = sums.get(key, 0) + total
            low.clear()
            waiting = 0

        def close(depth: int) -> None:
            nonlocal waiting
            while len(stack) > depth:
                terms = stack.pop()
                if stack:
                    stack[-1] += terms
                    low.append((lang, len(stack), whole, terms))
                    waiting += len(stack)
                    if waiting >= PAIRS:
                        settle()

        def emit() -> pa.RecordBatch:
            settle()
            rows = [(k, names[k, a], names[k, b], v) for (k, a, b), v in sums.items()]
            sums.clear()
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "s", "t", "value"])

        whole: tuple = ()
        for batch in batches:
            for row in batch.to_pylist():
                path = tuple((i["place"], i["p"], i["p0"]) for i in row["path"])
                shared = 0
                if row["lang"] == lang:
                    while shared < min(len(path), len(whole)) and path[shared] == whole[shared]:
                        shared += 1
                close(shared)
                lang, whole = row["lang"], path
                for i in row["path"][shared:]:
                    names[lang, i["place"]] = i["source"]
                stack += [0] * (len(path) - shared)
                stack[-1] += row["weight"]
                if len(sums) > SUMS:
                    yield emit()
        close(0)
        yield emit()

    found = dealt.mapInArrow(run, "lang string, s string, t string, value bigint")
    return found.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, ranks: int = RANKS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every language and source of ``docs (lang, source, text)``.

    Part ``pair`` gives the difference from each other source of the language, part ``term`` the ``ranks`` kept terms
    that the source uses more than its language, by what they add to the difference from it. Terms are runs of ASCII
    letters and non-ASCII characters, lower-cased in A-Z; those in ``least_documents`` rows of a language are kept.
    Null text, ``lang`` and ``source`` count as empty. A source without terms, or a language without kept ones,
    has its pairs all the same. Ties go to the smaller item by its UTF-8 bytes. Rows that repeat count as
    documents of their own, an empty table gives no rows, other columns are not read. The pairs of a
    language's sources are the square of their number, as asked for. Starts jobs while it builds.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = stage(term_counts(rows), "term-counts")
    kept = stage(counted.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_documents).drop("n_docs"), "kept-terms")
    used = stage(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used-terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total"])
    # Sources with few words come first: their counts are small, so more rows begin alike.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("total", "source"))
    groups = stage(groups.select("lang", "source", "total", "v", "lang_total", place.alias("place"), F.when(
        F.col("v") > 0, portion(F.lit(0).cast("long"), F.col("total"), F.col("v"))).alias("p0")), "sources")

    weighed = used.join(groups, ["lang", "source"]).withColumn("p", portion(F.col("n"), F.col("total"), F.col("v")))
    weighed = stage(weighed.select("lang", "source", "term", "place", "p", "p0", portion(
        F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "portions")

    # A path is at most as long as a language has sources.
    paths = weighed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "p", "p0", "source"))).alias("path"))
    both = pair_corrections(paths.groupBy("lang", "path").agg(F.count("*").alias("weight")))
    alone = weighed.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))  # the nodes of each source by count
    other = groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("q0"))
    single = alone.join(other, "lang").where("source <> t").groupBy("lang", "source", "t").agg(F.sum(
        F.col("terms") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0")))).alias("value"))
    pairs = groups.select("lang", "source", "v", "p0").join(other, "lang").where("source <> t")
    base = pairs.select("lang", "source", "t", F.when(F.col("v") > 0, F.col("v") * difference(
        F.col("p0"), F.col("q0"))).otherwise(F.lit(0)).alias("value"))
    turned = lambda df, s, t: df.select("lang", F.col(s).alias("source"), F.col(t).alias("item"), "value")
    added = turned(base, "source", "t").unionByName(turned(single, "source", "t")).unionByName(
        turned(single, "t", "source")).unionByName(turned(both, "s", "t")).unionByName(turned(both, "t", "s"))
    values = added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    above = weighed.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(values).unionByName(ranked(above).where(F.col("rank") <= ranks))
