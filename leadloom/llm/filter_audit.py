"""Audit of how document filters interact, over a sparse document-term matrix.

Five filters fail a document:

- A: it has under 200 words, the sum of its row of the matrix;
- B: under half of its words are distinct, the nonzero columns of its row against that sum;
- C: over 3 % of its code points are ``A-Z``;
- D: it holds one of ``#$%&*|``;
- E: its text is identical to that of a smaller ``doc_id``.

Words are maximal runs without ASCII white space, case-sensitive. The matrix comes in shards whose words are numbered
by one dictionary; C, D and a digest of the text travel with the shards. Documents are then counted by language, set of
failed filters and label, of which there are at most 32 a language, and every order of the filters is read off
those counts.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.llm import term_matrix

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
_ATTRIBUTES = "doc_id bigint, part string, digest binary, n_chars bigint, n_upper bigint, marked boolean"
#: Kinds of bytes: 1 begins a code point, 2 is an upper-case ASCII letter, 4 a mark.
_KIND = np.array([
    (b & 0xC0 != 0x80) + 2 * (65 <= b <= 90) + 4 * (b in MARKS) for b in range(256)
], np.uint8)


def _attributes(batch: pa.RecordBatch) -> dict[str, object]:
    texts = batch.column("text").cast(pa.binary())
    n_chars, n_upper, marked, digest = [], [], [], []
    for text in texts:
        raw = text.as_py()
        by_kind = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
        n_chars.append(int(by_kind[1::2].sum()))
        n_upper.append(int(by_kind[2] + by_kind[3]))
        marked.append(bool(by_kind[4:].any()))
        digest.append(hashlib.sha256(raw).digest())
    return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "digest": digest,
            "n_chars": n_chars, "n_upper": n_upper, "marked": marked}


def failed_filters(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, a, b, c, d)``: what each row of ``docs (doc_id, text, lang)`` fails by itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    local = term_matrix.shards(rows, _attributes, _ATTRIBUTES)
    summed = term_matrix.encoded_rows(
        local, term_matrix.number_words(local), _ATTRIBUTES, term_matrix.row_sums, "n_words bigint, n_distinct bigint")
    return summed.select(
        "doc_id", "part", "digest",
        (F.col("n_words") < LEAST_WORDS).alias("a"),
        (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).alias("b"),
        (100 * F.col("n_upper") > UPPER_PERCENT * F.col("n_chars")).alias("c"),
        F.col("marked").alias("d"))


def count_failures(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, a, b, c, d, e, n, good, toxic)``: documents by the set of filters that they fail.

    ``good`` and ``toxic`` are those of them that some label of their id marks so. Equal texts fail the same
    filters among A to D, so they are counted by digest before the first of them is looked for: a text that a
    third of the documents share is a few rows by then.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    labelled = failed.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "a", "b", "c", "d", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    firsts = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = least.select(*kind, F.explode(F.array(
        F.struct(F.lit(False).alias("e"), firsts.alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - firsts).alias("n")),
    )).alias("own")).select(*kind, "own.e", "own.n")
    counted = split.groupBy("part", "a", "b", "c", "d", "e").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return counted


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    One row per language of ``docs (doc_id, text, lang)``, order of the five filters and step, zeros included.
    ``labels (doc_id, quality, toxic)`` may hold several rows of an id, of which any can mark it. Null text and
    null ``lang`` count as empty; an empty text fails A alone, or E too. A null ``doc_id`` is never a copy or an
    original, and has no label. Rows that repeat an id count each, and are no copies of each other. An empty table gives no rows;
    other columns are not read. Starts jobs while it builds.
    """
    counted = count_failures(failed_filters(docs), labels)
    fails = [F.col(x.lower()) for x in FILTERS]
    n_failed = sum((f.cast("long") for f in fails[1:]), fails[0].cast("long"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counted.select("part", "n", "good", "toxic", n_failed.alias("n_failed"), F.array(*fails).alias("fails"),
                           F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    number = lambda letter: F.ascii(letter) - 64
    own = F.element_at("fails", number(F.substring("filter_order", F.col("step"), F.lit(1))))
    earlier = F.exists(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: (i < F.col("step")) & F.element_at(
        "fails", number(F.substring("filter_order", i, F.lit(1)))))
    steps = steps.select("*", own.alias("own"), earlier.alias("earlier"))
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    removed = F.col("own") & ~F.col("earlier")
    # A document that fails k filters is removed by each of them in 120 / k of the 120 orders.
    share = F.when(F.col("own"), F.expr("n * (120 div n_failed)")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~F.col("own") & ~F.col("earlier")).alias("kept"), total(removed).alias("removed"),
        total(F.col("own") & F.col("earlier")).alias("redundant"),
        total(F.col("own") & (F.col("n_failed") == 1)).alias("unique_fails"), total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))
