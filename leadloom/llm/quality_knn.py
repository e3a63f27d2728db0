"""Document quality by votes of the nearest labelled documents in a latent space.

Documents become vectors of style: hashed n-grams of character classes and shares of repeated words and
lines. A singular value decomposition of a bounded sample of labelled documents gives the latent space. The
sample's vectors are sent to every task, where blocks of documents are multiplied with all of them: exact
cosines. The nearest vote with the labels, weighted by a power of their cosine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import SLICE_ROWS, slices, text_of
from leadloom.llm.features import SHAPES, byte_ngrams, normalised

#: Labelled documents that a model is fitted on at most; what is sent to tasks is bounded by it.
SAMPLE = 4000
#: Hashed n-grams, latent dimensions, neighbours that vote, power of their cosines, least score of a good document.
HASHED, LATENT, NEIGHBOURS, POWER, GOOD = 1024, 48, 25, 4, 0.3
BLOCK = 512


def repetition(text: str) -> list[float]:
    """Shares of adjacent equal words, distinct words, the commonest word, and repeated lines."""
    words = text.split()
    if not words:
        return [0.0, 0.0, 0.0, 0.0]
    adjacent = sum(map(str.__eq__, words, words[1:])) / len(words)
    counts = Counter(words)
    lines = text.split("\n")
    return [adjacent, 0.5 * len(counts) / len(words), max(counts.values()) / len(words), 1 - len(set(lines)) / len(lines)]


def features(texts: list[str]) -> np.ndarray:
    shapes = normalised(byte_ngrams(texts, SHAPES, (2, 3, 4), HASHED))
    return np.hstack([shapes, np.array([repetition(t) for t in texts], np.float32).reshape(-1, 4)])


@dataclass(frozen=True)
class Model:
    """The mean and axes of the latent space, and the labelled vectors in it."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.mean) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The weighted share of good neighbours; 0.5 without any labelled document."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = []
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosines = self.latent(features(texts[at : at + BLOCK])) @ self.vectors.T
            nearest = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            weights = np.clip(np.take_along_axis(cosines, nearest, 1), 0, None).astype(float) ** POWER + 1e-9
            out.append((weights * self.labels[nearest]).sum(1) / weights.sum(1))
        return np.concatenate(out) if out else np.zeros(0)


def fit_rows(rows: np.ndarray, labels: np.ndarray) -> Model:
    if not len(rows):
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    mean = rows.mean(axis=0)
    centred = (rows - mean).astype(np.float32)
    _, axes = np.linalg.eigh(centred.T @ centred)
    model = Model(mean, np.ascontiguousarray(axes[:, -LATENT:]), np.zeros((0, 0)), labels)
    return Model(mean, model.axes, model.latent(rows), labels)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out ones, chosen by a hash of their ids.

    Only the chosen documents' vectors reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(sample)
    texts = text_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                rows = features(some.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("good"), pa.array([r.tobytes() for r in rows], pa.binary())
                ], names=["doc_id", "good", "row"])

    got = texts.mapInArrow(run, "doc_id bigint, good double, row binary").limit(sample).collect()
    got.sort(key=lambda r: (r.doc_id, r.good, r.row))
    if not got:
        return fit_rows(np.zeros((0, 0)), np.zeros(0))
    rows = np.array([np.frombuffer(r.row, np.float16) for r in got], np.float32)
    return fit_rows(rows, np.array([r.good for r in got]))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; ``predicted`` is 1 from a score of 0.3 on.

    Null text counts as empty and is scored by its neighbours like any other. Repeated rows repeat, an empty
    table gives no rows, other columns are not read. Without labelled documents every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                scores = shared.value.scores(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("held_out"), pa.array(scores, pa.float64()),
                    pa.array((scores >= GOOD).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    rows = text_of(rows, F.col("doc_id").cast("long").alias("doc_id"), "held_out")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores 0.3 or more; handling of odd rows as in ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                scores = shared.value.scores([t or "" for t in some.column("text").to_pylist()])
                yield some.filter(pa.array(scores >= GOOD))

    return docs.mapInArrow(run, docs.schema)
