"""Language identification in two steps: the family first, then the language within it.

Documents are hashed byte n-grams of their letters. Linear support vector machines tell each family from the
others; within a family one machine per pair of languages votes. All are fitted on a bounded sample of
labelled documents per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import SLICE_ROWS, slices, text_of
from leadloom.llm.features import LETTERS, byte_ngrams, normalised

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "indic": "bn gu hi mr ne pa si ur".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Labelled documents that the machines are fitted on: of a language at most and at least, and in all. With many
#: languages each has fewer; beyond 1500 languages the rarest are not learned.
SAMPLE, LEAST, FITTED = 800, 8, 12_000
HASHED, SIZES = 2048, (2, 3)
SHARPNESS = 4.0


def features(texts: list[str]) -> np.ndarray:
    return normalised(byte_ngrams(texts, LETTERS, SIZES, HASHED))


def fit_machine(rows: np.ndarray, signs: np.ndarray, cost: float = 10.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted equally, by accelerated gradient descent."""
    weight = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())).astype(np.float32)
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 / cost + 4.0)
    for step in range(steps):
        slack = np.clip(1 - signs * (x @ v), 0, None)
        gradient = v / cost / 10 - 2 * (x.T @ (weight * signs * slack))
        new = v - rate * gradient
        v = new + step / (step + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_machines: list[tuple[np.ndarray, float]] = field(default_factory=list)
    pair_machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ``und`` and 0.0 without a letter or without a learned language."""
        rows = features(texts)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        readable = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if not self.families or not readable.any():
            return names, scores
        if len(self.families) > 1:
            margins = np.stack([rows @ w + b for w, b in self.family_machines], axis=1)
            chosen = margins.argmax(axis=1)
            ordered = np.sort(margins, axis=1)
            sure = _logistic(SHARPNESS * (ordered[:, -1] - ordered[:, -2]))
        else:
            chosen, sure = np.zeros(len(texts), int), np.ones(len(texts))
        for f, family in enumerate(self.families):
            own = np.flatnonzero(readable & (chosen == f))
            if not len(own):
                continue
            langs = self.members[family]
            votes = np.zeros((len(own), len(langs)))
            least = np.full((len(own), len(langs)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                w, bias = self.pair_machines[a, b]
                margin = rows[own] @ w + bias
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                least[:, i], least[:, j] = np.minimum(least[:, i], margin), np.minimum(least[:, j], -margin)
            # Most votes, then the largest of the least margins.
            best = np.lexsort((least.T, votes.T), axis=0)[-1] if len(langs) > 1 else np.zeros(len(own), int)
            inner = _logistic(SHARPNESS * least[np.arange(len(own)), best]) if len(langs) > 1 else np.ones(len(own))
            for k, row in enumerate(own):
                names[row] = langs[best[k]]
            scores[own] = sure[own] * inner
        return names, scores


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_rows(rows: np.ndarray, langs: list[str]) -> Model:
    model = Model()
    names = np.array(langs, object)
    for lang in sorted(set(langs)):
        model.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model.families = sorted(model.members)
    kin = np.array([FAMILY_OF.get(lang, lang) for lang in langs], object)
    if len(model.families) > 1:
        model.family_machines = [fit_machine(rows, np.where(kin == f, 1, -1).astype(np.float32)) for f in model.families]
    for own in model.members.values():
        for a, b in combinations(own, 2):
            pair = np.flatnonzero((names == a) | (names == b))
            model.pair_machines[a, b] = fit_machine(rows[pair], np.where(names[pair] == a, 1, -1).astype(np.float32))
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` documents per language outside the held-out ones, chosen by a hash of their ids.

    Only counts per language and the chosen documents' vectors reach the driver, about ``FITTED`` of them at most.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FITTED // LEAST).collect()
    if not counts:
        return Model()
    sample = max(LEAST, min(sample, FITTED // len(counts)))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, sample / r["count"]))])
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(ticket < F.coalesce(shares[F.col("lang")], F.lit(0.0))).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                rows = features(some.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id").cast(pa.int64()), some.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())
                ], names=["doc_id", "lang", "row"])

    got = chosen.mapInArrow(run, "doc_id bigint, lang string, row binary").limit(2 * max(sample * len(counts), 1000)).collect()
    got.sort(key=lambda r: (r.lang, -1 if r.doc_id is None else r.doc_id, r.row))
    if not got:
        return Model()
    return fit_rows(np.array([np.frombuffer(r.row, np.float16) for r in got], np.float32), [r.lang for r in got])


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row.

    A null text, or one without a letter, is ``und`` with score 0.0. Repeated rows repeat, an empty table
    gives no rows, columns besides id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                names, scores = shared.value.predict(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())
                ], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    rows = text_of(rows, F.col("doc_id").cast("long").alias("doc_id"), "held_out")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose language is told, however closely; all with a letter if none was learned.

    A null ``lang``, where ``docs`` has that column, is filled with the language told. Null texts and those without a
    letter go; repeated rows repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fill = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows_at_once=SLICE_ROWS):
                texts = [t or "" for t in some.column("text").to_pylist()]
                if shared.value.families:
                    names = shared.value.predict(texts)[0]
                    kept = [n != "und" for n in names]
                    if fill is not None:
                        own = some.column(fill)
                        filled = pc.coalesce(own, pa.array(names, own.type))
                        some = some.set_column(fill, some.schema.field(fill), filled)
                else:
                    kept = [any(map(str.isalpha, t)) for t in texts]
                yield some.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
