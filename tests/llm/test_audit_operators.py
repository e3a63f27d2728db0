"""The audits of filters and of sources, against plain restatements over odd rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from leadloom.llm import filter_audit, source_divergence, term_matrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def random_text(random):
    vocabulary = [f"w{i}" for i in range(int(random.choice([5, 300])))] + ["ÄÖ", "ABC", "a\x0bb", "x\x85y", "p q", "\x1c"]
    words = random.choice(vocabulary, int(random.choice([0, 1, 50, 199, 200, 400]))).tolist()
    return str(random.choice([" ", "\n", "\t \r"])).join(words) + str(random.choice(["", "$", " "]))


@pytest.fixture(scope="module")
def documents(spark):
    random = np.random.default_rng(3)
    rows = [(i, random_text(random), str(random.choice(["en", "de"]))) for i in range(120)]
    rows += [(200 + i, rows[i % 9][1], "en") for i in range(60)] + [(3, rows[3][1], "de"), (3, rows[4][1], "en"), (50, "", "en")]
    rows += [(None, rows[0][1], "en"), (None, None, None), (301, None, ""), (302, "", None), (303, "the $ word " * 200_000, "fr")]
    labels = [(i, int(random.integers(0, 2)), int(random.integers(0, 2))) for i in range(0, 260, 2)]
    labels += [(2, 1, None), (2, 0, 1), (4, None, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({"part": F.lit("clash"), "digest": F.lit(1), "shard": F.lit("x"), "n": F.lit("y"), "quality": F.lit("z")})
    return rows, docs.repartition(5), labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = ""
        fails += "A" if len(words) < 200 else ""
        fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and i > least[t] else ""
        parts[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                kept = removed = redundant = unique = g = x = 0
                for fails, is_good, is_toxic in docs:
                    earlier = any(o in fails for o in order[: step - 1])
                    kept += not earlier and own not in fails
                    unique += fails == own
                    redundant += earlier and own in fails
                    if not earlier and own in fails:
                        removed, g, x = removed + 1, g + is_good, x + is_toxic
                out[part, order, step] = (kept, removed, redundant, unique, g, x)
                shapley[part, own] += removed
    return {(part, order, step): (*v, shapley[part, order[step - 1]]) for (part, order, step), v in out.items()}


def test_filter_audit_of_odd_rows(documents):
    rows, docs, labels, marks = documents
    audit = filter_audit.audit_filters(docs, marks)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.collect()}
    assert got == plain_audit(rows, labels) and audit.count() == len(got)
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
    unlabelled = filter_audit.audit_filters(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert unlabelled[0] == unlabelled[1] == 0 < unlabelled[2]


@pytest.mark.parametrize("size", [32_000_000, 500])
def test_matrix_rows_are_the_words_of_documents(spark, documents, monkeypatch, size):
    monkeypatch.setattr(term_matrix, "SHARD_BYTES", size)
    rows, docs, *_ = documents
    few = docs.where("doc_id < 303").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    local = term_matrix.shards(few, lambda batch: {"doc_id": batch.column("doc_id")}, "doc_id bigint")
    numbered = term_matrix.number_words(local)
    known = {r.term: r.word for r in numbered.where("word is not null").collect()}
    assert len(known) == len(set(known.values())) == numbered.select("term").distinct().count()
    encoded = term_matrix.encoded_rows(local, numbered, "doc_id bigint", term_matrix.term_lists, "terms array<bigint>, counts array<bigint>")
    got = sorted((r.doc_id, sorted((known[t], n) for t, n in zip(r.terms, r.counts))) for r in encoded.collect())
    assert got == sorted((i, sorted(Counter(WORDS.findall(t or "")).items())) for i, t, _ in rows if i is not None and i < 303)


def test_shards_are_put_together_from_small_parts(spark):
    random = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{n}" for n in random.integers(0, 900, 40_000))) for i in range(40)] + [(40, ""), (41, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def attributes(batch):
        text = batch.column("text")
        return {"doc_id": batch.column("doc_id"), "part": [pc.sum(pc.binary_length(text)).as_py()] * len(text), "batch": [text.buffers()[2].size] * len(text)}

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    local = term_matrix.shards(docs, attributes, "doc_id bigint, part bigint, batch bigint")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    shard = local.collect()
    assert len(shard) == 1 and sorted(shard[0].words) == sorted({w for _, t in rows for w in t.split()})
    assert max(shard[0].part) <= 1_000_000 < sum(len(t) for _, t in rows) and max(shard[0].batch) < 5_000_000
    numbered = term_matrix.number_words(local)
    known = {r.term: r.word for r in numbered.where("word is not null").collect()}
    encoded = term_matrix.encoded_rows(local.drop("part", "batch"), numbered, "doc_id bigint", term_matrix.term_lists, "terms array<bigint>, counts array<bigint>")
    got = {r.doc_id: {known[t]: n for t, n in zip(r.terms, r.counts)} for r in encoded.collect()}
    assert got == {i: dict(Counter(t.split())) for i, t in rows}


def test_local_matrix_of_parts_of_an_array():
    texts = pa.array(["skip", "  B a b\x0ba ", "", "é-É Z", "z"]).slice(1, 3)
    words, indptr, codes, counts = term_matrix.local_matrix(texts, source_divergence.FOLD)
    own = [{words[c].as_py(): int(n) for c, n in zip(codes[a:b], counts[a:b])} for a, b in zip(indptr, indptr[1:])]
    assert own == [{"b": 2, "a": 2}, {}, {"é": 1, "É": 1, "z": 1}]
    assert len(term_matrix.local_matrix(texts.slice(0, 0))[0]) == 0 and term_matrix.local_matrix(texts.slice(1, 1))[1].tolist() == [0, 0]


def plain_divergence(rows, least=10, ranks=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", TERMS.findall((text or "").translate(fold))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, words in own for t in set(words))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            counts[s].update(w for w in words if held[w] >= least)
        counts[None] = sum(counts.values(), Counter())
        v = len(kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            if s is not None:
                pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o not in (s, None)]
                terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
                for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                    order = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
                    out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(spark):
    random = np.random.default_rng(9)
    vocabulary = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "日本", "z\U0001F642", "delta9delta", "_eta", "theta"] + [f"t{chr(97 + i)}" for i in range(20)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda: " ".join(random.choice(vocabulary, int(random.integers(0, 30)), p=weights / weights.sum()))
    names = ["s1", "s2", "s3:x", "Ünï", "hot"]
    rows = [(str(random.choice(["en", "x:y"])), str(random.choice(names, p=[0.2, 0.1, 0.1, 0.1, 0.5])), text()) for _ in range(150)]
    rows += [("en", "silent", None), ("en", "silent", "12 34"), ("rare", "a", "one word"), ("rare", "b", None), ("lone", "a", "w " * 5)]
    rows += [(None, None, text()) for _ in range(25)] + [("", "", text()), ("", "s1", text()), ("en", "s1", "alpha " * 50_000)] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return rows, docs.withColumns({c: F.lit("clash") for c in ("term", "n", "group", "place", "p", "path", "total")})


@pytest.mark.parametrize("pairs, sums", [(200_000, 1_000_000), (5, 3)])
def test_source_divergence_of_odd_rows(sourced, monkeypatch, pairs, sums):
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    monkeypatch.setattr(source_divergence, "SUMS", sums)
    rows, docs = sourced
    got = source_divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)
    assert source_divergence.source_divergence(docs.limit(0)).count() == 0


def test_portions_of_very_large_counts(spark):
    df = spark.createDataFrame([(10**15 + 7, 3 * 10**16 + 11, 10**9)], "n long, total long, v long")
    got = df.select(source_divergence.portion(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**15 + 9) // (3 * 10**16 + 11 + 2 * 10**9)
