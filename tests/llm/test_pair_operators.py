"""Operators on pairs of documents or vectors, and the pipeline, against brute force."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import embedding_dedup, language_id, near_dedup, quality_knn
from leadloom.llm.common import BATCH, SLICE_ROWS, slices
from leadloom.llm.components import connected_components
from leadloom.llm.license_scan import words_of
from leadloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def classes_of(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def shingles(text):
    words = words_of(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows, similar=0.8):
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    return {rows[i][0]: rows[c][0] for i, c in enumerate(classes_of(len(rows), links))}


def test_components(spark):
    random = np.random.default_rng(1)
    pairs = random.integers(0, 400, (260, 2)).tolist() + [[i, i + 1] for i in range(500, 560)] + [[600, k] for k in range(601, 660)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = classes_of(700, pairs)
    assert got == {i: c for i, c in enumerate(roots) if any(i in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_mixed_rows(spark):
    random = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, next_id = [], 0
    for size in (1, 1, 2, 3, 5, 8, 20):
        for _ in range(4):
            words = random.choice(vocabulary, int(random.integers(60, 400))).tolist()
            for _ in range(size):
                edited = list(words)
                for _ in range(int(random.integers(0, 1 + len(words) // 60))):
                    edited[int(random.integers(len(words)))] = str(random.choice(vocabulary))
                rows.append((next_id, " ".join(edited)))
                next_id += 1
    rows += [(next_id + k, t) for k, t in enumerate(["short text", "Short, TEXT!", "", None, "  ", "one"])]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    df = df.withColumn("a", F.lit("clash")).withColumn("bands", F.lit(1)).withColumn("class_id", F.lit(2))
    got = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(rows)
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_classes(rows).values()) | {None}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1024, 37])
def test_copies_that_resemble_only_their_original(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk, raising=False)
    random = np.random.default_rng(11)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for group in range(2):
        words = random.choice(vocabulary, 400).tolist()
        for k in range(300):  # all lower ids than the original's
            edited = list(words)
            for at in random.choice(400, 8, replace=False):
                edited[int(at)] = str(random.choice(vocabulary))
            rows.append((group * 1000 + k, " ".join(edited)))
        rows.append((group * 1000 + 999, " ".join(words)))
    expected = brute_classes(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == expected


def test_repeated_ids_are_copies(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in near_dedup.keep_first(df).collect()) == [1, 3]


def test_different_texts_of_one_id_are_classed_apart(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, b), (2, a), (3, b + " u"), (4, None), (4, ""), (4, ""), (5, "x"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash")).withColumn("t2", F.lit(1))
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=key)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 5), (None, None)], key=key)
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=key) == sorted([(1, a), (1, b), (4, ""), (5, "x"), (None, a)], key=key)


def test_a_very_long_text_and_its_copy(spark):
    words = [f"w{i % 9973}x{i % 7}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["other", *words[1:]])), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_darts_estimate_weighted_similarity():
    elements = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    weights = np.array([2.5, 1, 3, 1.5, 1, 3, 2.0])
    signatures = near_dedup.dart_signatures(elements, weights, np.array([3, 4]), 20_000)
    assert (signatures[0] == signatures[1]).mean() == pytest.approx(5.5 / 8.5, abs=0.02)
    assert (near_dedup.dart_signatures(elements[:0], weights[:0], np.array([0]), 8) == 0).all()


def test_near_duplicate_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op4_near_duplicates"](spark, SF_DIR).collect()}
    assert got == brute_classes(docs)


def brute_vectors(rows):
    good = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for i in good:
        for j in good:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    links.append((i, j))
    roots = classes_of(len(rows), links)
    smallest = {}
    for i in good:
        smallest[roots[i]] = min(smallest.get(roots[i], rows[i][0]), rows[i][0])
    n = np.bincount(np.array(links, int).reshape(-1), minlength=len(rows)).tolist()
    return sorted((str(v), n[i], str(smallest.get(roots[i], v) if i in good else v)) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_duplicate_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    random = np.random.default_rng(5)
    rows, next_id = [], 0
    for size in (1, 1, 1, 2, 3, 40):
        for _ in range(3):
            centre = random.normal(size=16)
            for _ in range(size):
                rows.append((next_id, (centre + random.normal(size=16) * 0.05).astype(np.float32).tolist()))
                next_id += 1
    rows += [(next_id, rows[-1][1]), (next_id + 1, rows[-1][1]), (next_id + 2, rows[-1][1])]
    rows += [(3, rows[-1][1]), (1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16),
             (1005, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (1006, [1.0, 2.0]), (1007, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("dim", F.lit(1))
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    odd = [(1, texts[0], "en", "s", 1), (1, texts[0], "en", "s", 1), (1, texts[1], None, None, None), (2, None, None, None, None),
           (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5), (None, texts[2], None, "s", 9), (5, texts[0] + " " + texts[0], "en", "s", 2)]
    for name, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame(rows, docs.schema).withColumn("t1", F.lit("clash")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0 if name == "empty" else 1000).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, function in corpus_pipeline.STAGES[1:4]:
        kept = function(spark, kept, f"{tmp_path}/odd")
        assert kept.columns == [*docs.columns, "t1"]
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "5", "None"] and all(r.lang for r in got)
    ids = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()]
    assert set(ids) <= {1, 5, None}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    bench = [words_of(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "bpe"]
    before = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, SF_DIR)
        rows, left = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert after.columns == docs.columns and left.items() <= rows.items()
        gone = set(rows) - set(left)
        if name == "quality":
            known = [i for i in rows if i in labels]
            assert np.mean([(i in left) == labels[i] for i in known]) > 0.9
        elif name == "language":
            assert not gone
        elif name == "near_duplicates":
            assert set(left) == set(brute_classes(list(rows.items())).values())
        else:
            holds = lambda t: any(b" ".join(b) in b" ".join(words_of(t)) for b in bench)
            assert gone == {i for i, t in rows.items() if holds(t)}
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == {r.doc_id for r in before.collect()}


def test_slices_bound_rows_as_well_as_text():
    """A task's matrices have a row for each text, so very many short texts must not be taken at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(["w"] * 1000 + ["x" * 30] * 3 + [None, ""])], names=["text"])
    parts = list(slices(batch, bytes_at_once=1_000_000, rows_at_once=256))
    assert [p.num_rows for p in parts] == [256, 256, 256, 237] and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
    assert [p.num_rows for p in slices(batch.slice(999), bytes_at_once=40, rows_at_once=256)] == [2, 1, 3]
    assert [p.num_rows for p in slices(batch)] == [1005]


def test_short_documents_take_bounded_memory(monkeypatch):
    """Signatures and features of 6000 texts of a few words; 12,000 took 1.1 GB while a part was bounded by its text alone."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6000)), pa.array([f"a b c d e f {i}" for i in range(6000)]), pa.array(["en"] * 6000), *[pa.array(range(6000))] * 2],
        names=["doc_id", "text", "lang", "t1", "t2"])
    context = SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), columns=batch.schema.names, dtypes=[("lang", "string")],
                           schema=None, mapInArrow=lambda run, schema: run, select=lambda *names: docs)
    monkeypatch.setattr(near_dedup, "text_of", lambda *args: docs)
    monkeypatch.setattr(near_dedup, "_with_text_hashes", lambda rows: rows)
    monkeypatch.setattr(near_dedup.F, "col", lambda name: SimpleNamespace(cast=lambda kind: SimpleNamespace(alias=lambda name: name)))
    rows = language_id.features(["a b c", "x y z"])
    votes = quality_knn.fit_rows(quality_knn.features(["a b c", "X 1 Z"]), np.array([1.0, 1.0]))
    named = batch.rename_columns(["doc", *batch.schema.names[1:]])
    for run, given in (
        (near_dedup.fingerprints(docs, False, 24, 6), batch), (near_dedup.shingles_of(docs, False), named),
        (language_id.keep_identified(docs, language_id.fit_rows(rows, ["en", "de"])), batch), (quality_knn.keep_good(docs, votes), batch),
    ):
        tracemalloc.start()
        try:
            parts = [p.num_rows for p in run(iter([given]))]
            assert tracemalloc.get_traced_memory()[1] < 60e6
        finally:
            tracemalloc.stop()
        assert sum(parts) == 6000 and max(parts) <= SLICE_ROWS


def test_pipeline_bounds_batches_by_bytes(spark, tmp_path):
    """Batches are a few megabytes, groups stay whole however they are cut, and ``run`` restores the session."""
    key, = BATCH
    before = spark.conf.get(key, None)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plain = sorted(r.doc_id for r in near_dedup.keep_first(docs).select("doc_id").collect())
    try:
        spark.conf.set(key, "2k")  # a group's rows come in many batches
        assert sorted(r.doc_id for r in near_dedup.keep_first(docs).select("doc_id").collect()) == plain
        spark.conf.unset(key)
        for _, function in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            function(spark, docs, SF_DIR)
            long = spark.range(400).select(F.repeat(F.lit("x"), 100_000).alias("text")).coalesce(1)
            sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint")
            assert max(r.n for r in sizes.collect()) < 5_000_000
        spark.conf.set(key, "77m")
        corpus_pipeline.run(spark, SF_DIR)
        assert spark.conf.get(key) == "77m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
