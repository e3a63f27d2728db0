"""The inverted multi-index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import multi_index
from leadloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def usable(e):
    return e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)


def brute(rows, query, k=20):
    """``{(query id, vector): [(id, score), ...]}`` over all rows, each row of one id and vector once."""
    known = sorted({(v, tuple(e)) for v, e in rows if v is not None and usable(e)})
    out = {}
    for v, e in known:
        if query(v):
            near = [(-float(np.sum(np.array(e) * np.array(x))), w) for w, x in known if w != v and len(x) == len(e)]
            out[v, e] = [(w, -s) for s, w in sorted(near)[:k]]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    return got


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    vectors, expected = dict(rows), brute(rows, lambda v: v % 20 == 0)
    got = answers(QUERIES["op11_multi_index"](spark, SF_DIR))
    assert set(got) == {v for v, _ in expected}
    hits = 0
    for (v, e), near in expected.items():
        own = got[v]
        assert [r["rank"] for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        for r in own:
            assert r.score == pytest.approx(float(np.dot(vectors[v], vectors[r.vec_id])), rel=1e-12)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {w for w, _ in near})
    assert hits >= 0.9 * 20 * len(expected)


@pytest.fixture(scope="module")
def odd(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    centre = random.normal(size=8).astype(np.float32).tolist()
    rows += [(i, centre) for i in range(200, 260)]  # many copies, more than a result holds
    rows += [(i, rows[3][1]) for i in range(300, 303)] + [(5, rows[6][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(500 + i, random.normal(size=3).astype(np.float32).tolist()) for i in range(4)]  # fewer than a result holds
    rows += [(520, [2.0]), (600, None), (620, []), (640, [0.0] * 8), (660, [float("nan")] * 8), (680, [None] * 8), (700, [float("inf")] + [1.0] * 7),
             (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return rows, df.withColumn("rep", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("dim", F.lit("x"))


@pytest.mark.parametrize("block", [4096, 8])
def test_odd_vectors(odd, monkeypatch, block):
    monkeypatch.setattr(multi_index, "bounded", lambda rows, dim: block)
    rows, df = odd
    got = answers(multi_index.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0))
    expected = {v: near for (v, _), near in brute(rows, lambda v: v % 20 == 0).items()}
    assert set(got) == {v for v, near in expected.items() if near}  # 520 has nothing of its length
    exact = 0
    for v, near in expected.items():
        if near:
            assert len(got[v]) == len(near) and [r["rank"] for r in got[v]] == list(range(1, len(near) + 1))
            assert v not in [r.vec_id for r in got[v]]
            exact += [(r.vec_id, pytest.approx(r.score)) for r in got[v]] == near
    assert exact == len(got)  # all queries were measured here, so all neighbours are visited


def test_nothing_to_find(odd):
    _, df = odd
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_cells_are_visited_by_summed_distance():
    random = np.random.default_rng(2)
    book = multi_index.Codebook(random.normal(size=(300, 6)), 7)
    cells = book.cells(random.normal(size=(400, 6)))
    book.sizes = np.bincount(cells, minlength=len(book.sizes)).tolist()
    for _ in range(20):
        query = random.normal(size=6)
        a, b = book.distances(query)
        order = sorted((c for c in range(len(book.sizes)) if book.sizes[c]), key=lambda c: a[c // len(b)] + b[c % len(b)])
        book.entries = int(random.integers(1, 400))
        seen = book.visited(query)
        assert seen == order[: len(seen)]
        held = np.cumsum([book.sizes[c] for c in seen])
        assert held[-1] >= book.entries and (len(seen) == 1 or held[-2] < book.entries)
        assert book.before(query)[seen[-1]] == held[-1]


def test_blocks_hold_whole_cells_of_one_row(monkeypatch):
    monkeypatch.setattr(multi_index, "bounded", lambda rows, dim: 10)
    book = multi_index.Codebook(np.random.default_rng(1).normal(size=(200, 4)), 5)
    book.sizes = [3, 4, 2, 5, 1, 0, 25, 1, 1, 1] + [2] * 15
    block, splits = book.blocks()
    assert block[:10] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3] and splits[6] == 3 and block == sorted(block)
    assert len({b for b, s in zip(block, splits) if s > 1}) == 1


def test_rerank_equals_a_plain_loop():
    random = np.random.default_rng(7)
    entries, cells = random.normal(size=(900, 5)), random.integers(0, 40, 900)
    entries[100:140] = entries[100]  # equal scores
    ids = random.permutation(900)
    queries, visits = random.normal(size=(30, 5)), [random.choice(45, random.integers(0, 20), replace=False) for _ in range(30)]
    query, entry, score = multi_index.rerank(entries, cells, ids, queries, visits, 6)
    for q in range(30):
        able = np.flatnonzero(np.isin(cells, visits[q]))
        expected = sorted(able, key=lambda i: (-float((queries[q] * entries[i]).sum()), ids[i]))[:6]
        assert entry[query == q].tolist() == [int(i) for i in expected]
        assert score[query == q] == pytest.approx([float(queries[q] @ entries[i]) for i in expected])
