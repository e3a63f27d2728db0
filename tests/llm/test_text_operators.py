"""Operators on single documents and pages, against plain restatements, with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import (
    bpe_automaton, decontamination, html_main_text, language_id, license_scan, quality_knn, token_counts, token_files,
)
from leadloom.llm.chunk_encoder import ChunkEncoder, tokenizer_path
from leadloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LONG = "the thha ndre. Oroned, &&& 12 été naïve\n" * 20_000
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "the cat sat\non the mat"), (4, "the cat sat\non the mat"), (5, "a<|endoftext|>b  <|startoftext|>"),
    (6, LONG), (None, "Released under the MIT License."), (7, "x \x85 y \x1c z\0   q"), (8, "ΣΑΣ İstanbul 日本 🙂🙂 é ́x ½ it's THEY'LL"),
    (9, "aaaaaaaaaaaaa !!!!!!!!! hahahaha " * 3), (10, "### $$$ 123 ½"),
]
CLASHING = "part int, place long, ids string, n_tokens string, score string, sections string, held_out string, key long, labels string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, kind in (c.split() for c in CLASHING.split(", ")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def words_file():
    return Tokenizer.from_file(tokenizer_path(None, "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bytes_file():
    return Tokenizer.from_file(tokenizer_path(None, "byte_bpe_50k.json"))


def test_bpe_query_equals_the_library(spark, documents, words_file):
    for r in QUERIES["op3_bpe"](spark, SF_DIR).collect():
        ids = words_file.encode(documents[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = words_file.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_of_odd_rows(odd, words_file):
    encoded = bpe_automaton.encode_documents(odd)
    got = sorted((r.doc_id or 0, r.ids) for r in encoded.collect())
    expected = sorted((i or 0, words_file.encode(t or "", add_special_tokens=False).ids) for i, t in ODD)
    assert got == expected
    texts = sorted((r.doc_id or 0, r.text) for r in bpe_automaton.decode_documents(encoded).collect())
    assert texts == sorted((i, words_file.decode(ids, skip_special_tokens=False)) for i, ids in expected)
    assert bpe_automaton.round_trip_digests(odd.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["aaaa", "aaaaaaaaaaaaaaaaaaa", "abababab", "hahahahaha", "thethethe", "bookkeeper", "mississippi"])
def test_automaton_on_repeating_words(words_file, word):
    own = bpe_automaton.word_encoder(tokenizer_path(None, "word_bpe_49k.json"))
    for n in range(1, len(word) + 1):
        assert own.encode_piece(word[:n]) == words_file.encode(word[:n], add_special_tokens=False).ids


def test_gadgets_follow_merge_order():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "bc", "ab", "abc"])}
    own = bpe_automaton.Automaton(vocab, [("b", "c"), ("a", "b"), ("a", "bc")])
    label = lambda w: [own.label[i] for i in own.encode(w)]
    assert label("abc") == ["abc"] and label("abbc") == ["ab", "bc"] and label("ab") == ["ab"] and label("cab") == ["c", "ab"]


def expected_files(rows, tokenizer):
    start, out = 0, []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file_query_equals_the_library(spark, documents, bytes_file):
    got = sorted(map(tuple, QUERIES["op10_token_files"](spark, SF_DIR).collect()))
    assert got == expected_files(sorted(documents.items()), bytes_file)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_of_odd_rows(spark, odd, bytes_file, tmp_path, encoding):
    token_files.write_token_files(odd, str(tmp_path / "t"), encoding=encoding)
    rows = token_files.read_token_files(spark, str(tmp_path / "t"))
    got = sorted(map(tuple, token_files.id_checksums(rows).collect()), key=lambda r: r[1])
    assert got == expected_files(sorted(ODD, key=lambda r: (r[0] or 0)), bytes_file)
    few = token_files.read_token_files(spark, str(tmp_path / "t"), 4, 6)
    assert sorted(r.doc_id for r in few.collect()) == [4, 4, 5, 6]
    plan = few.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0] and "GreaterThanOrEqual(doc_id,4)" in plan


def test_plain_chunks_go_to_the_model(bytes_file, monkeypatch, tmp_path):
    random = np.random.default_rng(7)
    pieces = ["a", "Zed", "don't", ".", ",", "'", "'ll", "é", "Àß", "ñß.", "ƀɏ*", "×", "÷", "ÿĀ", "ª", "é́", " ", "  ", "\n", "\t", "9", "x~`", "\x7f", "\xa0",
              "<|endoftext|>", "<|", "|>", "endoftext", "_", "\0", "日", "!?", "cat", "Ġ"]
    texts = ["".join(random.choice(pieces, int(random.integers(0, 30)))) for _ in range(3000)]
    apart, whole = [], ChunkEncoder._encode_apart
    monkeypatch.setattr(ChunkEncoder, "_encode_apart", lambda self, chunks: apart.extend(chunks) or whole(self, chunks))

    def encoded(path, of=texts):
        ids, counts = ChunkEncoder(path).encode(of)
        own = Tokenizer.from_file(path)
        want = [e.ids for e in own.encode_batch(of, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    encoded(tokenizer_path(None, "byte_bpe_50k.json"))
    apart.clear()
    encoded(tokenizer_path(None, "byte_bpe_50k.json"), ["one two, three. Été ñandú!! don't 9th 日本 Μ a.\nB x"])
    assert apart == [" don't", " 9th", " 日本", " Μ", " a.\nB"]
    # A file that takes letters for a token of their own goes through the library alone.
    other = Tokenizer.from_str(bytes_file.to_str())
    other.add_tokens(["cat"])
    other.save(str(tmp_path / "other.json"))
    encoded(str(tmp_path / "other.json"), [t.replace("\0", "") for t in texts])
    assert not ChunkEncoder(str(tmp_path / "other.json")).direct


def test_token_files_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 40_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    seen = tmp_path / "seen"
    seen.mkdir()
    slices = token_files.slices

    def recorded(batch):
        (seen / f"{batch.num_rows}").touch()
        return slices(batch)

    monkeypatch.setattr(token_files, "slices", recorded)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    token_files.write_token_files(docs, str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    assert max(int(p.name) for p in seen.iterdir()) * 200_000 < 5_000_000
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 60


def test_token_files_of_nothing(spark, odd, tmp_path):
    token_files.write_token_files(odd.limit(0), str(tmp_path / "t"))
    assert token_files.id_checksums(token_files.read_token_files(spark, str(tmp_path / "t"))).count() == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(odd, str(tmp_path / "u"), encoding="other")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_odd_rows(odd, bytes_file, rule):
    few = odd.where("doc_id is null or doc_id <> 6")
    got = token_counts.token_counts(few, token_counts.lines(F.col("text")), rule).collect()
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    for i, text in ODD:
        if i != 6:
            copies = sum(1 for j, _ in ODD if j == i)
            assert totals[i] == pytest.approx(copies * len(bytes_file.encode(text or "", add_special_tokens=False).ids))


def test_crossing_tokens(spark, bytes_file):
    df = spark.createDataFrame([(1, "th", "eatre"), (2, None, "a")], "doc_id long, x string, y string")
    fields = token_counts.fields("x", "y", separator="")
    tokens = [t.replace("Ġ", " ") for t in bytes_file.encode("theatre", add_special_tokens=False).tokens]
    assert tokens == ["the", "atre"]
    by = {rule: [(r.n_tokens, r.n_crossing) for r in token_counts.token_counts(df.limit(1), fields, rule).orderBy("section").collect()]
          for rule in token_counts.RULES}
    assert by["start"] == [(1.0, 1), (1.0, 0)]
    assert by["majority"] == [(1.0, 1), (1.0, 0)]
    assert by["split"] == [(pytest.approx(2 / 3), 1), (pytest.approx(4 / 3), 1)]
    assert token_counts.token_counts(df.where("doc_id = 2"), fields).orderBy("section").first().n_tokens == 0


def test_token_counts_by_offsets(spark, documents, bytes_file):
    got = {(r.doc_id, r.section): r.n_tokens for r in QUERIES["op2_token_counts"](spark, SF_DIR).collect()}
    for doc_id in sorted(documents)[:40]:
        text = documents[doc_id]
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        starts = [s for s in starts if s < len(text)] or [0]
        counts = [0] * len(starts)
        for a, _ in bytes_file.encode(text, add_special_tokens=False).offsets:
            counts[int(np.searchsorted(starts, a, side="right")) - 1] += 1
        assert [got[doc_id, k] for k in range(len(starts))] == counts


def plain_attribution(token_bytes, sizes, rule):
    """Tokens of each section of one text, a token and a byte at a time."""
    owner = [k for k, n in enumerate(sizes) for _ in range(n)]
    tokens, crossing, at = [0.0] * len(sizes), [0] * len(sizes), 0
    for n in token_bytes:
        over = owner[at : at + n]
        at += n
        own = sorted(set(over))
        if len(own) == 1:
            tokens[own[0]] += 1
        elif rule == "split":
            for k in own:
                tokens[k] += over.count(k) / n
                crossing[k] += 1
        else:
            k = own[0] if rule == "start" else max(own, key=lambda k: (over.count(k), -k))
            tokens[k] += 1
            crossing[k] += 1
    return tokens, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_a_plain_loop(rule):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = [rng.integers(0, 4, rng.integers(1, 30)).tolist() for _ in range(4)]
        cuts = [sorted({0, *(int(c) for c in rng.integers(0, sum(s) + 1, 6)), sum(s)}) for s in sizes]
        tokens = [np.diff(c).tolist() for c in cuts]
        got = token_counts.attribute(np.array([b for t in tokens for b in t], np.int64), np.array([len(t) for t in tokens]),
                                     pa.array(range(4)), pa.array(sizes, pa.list_(pa.int64())), rule)
        expected = [plain_attribution(t, s, rule) for t, s in zip(tokens, sizes)]
        assert got["n_tokens"].tolist() == pytest.approx([n for t, _ in expected for n in t])
        assert got["n_crossing"].tolist() == [n for _, c in expected for n in c]


def test_token_counts_of_blank_lines(spark, bytes_file):
    import time

    text = ("\n" * 7 + "a") * 500_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    total = token_counts.token_counts(df, token_counts.lines(F.col("text")), "majority").agg(F.sum("n_tokens")).first()[0]
    assert time.perf_counter() - start < 60
    assert total == len(bytes_file.encode(text, add_special_tokens=False).ids)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def base_places(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(found)


def check_licenses(rows, texts):
    for r in rows:
        n, found = base_places(texts[r.doc_id])
        places = [i for i, _ in found]
        labels = ",".join(sorted({label for _, label in found}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            n, len(found), min(places, default=None), max(places, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)


def test_notice_altered_in_its_rare_words():
    notice = next(t for t in license_scan.TEMPLATES if t.label == "bsd").text
    rare = [b"provided", b"conditions", b"permitted"]
    index = license_scan.Index(license_scan.TEMPLATES, {w: 9.0 for w in rare})
    altered = notice.replace("provided", "xx").replace("conditions", "yy").replace("permitted", "zz")
    labels = lambda text: {license_scan.TEMPLATES[t].label for t in index.find(license_scan.words_of(text))}
    assert labels(altered) == labels(altered + " and far away words were provided under conditions permitted") == {"bsd"}
    assert labels(altered.replace("source and binary", "text or binary")) == set()


def every_start(words):
    """Labels by trying every template at every start, word by word."""
    out, drift = set(), license_scan.DRIFT
    for t in license_scan.TEMPLATES:
        own, keys = license_scan.words_of(t.text), [license_scan.words_of(k) for k in t.keys]
        for start in range(-len(own), len(words) + 1):
            if t.base:
                if start >= 0 and words[start : start + len(own)] == own:
                    out.add(t.label)
                continue
            near = lambda i: words[max(0, i - drift) : max(0, i + drift + 1)]
            if sum(w in near(start + p) for p, w in enumerate(own)) < license_scan.COVERAGE * len(own):
                continue
            places = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
            if all(any(words[i : i + len(k)] == k for i in range(max(0, start + p - drift), max(0, start + p + drift + 1)))
                   for k, p in zip(keys, places)):
                out.add(t.label)
    return out


def test_labels_equal_every_start():
    rng, index = np.random.default_rng(11), license_scan.Index(license_scan.TEMPLATES, {})
    seen = set()
    for _ in range(400):
        words = []
        for _ in range(rng.integers(1, 4)):
            own = license_scan.words_of(license_scan.TEMPLATES[rng.integers(len(license_scan.TEMPLATES))].text)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(len(own)))
                own = [own[:at] + [b"other"] + own[at + 1 :], own[:at] + own[at + 1 :], own[:at] + [b"more"] + own[at:]][rng.integers(3)] or [b"x"]
            words += own + [b"filler"] * int(rng.integers(0, 5))
        got = {license_scan.TEMPLATES[t].label for t in index.find(words)}
        assert got == every_start(words)
        seen |= got
    assert len(seen) > 12


def test_license_query(spark, documents):
    check_licenses(QUERIES["op1_license_scan"](spark, SF_DIR).collect(), documents)


def test_licenses_in_odd_rows(spark, odd):
    check_licenses(license_scan.scan_licenses(odd).collect(), dict(ODD))
    texts = {
        1: "MIT-License mit license; the Apache\nLICENSE, general public license general PUBLIC  license" * 3,
        2: "license mit general public licence apache", 3: "été MIT éLicense mit license", 4: "mit " * 500 + "license " * 500,
    }
    check_licenses(license_scan.scan_licenses(frame(spark, list(texts.items()))).collect(), texts)
    notice = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    row = license_scan.scan_licenses(frame(spark, [(1, notice), (2, "Redistribution and use of source and binary forms")])).orderBy("doc_id").collect()
    assert row[0].labels == "apache,apache-2.0,apache-2.0-notice" and row[1].labels == ""
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


PAGES = {
    "": "", "<p>a": "a", "<div id=content><p>Hello &amp; long text of a page that goes on.</p><p>Second</p></div><div class='sidebar'>x</div><div id='comments'>c</div>":
        "Hello & long text of a page that goes on. Second",
    "<body><nav>m<article><h1>T</h1><p>Long text here</article><footer>f": "T Long text here",
    "<p>one <b>two</b>three\n\n four<br>five</p><form><p>x</p></form>": "one twothree four five",
    "<main><div class='cookie-notice'>n</div><section><p>a b</p></section><aside>z</aside></main>": "a b",
    "x<script>var a='<p>no</p>'": "x", "<div>" * 2000 + "deep": "deep",
    "<article><p>Body text</p></article><section id=comments><article class=comment><p>Reader says a lot of words here</p></article></section>": "Body text",
    "<!-- c --><style>p{}</style><noscript>n</noscript>": "",
}


def test_main_text_of_odd_pages(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_main_text.extract_main_text(df).collect()}
    for i, text in enumerate(PAGES.values()):
        assert got[i] == (text, len(text))
    assert got[99] == ("", 0) and html_main_text.extract_main_text(df.limit(0)).count() == 0
    twice = df.unionByName(df).withColumn("n_chars", F.lit("clash")).withColumn("label", F.lit(1)).where("page_id in (0, 99)")
    rows = sorted((r.page_id, r.url, r.text) for r in html_main_text.extract_main_text(twice).collect())
    assert rows == sorted([(0, "u0", got[0][0]), (99, None, "")] * 2, key=lambda r: r[0])


LONG_TEXT = "one long paragraph of plain words about a river and its banks " * 8
KEPT_PAGES = {  # what a page must keep, whole and in order
    f"<body><div>Short one.</div><div>{LONG_TEXT}</div><div>Short two.</div></body>": f"Short one. {LONG_TEXT}Short two.",
    f'<body><div class="layout has-sidebar"><div><p>{LONG_TEXT}</p><p>End.</p></div></div></body>': f"{LONG_TEXT}End.",
    f"<body><article><p>{LONG_TEXT}</p></article><article><p>Second.</p></article></body>": f"{LONG_TEXT}Second.",
    f'<body><article><p>{LONG_TEXT}</p><ul class="ad-hoc"><li>point</li></ul></article></body>': f"{LONG_TEXT}point",
    f'<body><div class="sidebar"><p>{LONG_TEXT}</p></div><div class="footer">x</div></body>': LONG_TEXT,
    f'<body><form id="page"><div><p>{LONG_TEXT}</p></div></form></body>': LONG_TEXT,
    f'<body><article><p>Text.</p></article><div class="comment-list"><p>{LONG_TEXT}</p></div></body>': "Text.",
    f'<body><article><p>Text.</p></article><article class="comment"><p>{LONG_TEXT}</p></article></body>': "Text.",
    f'<body><div><a href="/a">Home</a> <a href="/b">News</a></div><div><p>{LONG_TEXT}</p></div><div class="site-footer">c</div></body>': LONG_TEXT,
    f'<body><div>{LONG_TEXT}</div><div><a href="/s">Source</a></div><div>{LONG_TEXT}</div></body>': f"{LONG_TEXT}Source {LONG_TEXT}",
    f'<body><div>{LONG_TEXT}</div><div>Search <input><button>Go</button></div></body>': LONG_TEXT,
}


@pytest.mark.parametrize("number", range(len(KEPT_PAGES)))
def test_main_text_drops_nothing_else(number):
    html, text = list(KEPT_PAGES.items())[number]
    assert html_main_text.main_text(html) == text.strip()


def plain_regions(divs):
    """A restatement for pages of plain divisions, given as ``(text, in links)``: ratios, smoothing and clusters by hand."""
    ratios = [len(t) / (1 + (i > 0) + 2 * linked) for i, (t, linked) in enumerate(divs)]
    weight = lambda k: np.exp(-k * k / 2)
    near = [[j for j in range(len(divs)) if abs(i - j) <= 2] for i in range(len(divs))]
    smooth = [sum(weight(i - j) * ratios[j] for j in own) / sum(weight(i - j) for j in own) for i, own in enumerate(near)]
    cut, upper = (min(smooth) + max(smooth)) / 2, None
    for _ in range(50):
        upper = [v >= cut for v in smooth]
        groups = [[v for v, u in zip(smooth, upper) if u == side] for side in (True, False)]
        if not all(groups) or abs(cut - sum(np.mean(g) for g in groups) / 2) < 1e-9:
            break
        cut = sum(np.mean(g) for g in groups) / 2
    chosen = [v >= cut or not linked for v, (_, linked) in zip(smooth, divs)]
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    return " ".join(t for i, (t, _) in enumerate(divs) if first <= i <= last)


def test_main_text_of_unmarked_pages_equals_a_restatement():
    rng = np.random.default_rng(3)
    for _ in range(200):
        divs = [("w" + "o" * int(rng.choice([3, 12, 80, 400])), bool(rng.random() < 0.4)) for _ in range(rng.integers(1, 12))]
        page = "".join(f'<div><a href="/x">{t}</a></div>' if linked else f"<div>{t}</div>" for t, linked in divs)
        assert html_main_text.main_text(page) == plain_regions(divs)


@pytest.mark.parametrize("page", ["<div><p>word" * 50_000, "<div>word</b></i>" * 34_000, "<article>word</article>" * 50_000,
                                  '<div class="ad"><a href="/x">w' * 34_000, "<nav>" * 100_000 + "<article>word</article>"])
def test_main_text_of_a_hundred_thousand_tags(page):
    import time

    start = time.process_time()
    html_main_text.main_text(page)
    assert time.process_time() - start < 8


def test_main_text_query(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in QUERIES["op7_main_text"](spark, SF_DIR).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        article = re.sub("<[^>]+>", "", re.sub("</?(p|h1|br)>", " ", article))
        assert r.text == " ".join(html.unescape(article).split()) and r.n_chars == len(r.text)


def test_close_languages_and_no_learned_language_keep_readable_rows(spark):
    df = frame(spark, [(1, "mellan two språk"), (2, "123 ###"), (3, None)])
    nothing = (np.zeros(language_id.HASHED, np.float32), 0.0)
    close = language_id.Model(["a", "b"], {"a": ["x", "y"], "b": ["z"]}, [nothing, nothing], {("x", "y"): nothing})
    assert close.predict(["mellan two språk"])[1][0] == 0.25
    for model in (close, language_id.Model()):
        assert [r.doc_id for r in language_id.keep_identified(df, model).collect()] == [1]


def test_votes_of_language_machines_equal_a_plain_loop():
    rng = np.random.default_rng(8)
    machine = lambda: (rng.normal(size=language_id.HASHED).astype(np.float32), float(rng.normal()))
    members = {"a": ["a1", "a2", "a3", "a4"], "b": ["b1"], "c": ["c1", "c2"]}
    pairs = {(x, y): machine() for own in members.values() for i, x in enumerate(own) for y in own[i + 1 :]}
    model = language_id.Model(list(members), members, [machine() for _ in members], pairs)
    texts = ["".join(rng.choice(list("abcdefgh  "), 60)) + "a" for _ in range(80)]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        row = language_id.features([text])[0]
        margins = [float(row @ w + b) for w, b in model.family_machines]
        family = members[model.families[int(np.argmax(margins))]]
        votes, least = dict.fromkeys(family, 0), dict.fromkeys(family, np.inf)
        for (x, y), (w, b) in pairs.items():
            if x in family:
                margin = float(row @ w + b)
                votes[x if margin >= 0 else y] += 1
                least[x], least[y] = min(least[x], margin), min(least[y], -margin)
        best = max(family, key=lambda lang: (votes[lang], least[lang]))
        sure = 1 / (1 + np.exp(-language_id.SHARPNESS * (sorted(margins)[-1] - sorted(margins)[-2])))
        inner = 1 / (1 + np.exp(-language_id.SHARPNESS * least[best])) if len(family) > 1 else 1
        assert name == best and score == pytest.approx(sure * inner, rel=1e-4)


def test_equal_votes_go_to_the_larger_least_margin():
    machine = lambda bias: (np.zeros(language_id.HASHED, np.float32), bias)
    pairs = {("x", "y"): machine(1.0), ("x", "z"): machine(-3.0), ("y", "z"): machine(2.0)}  # one vote each
    model = language_id.Model(["f"], {"f": ["x", "y", "z"]}, [], pairs)
    assert model.predict(["word"])[0] == ["y"]


def test_every_language_is_learned_and_null_ones_are_filled(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FITTED", 26 * 8)
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i % 26) * 4}", f"l{i % 26}") for i in range(1040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert sorted(x for own in model.members.values() for x in own) == sorted({lang for *_, lang in rows})
    odd = [(1, "aaa aaaa", None), (2, "bbb bbbb", "kept"), (3, None, None), (4, "##", None)]
    kept = language_id.keep_identified(spark.createDataFrame(odd, df.schema), model)
    assert sorted(map(tuple, kept.collect())) == [(1, "aaa aaaa", "l0"), (2, "bbb bbbb", "kept")]


def test_language_query_and_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op6_language_id"](spark, SF_DIR).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify_language(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 10)) and got[4].lang_pred == "en"
    assert {r.doc_id for r in language_id.keep_identified(odd, model).collect()}.isdisjoint({1, 2, 3, 10})
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify_language(odd, empty).collect()} == {"und"}
    assert language_id.identify_language(odd.limit(0), model).count() == 0
    single = language_id.fit(docs.where("lang = 'fr'"))
    assert single.predict(["mot", ""])[0] == ["fr", "und"]


def test_quality_query_and_odd_rows(spark, odd):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    got = quality_knn.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_knn.score_quality(odd, quality_knn.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_knn.keep_good(odd.limit(0), model).count() == 0 and quality_knn.keep_good(odd, model).columns == odd.columns


def plain_distance(item, text):
    rows = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(rows[j] + 1, new[-1] + 1, rows[j - 1] + (a != b)))
        rows = new
    return min(rows)


def test_bit_vector_distance():
    random = np.random.default_rng(3)
    for _ in range(200):
        item, text = random.integers(0, 4, random.integers(1, 12)).tolist(), random.integers(0, 4, random.integers(0, 20)).tolist()
        assert decontamination.best_match(item, text)[0] == plain_distance(item, text)


def test_quality_scores_equal_sorted_cosines():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc ABC.,123\n"), int(rng.integers(1, 300)))) for _ in range(120)]
    model = quality_knn.fit_rows(quality_knn.features(texts[:90]), (rng.random(90) < 0.5).astype(float))
    scores = model.scores(texts)
    for text, score in zip(texts, scores):
        own = model.latent(quality_knn.features([text]))[0]
        cosines = [float(own @ v) for v in model.vectors]
        near = sorted(range(90), key=lambda i: -cosines[i])[: quality_knn.NEIGHBOURS]
        weights = [max(cosines[i], 0) ** quality_knn.POWER + 1e-9 for i in near]
        assert score == pytest.approx(sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights), abs=1e-3)


def test_equal_neighbours_and_several_labels_of_one_id(spark):
    rows = quality_knn.features(["same text here"] * 30)
    labels = np.array([1.0] * 25 + [0.0] * 5)
    assert quality_knn.fit_rows(rows, labels).scores(["same text here"])[0] == 1.0  # ties: the earlier in order
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 40)], "doc_id long, text string")
    both = spark.createDataFrame([(i, q) for i in range(1, 40) for q in (0, 1)], "doc_id long, quality int")
    fitted = quality_knn.fit(docs, both)
    assert sorted(fitted.labels) == [0.0] * (len(fitted.labels) // 2) + [1.0] * (len(fitted.labels) // 2)


def test_decontamination_finds_edited_passages(spark, documents):
    random = np.random.default_rng(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    fillers = [t for t in documents.values() if 500 < len(t) < 3000]
    rows, wanted = [], set()
    for k, (item, text) in enumerate(items):
        words = text.split()
        for _ in range(int(0.1 * len(words))):
            words[int(random.integers(len(words)))] = "changed"
        rows.append((k, f"{fillers[k % len(fillers)]} {' '.join(words)} {fillers[(k + 1) % len(fillers)]}"))
        wanted.add((k, item))
    bench = spark.createDataFrame([*items, (None, "a b c"), (900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert len(wanted - got) <= 0.02 * len(wanted)
    assert decontamination.contaminated(frame(spark, ODD), bench.limit(0)).count() == 0
    assert decontamination.contaminated(frame(spark, ODD), bench).count() == 0
    assert decontamination.keep_clean(frame(spark, ODD), bench).count() == len(ODD)


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
@pytest.mark.parametrize("length", [8, 30, 60, 150])
def test_decontamination_recall_at_the_limit(kind, length):
    random = np.random.default_rng(length)
    vocabulary, weights = [f"w{i}" for i in range(3000)], 1 / np.arange(1, 3001)  # common words repeat within items
    draw = lambda n: random.choice(vocabulary, n, p=weights / weights.sum()).tolist()
    items = [(k, " ".join(draw(length))) for k in range(150)]
    index = decontamination.Index(items)
    texts = []
    for _, text in items:
        words = text.split()
        for at in sorted(random.choice(length, length // 5, replace=False).tolist(), reverse=True):
            words[at : at + (kind != "insert")] = [] if kind == "delete" else ["other"]
        texts.append(" ".join([*draw(40), *words, *draw(40)]))
    found = {(t, item) for t, item, *_ in index.matches(texts)}
    assert index.recall >= decontamination.TARGET
    assert np.mean([(k, k) in found for k in range(len(items))]) >= 0.98


def test_decontamination_query_against_every_window(spark, documents):
    items = {r.item_id: base_words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op5_decontamination"](spark, SF_DIR).collect()}
    for doc_id in sorted(documents)[:60]:
        text = base_words(documents[doc_id])
        for item, words in items.items():
            if len(set(words) & set(text)) >= 0.8 * len(set(words)):
                edits = decontamination.best_match(words, text)[0]
                assert ((doc_id, item) in got) == (edits <= int(0.2 * len(words)))
                assert got.get((doc_id, item), edits) == edits


def base_words(text):
    return license_scan.words_of(text or "")
