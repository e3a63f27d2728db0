"""Registered queries of the numbered operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import (
    bpe_automaton, decontamination, embedding_dedup, filter_audit, html_main_text, language_id, license_scan, multi_index,
    near_dedup, quality_knn, source_divergence, token_counts, token_files,
)
from leadloom.llm.common import table
from leadloom.session import run_folder


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.lines(F.col("text")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return bpe_automaton.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among near-duplicates."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the edits between them."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_language(docs, language_id.fit(docs))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score_quality(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    path = run_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.id_checksums(token_files.read_token_files(spark, path))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest embeddings of every twentieth one by inner product."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of a language, and the terms that set a source apart."""
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_main_text": op7_main_text,
    "op8_quality": op8_quality,
    "op9_embedding_duplicates": op9_embedding_duplicates,
    "op10_token_files": op10_token_files,
    "op11_multi_index": op11_multi_index,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

#: Check SQL by query name, for those that SQL can express.
ORACLE: dict[str, str] = {
    "op9_embedding_duplicates": """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95),
reached AS (
  SELECT vec_id AS x, vec_id AS y FROM usable
  UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x),
named AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON vec_id = counted.x LEFT JOIN named ON vec_id = named.x""",
    "op4_near_duplicates": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i : array_to_string(w[i : i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, len(s) AS n FROM sets GROUP BY list_sort(s), len(s)),
shingle AS (SELECT doc_id, n, unnest(s) AS g FROM classes),
frequency AS (SELECT g, count(*) AS f FROM shingle GROUP BY g HAVING count(*) > 1),
ranked AS (
  SELECT doc_id, n, shingle.g, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), shingle.g) AS place
  FROM shingle LEFT JOIN frequency ON shingle.g = frequency.g),
-- Sets alike to 0.8 share one of their rarest shingles, of which a fifth and one are enough to look at.
rare AS (SELECT doc_id, n, g FROM ranked WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
          WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
alike AS (
  SELECT x, y FROM pairs JOIN classes a ON a.doc_id = x JOIN classes b ON b.doc_id = y
  WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
both_ways AS (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM classes
  UNION SELECT reached.x, both_ways.y FROM reached JOIN both_ways ON reached.y = both_ways.x),
named AS (SELECT x, min(y) AS class_id FROM reached GROUP BY x)
SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id
FROM documents LEFT JOIN sets ON sets.doc_id = documents.doc_id
LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN named ON named.x = classes.doc_id""",
    "op12_filter_audit": """
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
listed AS (
  SELECT docs.doc_id, part, docs.t, coalesce(docs.doc_id > first_id, false) AS e, regexp_extract_all(docs.t, '[^\x20\x09-\x0D]+') AS w
  FROM docs JOIN firsts ON docs.t = firsts.t),
flags AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, e
  FROM listed),
counted AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN marks ON flags.doc_id = marks.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
seen AS (
  SELECT *, f[ascii(substr(filter_order, step, 1)) - 64] AS own,
         len(list_filter(range(1, step), lambda i : f[ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 64])) > 0 AS earlier
  FROM counted, orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
sums AS (
  SELECT part, filter_order, step,
         sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN own AND len(list_filter(f, lambda v : v)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY ALL),
shares AS (SELECT part, substr(filter_order, step, 1) AS letter, sum(removed) AS shapley FROM sums GROUP BY ALL)
SELECT sums.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM sums JOIN shares ON sums.part = shares.part AND letter = substr(filter_order, step, 1)""",
    "op13_source_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
used AS (SELECT words.lang, source, words.term, count(*) AS n FROM words JOIN kept ON words.lang = kept.lang AND words.term = kept.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
sources AS (
  SELECT d.lang, d.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals ON d.lang = totals.lang AND d.source = totals.source
  LEFT JOIN langs ON d.lang = langs.lang),
portions AS (
  SELECT s.lang, s.source, kept.term, coalesce(n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM sources s JOIN kept ON s.lang = kept.lang LEFT JOIN used ON s.lang = used.lang AND s.source = used.source AND kept.term = used.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM portions a JOIN portions b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM portions WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
