"""URL lists to new candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V
from leadloom.functions import urls as U
from leadloom.functions.binding import apply
from leadloom.functions.html import strip
from leadloom.functions.ids import stable_id


def parse_url_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Stripped first comma field of every non-blank line, as ``url``; other columns are kept."""
    text = strip(F.col(line))
    first = F.when(text.contains(","), strip(F.substring_index(text, ",", 1))).otherwise(text)
    others = [c for c in lines.columns if c != line]
    return lines.where(text != "").select(*others, first.alias("url"))


def combine_url_sources(*sources: DataFrame) -> DataFrame:
    """Distinct non-empty URLs of several ``(pos, url)`` lists, earlier lists first.

    Returns ``(source_rank, pos, url)`` of each URL's first occurrence; the order is in the columns.
    """
    ranked = [s.select(F.lit(i).alias("source_rank"), "pos", "url") for i, s in enumerate(sources)]
    everything = ranked[0]
    for part in ranked[1:]:
        everything = everything.unionByName(part)
    first = everything.where(F.col("url") != "").groupBy("url").agg(
        F.min(F.struct("source_rank", "pos")).alias("at")
    )
    return first.select("at.source_rank", "at.pos", "url")


def import_urls(urls: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """URLs in input order as discovery rows: all, or the first ``limit`` (0 takes all too).

    Adds to the order columns ``(raw_url, source, name_hint, discovery_metadata)``.
    """
    chosen = urls.orderBy(*order).limit(limit) if limit else urls
    return chosen.select(
        *order,
        F.col("url").alias("raw_url"),
        F.lit("url_import").alias("source"),
        F.lit(None).cast("string").alias("name_hint"),
        F.create_map().cast("map<string,string>").alias("discovery_metadata"),
    )


def new_candidates(discovered: DataFrame, known: DataFrame, now: Column, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Candidate rows for domains not in ``known(canonical_domain)``.

    The first row of a domain in input order wins. Rows whose URL yields no domain are left to the
    caller's not-null check and do not appear.
    """
    rows = discovered.withColumn("canonical_domain", U.canonical_domain(F.col("raw_url")))
    first = rows.where(F.col("canonical_domain") != "").groupBy("canonical_domain").agg(
        F.min_by(F.struct("raw_url", "source", "name_hint", "discovery_metadata"), F.struct(*order)).alias("row")
    )
    fresh = first.join(known.select("canonical_domain"), "canonical_domain", "left_anti")
    return fresh.select(
        stable_id(F.col("canonical_domain")).alias("candidate_id"),
        "canonical_domain",
        F.col("row.source").alias("source"),
        U.discovery_metadata(
            F.col("row.discovery_metadata"), F.col("row.name_hint"), F.col("row.raw_url")
        ).alias("discovery_metadata"),
        F.lit("pending").alias("state"),
        F.lit(0).alias("attempts"),
        F.lit(V.MAX_ATTEMPTS).alias("max_attempts"),
        F.lit(None).cast("timestamp").alias("last_attempt_at"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
        F.lit(None).cast("string").alias("failure_reason"),
        F.lit(None).cast("long").alias("business_id"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def candidate_seed_urls(candidates: DataFrame) -> DataFrame:
    """``(candidate_id, canonical_domain, seed_url)`` with the scheme seen at discovery."""
    scheme = F.try_element_at(F.col("discovery_metadata"), F.lit("scheme"))
    return candidates.select(
        "candidate_id", "canonical_domain", U.seed_url(scheme, F.col("canonical_domain")).alias("seed_url")
    )


def lookup_candidates(ids: DataFrame, candidates: DataFrame) -> DataFrame:
    """Domain per requested ``candidate_id``, NULL with ``found = false`` when there is none."""
    found = candidates.select("candidate_id", "canonical_domain")
    return ids.select("candidate_id").distinct().join(found, "candidate_id", "left").withColumn(
        "found", F.col("canonical_domain").isNotNull()
    )


def _json_text(value: Column) -> Column:
    """A string as an ASCII JSON literal, NULL as ``null``."""
    quoted = F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1")
    escaped = apply(
        "t -> CASE WHEN t RLIKE '^[\\\\x00-\\\\x7f]*$' THEN t ELSE array_join(transform(split(t, ''), c -> CASE WHEN"
        " octet_length(c) = 1 THEN c ELSE regexp_replace(lower(hex(encode(c, 'UTF-16BE'))), '(.{4})',"
        " '\\\\\\\\u$1') END), '') END",
        quoted,
    )
    return F.when(value.isNull(), "null").otherwise(escaped)


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), _json_text), ", "), F.lit("]"))


def criteria_hash(
    location: Column, category: Column, platform_hint: Column, keywords: Column, urls: Column, limit: Column
) -> Column:
    """Hash under which repeated discovery requests collapse; the order of list items does not count.

    It is the start of the SHA-256 of the request as JSON with sorted keys.
    """
    pairs = {
        "category": _json_text(category), "keywords": _json_list(keywords), "limit": limit.cast("string"),
        "location": _json_text(location), "platform_hint": _json_text(platform_hint), "urls": _json_list(urls),
    }
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{key}": '), text) for key, text in pairs.items()])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16)
