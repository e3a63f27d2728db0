"""Store platform per domain, with the evidence for it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V
from leadloom.functions.urls import canonical_domain
from leadloom.operators.pages import fresh_pages
from leadloom.operators.skew import skew_join
from leadloom.session import spread_small

def _hit(pattern: str) -> Column:
    """Case-insensitive test over column ``lowered``.

    Each alternative of the pattern is first looked for by its longest plain text; the pattern itself
    only runs on pages that have it.
    """
    found = None
    for alternative in pattern.lower().split("|"):
        texts = [text.replace("\\.", ".") for text in re.split(r"\[[^\]]*\]|\\s[*+]", alternative)]
        test = F.col("lowered").contains(max(texts, key=len))
        if len(texts) > 1:
            test = test & F.col("lowered").rlike(alternative)
        found = test if found is None else found | test
    return found


def platform_signals() -> Column:
    """The signals found in column ``lowered``, as an array of ``(seq, platform, method, confidence)``."""
    tests = [
        F.when(
            _hit(pattern),
            F.expr(
                f"struct({rank} AS seq, '{platform}' AS platform, '{method}' AS method,"
                f" CAST({confidence} AS DOUBLE) AS confidence)"
            ),
        )
        for rank, (platform, pattern, confidence, method) in enumerate(V.PLATFORM_SIGNALS)
    ]
    return F.array_compact(F.array(*tests))


def platform_evidence(pages: DataFrame) -> DataFrame:
    """One row per page and matching platform signal; ``seq`` is the signal's rank."""
    lowered = spread_small(fresh_pages(pages), "page_seq").select(
        canonical_domain(F.col("url")).alias("canonical_domain"),
        F.col("page_seq").cast("long").alias("page_seq"),
        F.col("url").alias("source_url"),
        F.lower("raw_html").alias("lowered"),
    )
    found = lowered.select("canonical_domain", "page_seq", "source_url", F.inline(platform_signals()))
    return found.selectExpr(
        "canonical_domain", "page_seq", "'platform' AS section", "seq", "'platform' AS field_name",
        "platform AS field_value", "source_url", "method AS extraction_method", "confidence",
    )


def generator_hints(observations: DataFrame) -> DataFrame:
    """Evidence from generator tags: the first platform whose name occurs in the first telling tag."""
    lowered = F.lower("field_value")
    names = list(dict.fromkeys(platform for platform, *_ in V.PLATFORM_SIGNALS))
    platform = reduce(lambda rest, n: F.when(lowered.contains(n), n).otherwise(rest), reversed(names), F.lit(None).cast("string"))
    tags = observations.where(F.col("section") == "generator").withColumn("platform", platform)
    first = tags.where(F.col("platform").isNotNull()).groupBy("canonical_domain").agg(
        F.min_by(F.struct("page_seq", "platform", "source_url"), F.struct("page_seq", "seq")).alias("hint")
    )
    return first.select(
        "canonical_domain", "hint.page_seq", F.lit("platform").alias("section"), F.lit(0).alias("seq"),
        F.lit("platform").alias("field_name"), F.col("hint.platform").alias("field_value"), "hint.source_url",
        F.lit("generator-meta-tag").alias("extraction_method"), F.lit(V.GENERATOR_CONFIDENCE).alias("confidence"),
    )


def platform_by_domain(domains: DataFrame, evidence: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(canonical_domain, platform, platform_confidence)`` for every row of ``domains``.

    Highest confidence wins, ties go to the first page and signal. A generator hint, when hints are
    given, decides alone.
    """
    first = F.struct(F.col("confidence"), -F.col("page_seq"), -F.col("seq"))
    best = evidence.groupBy("canonical_domain").agg(
        F.max_by(F.struct("field_value", "confidence"), first).alias("best")
    )
    if hints is not None:
        hinted = hints.select("canonical_domain", F.struct("field_value", "confidence").alias("hint"))
        best = best.join(hinted, "canonical_domain", "full_outer").select(
            "canonical_domain", F.coalesce("hint", "best").alias("best")
        )
    return domains.select("canonical_domain").join(best, "canonical_domain", "left").select(
        "canonical_domain",
        F.coalesce(F.col("best.field_value"), F.lit(V.UNKNOWN_PLATFORM)).alias("platform"),
        F.coalesce(F.col("best.confidence"), F.lit(0.0)).alias("platform_confidence"),
    )


def winning_evidence(evidence: DataFrame, platforms: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Evidence rows whose platform is the one chosen for their domain."""
    chosen = platforms.select("canonical_domain", F.col("platform").alias("field_value"))
    if hints is None:
        return skew_join(evidence, chosen, ["canonical_domain", "field_value"], "left_semi")
    unhinted = skew_join(evidence, hints.select("canonical_domain"), ["canonical_domain"], "left_anti")
    kept = skew_join(unhinted, chosen, ["canonical_domain", "field_value"], "left_semi")
    return kept.unionByName(hints)
