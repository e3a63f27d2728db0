"""Table rules as counts of violations. Stored tables change only when all are zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V

UNIQUE = (
    ("businesses", ("business_id",)),
    ("businesses", ("canonical_domain",)),
    ("candidates", ("candidate_id",)),
    ("candidates", ("canonical_domain",)),
    ("contacts", ("contact_id",)),
    ("contacts", ("business_id", "type", "value")),
    ("social_profiles", ("business_id", "platform", "url")),
    ("crawl_runs", ("crawl_run_id",)),
    ("page_cache", ("url",)),
)
FOREIGN = (
    ("contacts", "business_id", "businesses", "business_id"),
    ("social_profiles", "business_id", "businesses", "business_id"),
    ("evidence", "business_id", "businesses", "business_id"),
    ("businesses", "duplicate_of_id", "businesses", "business_id"),
    ("candidates", "business_id", "businesses", "business_id"),
    ("crawl_runs", "candidate_id", "candidates", "candidate_id"),
    ("crawl_pages", "crawl_run_id", "crawl_runs", "crawl_run_id"),
)
VOCABULARY = (
    ("businesses", "merge_status", V.MERGE_STATUSES),
    ("contacts", "type", V.CONTACT_TYPES),
    ("contacts", "verification_status", V.VERIFICATION_STATUSES),
    ("social_profiles", "platform", V.SOCIAL_PLATFORMS),
    ("candidates", "state", V.CANDIDATE_STATES),
    ("crawl_runs", "status", V.CRAWL_STATUSES),
    ("crawl_pages", "page_type", V.PAGE_TYPE_NAMES),
    ("crawl_pages", "fetched_via", V.FETCHED_VIA),
)
UNIT_RANGE = (
    ("businesses", "platform_confidence"),
    ("businesses", "match_score"),
    ("contacts", "extraction_confidence"),
    ("evidence", "confidence"),
)
NOT_NULL = (
    ("businesses", "canonical_domain"),
    ("candidates", "canonical_domain"),
    ("contacts", "value"),
    ("social_profiles", "url"),
    ("evidence", "field_name"),
    ("evidence", "field_value"),
    ("crawl_pages", "url"),
    ("page_cache", "url"),
)


def _violations(name: str, table: DataFrame, violated: Column) -> DataFrame:
    return table.agg(F.count_if(violated).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def unique_rule(name: str, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys held by more than one row."""
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _violations(f"unique {name}({', '.join(keys)})", counts, F.col("n") > 1)


def foreign_rule(name: str, table: DataFrame, column: str, parent: str, parents: DataFrame, key: str) -> DataFrame:
    """Distinct references without a parent; a key referenced by a third of the rows is one row here."""
    used = table.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct()
    missing = used.join(parents.select(key), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(f"foreign {name}.{column} -> {parent}").alias("rule"), "violations"
    )


def row_rules(name: str, table: DataFrame) -> list[DataFrame]:
    """Vocabulary, range and not-null rules of one table, in one pass over it."""
    rules: list[tuple[str, Column]] = []
    for t, column, words in VOCABULARY:
        if t == name:
            rules.append((f"vocabulary {t}.{column}", ~F.col(column).isin(*words)))
    for t, column in UNIT_RANGE:
        if t == name:
            rules.append((f"range {t}.{column}", ~F.col(column).between(0, 1)))
    for t, column in NOT_NULL:
        if t == name:
            rules.append((f"not null {t}.{column}", F.col(column).isNull() | (F.col(column).cast("string") == "")))
    if not rules:
        return []
    counts = table.agg(*[F.count_if(violated).alias(f"r{i}") for i, (_, violated) in enumerate(rules)])
    pairs = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (rule, _) in enumerate(rules)
    ])
    return [counts.select(F.inline(pairs))]


def quality_report(tables: Mapping[str, DataFrame], added: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``(rule, violations)`` for every rule whose tables are given.

    ``added`` holds the new rows of logs: only these need parents, since earlier ones may outlive theirs.
    """
    added = added or {}
    parts: list[DataFrame] = []
    for name, keys in UNIQUE:
        if name in tables:
            parts.append(unique_rule(name, tables[name], keys))
    for name, column, parent, key in FOREIGN:
        if name in tables and parent in tables:
            parts.append(foreign_rule(name, added.get(name, tables[name]), column, parent, tables[parent], key))
    for name, table in tables.items():
        parts += row_rules(name, table)
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
