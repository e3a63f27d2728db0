"""Declared schemas of every stored table; nothing in the library infers one."""

from pyspark.sql import types as T

S, L, I, D, B, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
UNIT = T.DecimalType(3, 2)  # confidences at rest


def _table(*columns):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


PAGES = _table(
    ("page_id", L, True), ("url", S, True), ("html", S, True),
)

FETCHED_PAGES = _table(
    ("url", S, False), ("page_type", S, True), ("fetched_via", S, True), ("http_status_code", I, True),
    ("content_hash", S, True), ("raw_html", S, True), ("from_cache", B, False), ("fetched_at", TS, False),
)

OBSERVATIONS = _table(
    ("canonical_domain", S, False), ("page_seq", L, False), ("section", S, False), ("seq", I, False),
    ("field_name", S, False), ("field_value", S, False), ("source_url", S, True),
    ("extraction_method", S, True), ("confidence", D, True),
)

CANDIDATES = _table(
    ("candidate_id", L, False), ("canonical_domain", S, False), ("source", S, False),
    ("discovery_metadata", T.MapType(S, S), True), ("state", S, False), ("attempts", I, False),
    ("max_attempts", I, False), ("last_attempt_at", TS, True), ("next_attempt_at", TS, True),
    ("failure_reason", S, True), ("business_id", L, True), ("created_at", TS, False), ("updated_at", TS, False),
)

BUSINESSES = _table(
    ("business_id", L, False), ("canonical_domain", S, False), ("name", S, True), ("website", S, True),
    ("description", S, True), ("category", S, True), ("subcategory", S, True), ("country", S, True),
    ("state", S, True), ("city", S, True), ("address", S, True), ("platform", S, True),
    ("platform_confidence", UNIT, True), ("merge_status", S, False), ("duplicate_of_id", L, True),
    ("match_score", UNIT, True), ("created_at", TS, False), ("updated_at", TS, False),
)

CONTACTS = _table(
    ("contact_id", L, False), ("business_id", L, False), ("type", S, False), ("value", S, False),
    ("source_url", S, True), ("extraction_confidence", UNIT, True), ("verification_status", S, True),
    ("verification_provider", S, True), ("verified_at", TS, True), ("verification_attempts", I, False),
    ("last_verification_attempt_at", TS, True), ("next_verification_attempt_at", TS, True),
    ("verification_failure_reason", S, True), ("last_exported_at", TS, True), ("created_at", TS, False),
)

SOCIAL_PROFILES = _table(
    ("social_id", L, False), ("business_id", L, False), ("platform", S, False), ("url", S, False),
    ("source_url", S, True), ("created_at", TS, False),
)

EVIDENCE = _table(
    ("business_id", L, False), ("field_name", S, False), ("field_value", S, False), ("source_url", S, True),
    ("extraction_method", S, True), ("confidence", UNIT, True), ("observed_at", TS, False),
)

CRAWL_RUNS = _table(
    ("crawl_run_id", L, False), ("candidate_id", L, False), ("started_at", TS, False),
    ("completed_at", TS, True), ("status", S, True), ("http_status_code", I, True),
    ("pages_crawled", L, False), ("used_browser", B, False), ("error_message", S, True),
)

CRAWL_PAGES = _table(
    ("crawl_run_id", L, False), ("url", S, False), ("page_type", S, True), ("fetched_via", S, True),
    ("http_status_code", I, True), ("fetched_at", TS, False),
)

PAGE_CACHE = _table(
    ("url", S, False), ("content_hash", S, True), ("status_code", I, True), ("etag", S, True),
    ("last_modified", S, True), ("fetched_at", TS, False),
)

VALIDATED = _table(
    ("canonical_domain", S, False), ("is_valid", B, False), ("validation_errors", T.ArrayType(S), False),
    ("action", S, True), ("target_business_id", L, True), ("validated_at", TS, False),
)

# Which businesses hold a contact value, for looking them up by value.
CONTACT_VALUES = _table(
    ("value", S, False), ("business_id", L, False),
)

TABLES = {
    "candidates": CANDIDATES,
    "businesses": BUSINESSES,
    "contacts": CONTACTS,
    "social_profiles": SOCIAL_PROFILES,
    "evidence": EVIDENCE,
    "crawl_runs": CRAWL_RUNS,
    "crawl_pages": CRAWL_PAGES,
    "page_cache": PAGE_CACHE,
    "validated": VALIDATED,
    "contact_values": CONTACT_VALUES,
}

# Append-only tables: a merge adds rows to them; only deletions rewrite what they hold.
LOGS = ("evidence", "crawl_runs", "crawl_pages", "validated")


def conform(df, schema):
    """Project ``df`` to the columns and types of ``schema``."""
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields])
