"""Applying resolved records to the stored tables, as new table states.

Ids come from natural keys, so rows find their business without a join: see ``functions.ids``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V, schemas
from leadloom.functions.ids import stable_id
from leadloom.operators.skew import skew_join

FILLABLE = (
    "name", "website", "description", "category", "subcategory", "country", "state", "city", "address",
    "platform", "platform_confidence",
)


def known_action(action: Column) -> Column:
    """The action; a job that meets one outside the vocabulary fails."""
    unknown = F.raise_error(F.concat(F.lit("unknown resolution action "), F.coalesce(action, F.lit("NULL"))))
    return F.when(action.isin(*V.RESOLUTION_ACTIONS), action).otherwise(unknown.cast("string"))


def merge_target(action: Column, target: Column) -> Column:
    """The target of a merged record; a job that meets one without a target fails."""
    missing = F.raise_error(F.lit("a record is to be merged but has no target")).cast("long")
    return F.when((action == "auto_merge") & target.isNull(), missing).otherwise(target)


def owners(resolution: DataFrame) -> DataFrame:
    """``(canonical_domain, owner_id, owner_order)``: the business that each record's rows belong to.

    That is the target of a merged record and the record's own business otherwise.
    """
    merged = known_action(F.col("action")) == "auto_merge"
    order = F.col("record_order") if "record_order" in resolution.columns else F.lit(0)
    return resolution.select(
        "canonical_domain",
        F.when(merged, merge_target(F.col("action"), F.col("target_business_id"))).otherwise(F.col("business_id")).alias("owner_id"),
        order.cast("long").alias("owner_order"),
    )


def merge_businesses(businesses: DataFrame, records: DataFrame, resolution: DataFrame, now: Column) -> DataFrame:
    """Next state of ``businesses``.

    New and flagged records are inserted unless their domain is already stored, in which case the stored row
    stays as it is. Merged records fill what is NULL in the business that they target, stored or inserted
    along with them, the earliest record first; ``updated_at`` moves only when that changed something.
    """
    order = "record_order" if "record_order" in resolution.columns else None
    actions = resolution.select(
        "canonical_domain", F.col("business_id").alias("new_id"), known_action(F.col("action")).alias("action"),
        merge_target(F.col("action"), F.col("target_business_id")).alias("target_business_id"),
        F.col("match_score").alias("new_score"),
        (F.col(order) if order else F.lit(0)).alias("place"),
    )
    incoming = records.join(actions, "canonical_domain").select(
        "canonical_domain", "new_id", "action", "target_business_id", "new_score", "place",
        *[(F.col(c) if c in records.columns else F.lit(None).cast("string")).alias(c) for c in FILLABLE],
    )
    flagged = F.col("action") == "flag_possible_duplicate"
    # A merged record without a target fails here too: fills may not be computed where nothing is stored or inserted.
    inserted = incoming.where("action <> 'auto_merge' OR target_business_id IS NULL").join(
        businesses.select("canonical_domain"), "canonical_domain", "left_anti")
    inserted = schemas.conform(inserted.withColumns({
        "business_id": F.col("new_id"),
        "merge_status": F.when(flagged, "possible_duplicate").otherwise("active"),
        "duplicate_of_id": F.when(flagged, F.col("target_business_id")),
        "match_score": F.when(flagged, F.col("new_score")),
        "created_at": now, "updated_at": now,
    }), schemas.BUSINESSES)
    fills = incoming.where("action = 'auto_merge'").groupBy(F.col("target_business_id").alias("business_id")).agg(*[
        F.expr(f"min_by({c}, struct(place, canonical_domain)) FILTER (WHERE {c} IS NOT NULL)").alias(f"new_{c}") for c in FILLABLE
    ])
    both = schemas.conform(businesses, schemas.BUSINESSES).unionByName(inserted).join(fills, "business_id", "left")
    changed = " OR ".join(f"({c} IS NULL AND new_{c} IS NOT NULL)" for c in FILLABLE)
    filled = both.withColumn("touched", F.expr(changed)).withColumns({
        **{c: F.expr(f"coalesce({c}, new_{c})") for c in FILLABLE},
        "updated_at": F.when(F.col("touched"), now).otherwise(F.col("updated_at")),
    })
    return schemas.conform(filled, schemas.BUSINESSES)


def business_id_of(domain: Column) -> Column:
    return stable_id(domain)


def _owned(observed: DataFrame, owned_by: DataFrame | None) -> DataFrame:
    """Observations with the business they belong to: that of their domain, or that of ``owned_by``."""
    if owned_by is None:
        return observed.withColumns({"owner_id": business_id_of(F.col("canonical_domain")), "owner_order": F.lit(0).cast("long")})
    return skew_join(observed, owned_by, "canonical_domain")


def contact_rows(contacts: DataFrame, now: Column, owned_by: DataFrame | None = None) -> DataFrame:
    """Contact table rows of normalized observations: the first one per business, type and value.

    ``owned_by`` (see ``owners``) says where merged records' contacts go; without it each domain has its own.
    """
    first = _owned(contacts, owned_by).groupBy("owner_id", "field_name", "field_value").agg(
        F.min_by(F.struct("canonical_domain", "source_url", "confidence"),
                 F.struct("owner_order", "page_seq", "seq", "canonical_domain")).alias("first")
    )
    rows = first.select(
        stable_id(F.col("first.canonical_domain"), F.col("field_name"), F.col("field_value")).alias("contact_id"),
        F.col("owner_id").alias("business_id"),
        F.col("field_name").alias("type"),
        F.col("field_value").alias("value"),
        F.col("first.source_url").alias("source_url"),
        F.col("first.confidence").alias("extraction_confidence"),
        *[F.lit(None).cast(schemas.CONTACTS[c].dataType).alias(c) for c in (
            "verification_status", "verification_provider", "verified_at", "last_verification_attempt_at",
            "next_verification_attempt_at", "verification_failure_reason", "last_exported_at")],
        F.lit(0).alias("verification_attempts"),
        now.alias("created_at"),
    )
    return schemas.conform(rows, schemas.CONTACTS)


def social_rows(socials: DataFrame, now: Column, owned_by: DataFrame | None = None) -> DataFrame:
    """Social profile rows of observations: the first one per business, platform and URL."""
    first = _owned(socials, owned_by).groupBy("owner_id", "field_name", "field_value").agg(
        F.min_by(F.struct("canonical_domain", "source_url"),
                 F.struct("owner_order", "page_seq", "seq", "canonical_domain")).alias("first")
    )
    rows = first.select(
        stable_id(F.col("first.canonical_domain"), F.col("field_name"), F.col("field_value")).alias("social_id"),
        F.col("owner_id").alias("business_id"),
        F.col("field_name").alias("platform"),
        F.col("field_value").alias("url"),
        F.col("first.source_url").alias("source_url"),
        now.alias("created_at"),
    )
    return schemas.conform(rows, schemas.SOCIAL_PROFILES)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` plus the ``incoming`` rows whose key it lacks. Both are unique on ``keys``.

    Of the stored table only the keys shuffle; its rows are copied where they are.
    """
    absent = incoming.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(absent.select(*stored.columns))


def evidence_rows(
    contacts: DataFrame, socials: DataFrame, platform: DataFrame, now: Column, owned_by: DataFrame | None = None
) -> DataFrame:
    """Evidence log rows of contact, social and platform observations; nothing is deduplicated."""
    columns = ("canonical_domain", "field_name", "field_value", "source_url", "extraction_method", "confidence")
    rows = contacts.select(*columns).unionByName(socials.select(*columns)).unionByName(platform.select(*columns))
    stamped = _owned(rows, owned_by).withColumns({"business_id": F.col("owner_id"), "observed_at": now})
    return schemas.conform(stamped, schemas.EVIDENCE)


def finish_candidates(candidates: DataFrame, resolution: DataFrame, now: Column) -> DataFrame:
    """Candidates whose record was stored become ``success`` and point at their business."""
    done = owners(resolution).select("canonical_domain", F.col("owner_id").alias("done_id"))
    joined = candidates.join(done, "canonical_domain", "left")
    stored = F.col("done_id").isNotNull()
    return joined.withColumns({
        "state": F.when(stored, "success").otherwise(F.col("state")),
        "business_id": F.coalesce("done_id", "business_id"),
        "updated_at": F.when(stored, now).otherwise(F.col("updated_at")),
    }).select(*candidates.columns)


def drop_orphans(children: DataFrame, parents: DataFrame, key: str = "business_id") -> DataFrame:
    """Children whose parent row still exists."""
    return skew_join(children, parents.select(key), key, "left_semi")
