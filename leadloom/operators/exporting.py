"""Contacts that may be exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.operators.skew import skew_join
from leadloom.operators.verification import exclude_suppressed

COLUMNS = ("business_id", "contact_id", "email", "verification_status")


def eligible_contacts(
    contacts: DataFrame,
    businesses: DataFrame,
    platform: str | None = None,
    state: str | None = None,
    category: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Verified emails of the businesses that pass the filters, the oldest ``limit`` or all."""
    chosen = businesses
    for column, wanted in (("platform", platform), ("state", state), ("category", category)):
        if wanted is not None:
            chosen = chosen.where(F.col(column) == wanted)
    verified = contacts.where((F.col("type") == "email") & (F.col("verification_status") == "verified")).select(
        "business_id", "contact_id", F.col("value").alias("email"), "verification_status", "created_at"
    )
    rows = skew_join(verified, chosen.select("business_id"), "business_id", "left_semi")
    if limit is not None:
        rows = rows.orderBy("created_at", "contact_id").limit(limit)
    return rows.select(*COLUMNS)


def exportable(eligible: DataFrame, suppression: DataFrame | None) -> DataFrame:
    """Eligible contacts without suppressed ones; the check runs after the limit that made ``eligible``.

    The join picks its form by size, so the list may be of any length.
    """
    if suppression is None:
        raise ValueError("the suppression table is required")
    return exclude_suppressed(eligible, suppression, "email").select(*COLUMNS)


def stamp_exported(contacts: DataFrame, exported: DataFrame, now: Column) -> DataFrame:
    """Next state of ``contacts`` with ``last_exported_at`` set on the exported ones."""
    ids = exported.select("contact_id", F.lit(True).alias("exported")).distinct()
    return contacts.join(ids, "contact_id", "left").withColumn(
        "last_exported_at", F.when(F.col("exported"), now).otherwise(F.col("last_exported_at"))
    ).select(*contacts.columns)
