"""Observations to clean business records.

A record is kept in long form: one header row per domain plus its contacts, socials and evidence as
rows keyed by ``canonical_domain``. No domain's rows are gathered into one value, however many pages
it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadloom import fixed_values as V
from leadloom.functions.contacts import normalize_contact


def best_fields(observations: DataFrame) -> DataFrame:
    """Per domain and business field the value of highest confidence, first seen on ties."""
    rank = F.struct(F.col("confidence"), -F.col("page_seq"), -F.col("seq"))
    business = observations.where(F.col("section") == "business")
    return business.groupBy("canonical_domain", "field_name").agg(
        F.max_by("field_value", rank).alias("field_value"), F.max("confidence").alias("confidence")
    )


def business_columns(observations: DataFrame) -> DataFrame:
    """One row per domain with its best value of every business field as a column."""
    best = best_fields(observations)
    return best.groupBy("canonical_domain").agg(
        *[F.max(F.when(F.col("field_name") == name, F.col("field_value"))).alias(name) for name in V.BUSINESS_FIELDS]
    )


def normalized_contacts(observations: DataFrame, area_codes: Sequence[str] | None = None) -> DataFrame:
    """Contact observations with normalized values; those that do not normalize are dropped."""
    contacts = observations.where(F.col("section") == "contact")
    value = normalize_contact(F.col("field_name"), F.col("field_value"), area_codes)
    # An array of at most one value drops the NULLs; a filter would compute the value a second time.
    kept = contacts.withColumn("kept", F.explode(F.array_compact(F.array(value))))
    return kept.select(*[F.col("kept").alias(c) if c == "field_value" else F.col(c) for c in contacts.columns])


def contact_tallies(contacts: DataFrame, socials: DataFrame) -> DataFrame:
    """Per domain: numbers of contact and social observations and the best confidence per field.

    The map holds at most one entry per contact type and social platform.
    """
    per_field = (
        contacts.select("canonical_domain", "section", "field_name", "confidence")
        .unionByName(socials.select("canonical_domain", "section", "field_name", "confidence"))
        .groupBy("canonical_domain", "section", "field_name")
        .agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))
    )
    def count(section):
        return F.coalesce(F.sum(F.when(F.col("section") == section, F.col("n"))), F.lit(0))

    return per_field.groupBy("canonical_domain").agg(
        count("contact").alias("n_contacts"),
        count("social").alias("n_socials"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "best")))).alias("field_confidence"),
    )


def record_headers(domains: DataFrame, observations: DataFrame, platforms: DataFrame, tallies: DataFrame) -> DataFrame:
    """One header per crawled domain: business columns, platform, contact counts, confidences.

    ``domains(canonical_domain, record_order)`` lists the domains and the order in which they count
    as recorded. All four inputs have one row per domain when they meet.
    """
    return (
        domains.select("canonical_domain", "record_order")
        .join(business_columns(observations), "canonical_domain", "left")
        .join(platforms, "canonical_domain", "left")
        .join(tallies, "canonical_domain", "left")
        .withColumns({
            "n_contacts": F.coalesce("n_contacts", F.lit(0)),
            "n_socials": F.coalesce("n_socials", F.lit(0)),
            "field_confidence": F.coalesce("field_confidence", F.create_map().cast("map<string,double>")),
        })
    )
