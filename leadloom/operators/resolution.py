"""Entity resolution: new business, merge into a stored one, or possible duplicate.

Records count as arriving one after another in ``record_order``. What a record sees is the stored
businesses plus everything earlier records added. Written as set operations, only the first holder of
each contact value matters, so no pairs of records are ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom import fixed_values as V
from leadloom.functions.ids import stable_id
from leadloom.operators.skew import skew_join
from leadloom.session import stage


def match_score(same_domain: Column, shares_contact: Column) -> Column:
    return F.when(same_domain, V.SAME_DOMAIN_SCORE).when(shares_contact, V.SHARED_CONTACT_SCORE).otherwise(0.0)


def action_for(score: Column) -> Column:
    """Resolution action of the best score; NULL scores create a new business."""
    return (
        F.when(score >= V.AUTO_MERGE_AT, "auto_merge")
        .when(score >= V.POSSIBLE_DUPLICATE_AT, "flag_possible_duplicate")
        .otherwise("create_new")
    )


def _level(score: Column) -> Column:
    return F.when(score >= V.AUTO_MERGE_AT, "strong").when(score >= V.POSSIBLE_DUPLICATE_AT, "medium")


def stored_contact_values(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Distinct ``(business_id, value)`` of stored businesses, in long form."""
    values = contacts.select("business_id", "value").distinct()
    return skew_join(values, businesses.select("business_id"), "business_id", "left_semi")


def match_candidates(
    records: DataFrame,
    record_values: DataFrame,
    businesses: DataFrame,
    stored_values: DataFrame,
    limit: int,
) -> DataFrame:
    """Up to ``limit`` stored businesses per record: same domain first, then shared contact values.

    ``record_values(canonical_domain, value)`` and ``stored_values(business_id, value)`` are distinct.
    Ties go to the smaller id. A value keeps its ``limit + 1`` smallest businesses before it meets
    the records. That is exact, because the smallest ``limit`` of a union are among the smallest of
    its parts, and it keeps the join linear however many businesses share the value.
    """
    by_id = Window.partitionBy("value").orderBy("business_id")
    few = (
        stored_values.withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= limit + 1)
        .select("value", "business_id")
    )
    shared = skew_join(record_values, few, "value").select("canonical_domain", "business_id").distinct()
    own = records.select("canonical_domain").join(
        businesses.select("canonical_domain", "business_id"), "canonical_domain"
    )
    flagged = (
        shared.withColumns({"same_domain": F.lit(False), "shares_contact": F.lit(True)})
        .unionByName(own.withColumns({"same_domain": F.lit(True), "shares_contact": F.lit(False)}))
        .groupBy("canonical_domain", "business_id")
        .agg(F.bool_or("same_domain").alias("same_domain"), F.bool_or("shares_contact").alias("shares_contact"))
    )
    scored = flagged.withColumn("match_score", match_score(F.col("same_domain"), F.col("shares_contact")))
    best_first = Window.partitionBy("canonical_domain").orderBy(F.desc("match_score"), "business_id")
    return (
        scored.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= limit)
        .select("canonical_domain", "business_id", "match_score", "rank")
    )


def best_match(candidates: DataFrame) -> DataFrame:
    """The best candidate per record, smaller id on ties, with score and action."""
    best = candidates.groupBy("canonical_domain").agg(
        F.max_by(F.struct("business_id", "match_score"), F.struct("match_score", -F.col("business_id"))).alias("m")
    )
    return best.select(
        "canonical_domain",
        F.col("m.business_id").alias("target_business_id"),
        F.col("m.match_score").alias("match_score"),
        action_for(F.col("m.match_score")).alias("action"),
    )


def resolve(
    records: DataFrame,
    record_values: DataFrame,
    businesses: DataFrame,
    stored_values: DataFrame,
    score: Column | None = None,
) -> DataFrame:
    """Resolution of every record against stored businesses and earlier records.

    ``records(canonical_domain, record_order)`` has one row per domain and distinct orders;
    ``record_values(canonical_domain, value)`` are its normalized contact values, distinct. A record
    of a stored domain merges into that business and lends it its contacts from its own place on.
    Any other record that shares a value with a stored business or an earlier record is flagged as a
    duplicate of the business that held the shared value first. A business already stored holds its
    values before any record; among equals the smaller id counts.

    ``score`` may replace the score of a match; it is an expression over ``same_domain`` and
    ``shares_contact``. A record may then merge into the business of an earlier record that itself merged
    elsewhere: targets are followed to the business that stays, which starts jobs.
    """
    scoring = score if score is not None else match_score(F.col("same_domain"), F.col("shares_contact"))
    stored = businesses.select("canonical_domain", F.col("business_id").alias("stored_id"))
    placed = records.select("canonical_domain", "record_order").join(stored, "canonical_domain", "left").withColumn(
        "business_id", F.coalesce("stored_id", stable_id(F.col("canonical_domain")))
    )
    held = skew_join(record_values, placed, "canonical_domain").select(
        "canonical_domain", "value", "stored_id", "record_order", "business_id"
    )
    holders = held.select("value", F.col("record_order").alias("since"), "business_id").unionByName(
        stored_values.select("value", F.lit(-1).cast("long").alias("since"), "business_id")
    )
    first = (
        holders.groupBy("value")
        .agg(F.min(F.struct("since", "business_id")).alias("holder"), F.count(F.lit(1)).alias("holders"))
        .where(F.col("holders") > 1)
        .select("value", "holder")
    )
    unmerged = held.where(F.col("stored_id").isNull())
    seen = skew_join(unmerged, first, "value", write_left=True).where(F.col("holder.since") < F.col("record_order"))
    shared = seen.groupBy("canonical_domain").agg(F.min("holder").alias("holder"))
    matched = placed.join(shared, "canonical_domain", "left").select(
        "canonical_domain",
        "record_order",
        "business_id",
        F.coalesce("stored_id", "holder.business_id").alias("target_business_id"),
        F.col("stored_id").isNotNull().alias("same_domain"),
        F.col("holder").isNotNull().alias("shares_contact"),
    )
    scored = matched.withColumn("score", scoring)
    counts = F.col("score") >= V.POSSIBLE_DUPLICATE_AT
    decided = scored.select(
        "canonical_domain",
        "record_order",
        "business_id",
        action_for(F.col("score")).alias("action"),
        F.when(counts, F.col("target_business_id")).alias("target_business_id"),
        F.when(counts, F.col("score")).alias("match_score"),
        _level(F.col("score")).alias("match_level"),
    )
    return decided if score is None else follow_merges(decided)


def follow_merges(resolution: DataFrame) -> DataFrame:
    """``resolution`` with every target that was itself merged replaced by the business it ended in.

    Each round doubles the length of the chains followed. A chain ends, since targets are earlier records.
    """
    moved = stage(resolution.where("action = 'auto_merge' AND target_business_id <> business_id").select(
        F.col("business_id").alias("merged_id"), F.col("target_business_id").alias("into_id")), "merged")
    while True:
        onward = moved.select(F.col("merged_id").alias("into_id"), F.col("into_id").alias("end_id"))
        further = stage(skew_join(moved, onward, "into_id", "left"), "merged")
        if further.where("end_id IS NOT NULL").isEmpty():
            break
        moved = further.select("merged_id", F.coalesce("end_id", "into_id").alias("into_id"))
    ends = moved.select(F.col("merged_id").alias("target_business_id"), "into_id")
    kept = resolution.where("target_business_id IS NULL")
    followed = skew_join(resolution.where("target_business_id IS NOT NULL"), ends, "target_business_id", "left")
    return kept.unionByName(followed.withColumn(
        "target_business_id", F.coalesce("into_id", "target_business_id")).select(*resolution.columns))
