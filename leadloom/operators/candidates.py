"""Candidate states: claims, outcomes, retries.

A candidate's history is a log of attempt outcomes. A success or a block ends it, and so does the
fifth failure, so at most the first five events of a candidate ever matter. Those are picked with a
top-5 per key, which Spark applies before the shuffle; a candidate with most of the log costs five
rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom import fixed_values as V
from leadloom.functions.timing import candidate_retry_at, plus_minutes


def claimable(now: Column, stale_after_minutes: int = V.STALE_CLAIM_MINUTES) -> Column:
    """Pending or to be retried, or claimed so long ago that the claim has lapsed."""
    stale = (F.col("state") == "crawling") & (
        F.col("last_attempt_at") < plus_minutes(now, F.lit(-stale_after_minutes))
    )
    return F.col("state").isin("pending", "retry") | F.coalesce(stale, F.lit(False))


def _touch(rows: DataFrame, changed: Column, now: Column) -> DataFrame:
    """Move ``updated_at`` of changed rows, for tables that have it."""
    if "updated_at" not in rows.columns:
        return rows
    return rows.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))


def claim(
    candidates: DataFrame, now: Column, stale_after_minutes: int = V.STALE_CLAIM_MINUTES, policy: DataFrame | None = None
) -> DataFrame:
    """Claimable rows become ``crawling`` at ``now``; others stay. ``claimed`` tells which.

    ``policy(canonical_domain, circuit_open)``, one row per domain, keeps domains with an open circuit out.
    """
    if policy is None:
        rows = candidates.withColumn("claimed", claimable(now, stale_after_minutes))
    else:
        circuits = policy.select("canonical_domain", "circuit_open")
        free = ~F.coalesce("circuit_open", F.lit(False))
        rows = candidates.join(circuits, "canonical_domain", "left").withColumn(
            "claimed", claimable(now, stale_after_minutes) & free).select(*candidates.columns, "claimed")
    return _touch(rows, F.col("claimed"), now).withColumns({
        "state": F.when(F.col("claimed"), "crawling").otherwise(F.col("state")),
        "last_attempt_at": F.when(F.col("claimed"), now).otherwise(F.col("last_attempt_at")),
    })


def route_outcomes(candidates: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Candidates after one crawl each.

    ``outcomes(candidate_id, status, reason [, storage_conflict])`` has one row per claimed
    candidate. Blocked blocks. Success is final unless storing it conflicted, which abandons the
    candidate. Anything else counts as a failed attempt. A candidate without an outcome was skipped
    and stays.
    """
    conflict = F.col("storage_conflict") if "storage_conflict" in outcomes.columns else F.lit(False)
    rows = outcomes.select(
        "candidate_id", F.col("status").alias("outcome"), F.col("reason").alias("reason"), conflict.alias("conflict")
    )
    joined = candidates.join(rows, "candidate_id", "left")
    attempt = F.col("attempts") + 1
    success = F.col("outcome") == "success"
    clean = success & ~F.coalesce("conflict", F.lit(False))
    blocked = F.col("outcome") == "blocked"
    given_up = attempt >= V.MAX_ATTEMPTS
    state = (
        F.when(F.col("outcome").isNull(), F.col("state"))
        .when(blocked, "blocked")
        .when(clean, "success")
        .when(success | given_up, "abandoned")
        .otherwise("retry")
    )
    touched = F.col("outcome").isNotNull() & ~clean
    reason = F.when(success, "duplicate_domain").otherwise(F.coalesce("reason", "outcome"))
    routed = _touch(joined, F.col("outcome").isNotNull(), now).withColumn("new_state", state)
    return routed.withColumns({
        "next_attempt_at": F.when(
            touched, F.when(F.col("new_state") == "retry", candidate_retry_at(now, attempt))
        ).otherwise(F.col("next_attempt_at")),
        "failure_reason": F.when(touched, reason).otherwise(F.col("failure_reason")),
        "attempts": F.when(touched, attempt).otherwise(F.col("attempts")),
        "state": F.col("new_state"),
    }).select(*candidates.columns)


def attempt_trail(log: DataFrame) -> DataFrame:
    """The attempts that count, from ``log(candidate_id, event_id, attempted_at, outcome)``.

    Each has its attempt number, the state it led to and the next attempt's time. Events after the
    end of a candidate's history find nothing to claim and are left out.
    """
    in_order = Window.partitionBy("candidate_id").orderBy("attempted_at", "event_id")
    first = log.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= V.MAX_ATTEMPTS)
    ends = F.col("outcome").isin("success", "blocked")
    ended_before = F.coalesce(
        F.max(ends.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    counted = first.withColumn("ended_before", ended_before).where(F.col("ended_before") == 0)
    state = (
        F.when(F.col("outcome") == "success", "success")
        .when(F.col("outcome") == "blocked", "blocked")
        .when(F.col("n") >= V.MAX_ATTEMPTS, "abandoned")
        .otherwise("retry")
    )
    return counted.withColumn("state", state).select(
        "candidate_id", "event_id", "attempted_at", "outcome",
        F.col("n").alias("attempt_number"), "state",
        F.when(F.col("state") == "retry", candidate_retry_at(F.col("attempted_at"), F.col("n"))).alias("next_attempt_at"),
    )


def states_from_trail(trail: DataFrame) -> DataFrame:
    """Current state per candidate: at most five trail rows each."""
    last = trail.groupBy("candidate_id").agg(
        F.max_by(
            F.struct("state", "outcome", "attempt_number", "attempted_at", "next_attempt_at"), F.col("attempt_number")
        ).alias("last")
    )
    success = F.col("last.state") == "success"
    return last.select(
        "candidate_id",
        F.col("last.state").alias("state"),
        (F.col("last.attempt_number") - F.when(success, 1).otherwise(0)).alias("attempts"),
        F.col("last.attempted_at").alias("last_attempt_at"),
        F.col("last.next_attempt_at").alias("next_attempt_at"),
        F.when(~success, F.col("last.outcome")).alias("failure_reason"),
    )


def due_retries(candidates: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Candidates to be retried by ``now``, longest due first; ``limit`` None takes all of them."""
    due = candidates.where((F.col("state") == "retry") & (F.col("next_attempt_at") <= now))
    rows = due.select("candidate_id", "next_attempt_at").orderBy("next_attempt_at", "candidate_id")
    return rows.limit(limit) if limit is not None else rows
