"""Email verification against lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V
from leadloom.functions.contacts import email_domain, normalize_email
from leadloom.functions.timing import plus_minutes, verification_retry_at
from leadloom.operators.skew import skew_join


def due(now: Column) -> Column:
    """Emails without a final status whose next attempt is not in the future."""
    open_status = F.coalesce(F.col("verification_status") == "pending", F.lit(True))
    ready = F.coalesce(F.col("next_verification_attempt_at") <= now, F.lit(True))
    return (F.col("type") == "email") & open_status & ready


def lease(contacts: DataFrame, now: Column, limit: int | None = None, lease_minutes: int = V.VERIFICATION_LEASE_MINUTES) -> DataFrame:
    """Due emails, oldest first up to ``limit``, with their next attempt set past the lease.

    Without a limit a run takes all of them and nothing is sorted.
    """
    rows = contacts.where(due(now))
    if limit is not None:
        rows = rows.orderBy("created_at", "contact_id").limit(limit)
    return rows.withColumn("next_verification_attempt_at", plus_minutes(now, F.lit(lease_minutes)))


def exclude_suppressed(rows: DataFrame, suppression: DataFrame | None, email: str) -> DataFrame:
    """Rows whose email is not suppressed. A missing suppression table is an error, not an empty one."""
    if suppression is None:
        raise ValueError("the suppression table is required")
    listed = suppression.select(F.col("email").alias(email)).distinct()
    return skew_join(rows, listed, email, "left_anti")


def _status(outcome: Column, value: Column) -> Column:
    """Final status by mail-exchanger lookup; NULL when the provider itself was unavailable."""
    return (
        F.when(normalize_email(value).isNull(), "invalid")
        .when(outcome == "mx", "verified")
        .when(outcome.isin("nxdomain", "no_answer"), "invalid")
        .when(outcome == "unavailable", F.lit(None).cast("string"))
        .otherwise("unknown")
    )


def outcomes(leased: DataFrame, suppression: DataFrame | None, mx_records: DataFrame, now: Column) -> DataFrame:
    """Leased emails after one verification attempt, as contact rows plus ``outcome``.

    ``mx_records(domain, outcome)`` is the lookup result per mail domain. Suppressed emails keep their
    lease untouched. An unavailable provider means another attempt later, or ``unknown`` when that
    was the last one; a domain without a lookup result is inconclusive and stays ``unknown``.
    """
    if suppression is None:
        raise ValueError("the suppression table is required")
    listed = suppression.select(F.col("email").alias("value"), F.lit(True).alias("suppressed")).distinct()
    keyed = leased.withColumn("domain", email_domain(F.col("value")))
    with_flag = skew_join(keyed, listed, "value", "left")
    looked_up = skew_join(
        with_flag, mx_records.select("domain", F.col("outcome").alias("mx")), "domain", "left", write_left=True
    )
    attempt = F.col("verification_attempts") + 1
    status = _status(F.col("mx"), F.col("value"))
    outcome = (
        F.when(F.coalesce("suppressed", F.lit(False)), "skipped_suppressed")
        .when(status.isNotNull(), "verified")
        .when(attempt >= V.MAX_ATTEMPTS, "exhausted")
        .otherwise("retried")
    )
    done = looked_up.withColumns({"outcome": outcome, "new_status": status})
    is_ = lambda *names: F.col("outcome").isin(*names)
    attempted = ~is_("skipped_suppressed")
    updates = {
        "verification_status": F.when(is_("verified"), F.col("new_status"))
        .when(is_("exhausted"), "unknown").otherwise(F.col("verification_status")),
        "verification_provider": F.when(is_("verified"), V.VERIFICATION_PROVIDER).otherwise(F.col("verification_provider")),
        "verified_at": F.when(is_("verified"), now).otherwise(F.col("verified_at")),
        "last_verification_attempt_at": F.when(attempted, now).otherwise(F.col("last_verification_attempt_at")),
        "next_verification_attempt_at": F.when(is_("retried"), verification_retry_at(now, attempt))
        .when(is_("exhausted"), F.lit(None).cast("timestamp"))
        .otherwise(F.col("next_verification_attempt_at")),
        "verification_failure_reason": F.when(is_("retried", "exhausted"), "provider unavailable")
        .when(is_("verified"), F.lit(None).cast("string")).otherwise(F.col("verification_failure_reason")),
        "verification_attempts": F.when(attempted, attempt).otherwise(F.col("verification_attempts")),
    }
    return done.withColumns(updates).select(*leased.columns, "outcome")


def summary(outcome_rows: DataFrame) -> DataFrame:
    """One row: how the run ended, with the final statuses told apart."""
    def n(condition):
        return F.count_if(condition)

    verified = F.col("outcome") == "verified"
    return outcome_rows.agg(
        n(verified).alias("verified"),
        n(F.col("outcome") == "skipped_suppressed").alias("skipped_suppressed"),
        n(F.col("outcome") == "retried").alias("retried"),
        n(F.col("outcome") == "exhausted").alias("exhausted"),
        *[
            n(verified & (F.col("verification_status") == s)).alias(f"status_{s}")
            for s in ("verified", "invalid", "unknown")
        ],
    )


def apply_outcomes(contacts: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """Next state of ``contacts``: attempted rows replace their former state."""
    untouched = contacts.join(outcome_rows.select("contact_id"), "contact_id", "left_anti")
    return untouched.select(*contacts.columns).unionByName(outcome_rows.select(*contacts.columns))
