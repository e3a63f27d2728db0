"""Retry schedules."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from leadloom import fixed_values as V


def _minutes(schedule: Sequence[int], attempt: Column) -> Column:
    steps = F.array(*[F.lit(m) for m in schedule])
    return F.element_at(steps, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(schedule))).cast("int"))


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(mins=minutes.cast("int"))


def candidate_retry_at(now: Column, attempt: Column) -> Column:
    """When a candidate is due again after its n-th failed attempt."""
    return plus_minutes(now, _minutes(V.CANDIDATE_BACKOFF_MINUTES, attempt))


def verification_retry_at(now: Column, attempt: Column) -> Column:
    """When an email is due again after its n-th failed verification."""
    return plus_minutes(now, _minutes(V.VERIFICATION_BACKOFF_MINUTES, attempt))
