"""Validity of records; an invalid record is kept and says why."""

from pyspark.sql import DataFrame, functions as F

from leadloom import fixed_values as V


def validate(headers: DataFrame, resolution: DataFrame | None = None) -> DataFrame:
    """Headers with ``validation_errors`` and ``is_valid``, and the resolution columns when given."""
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    unreachable = (F.col("n_contacts") == 0) & (F.col("n_socials") == 0)
    errors = F.filter(
        F.array(F.when(nameless, V.MISSING_NAME), F.when(unreachable, V.NO_REACHABLE_CONTACT)),
        lambda e: e.isNotNull(),
    )
    checked = headers.withColumn("validation_errors", errors).withColumn(
        "is_valid", F.size("validation_errors") == 0
    )
    if resolution is None:
        return checked
    return checked.join(resolution.drop("record_order"), "canonical_domain", "left")
