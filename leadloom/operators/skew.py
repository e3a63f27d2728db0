"""Equi-joins whose left side may hold one key in a third of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadloom.session import estimated_bytes, stage

HOT_SHARE = 1000  # a key is hot when it holds more than 1/HOT_SHARE of the rows


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of the rows of ``df``.

    There are fewer than HOT_SHARE of them whatever the size of ``df``, so they are safe to broadcast.
    The counts combine on the map side, so a hot key costs one row per task here.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)))
    return counts.where(F.col("rows") * HOT_SHARE > total.scalar()).select(*keys)


def broadcast_limit(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; negative when broadcasting is off."""
    session = df.sparkSession._jsparkSession
    return int(session.sessionState().conf().autoBroadcastJoinThreshold())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the size estimate of ``df`` is within the session's broadcast threshold.

    An estimate cannot know how many rows a generator such as ``explode`` makes, so a frame with one in
    its plan never counts as small. Write it first where its size should count.
    """
    if estimated_bytes(df) > broadcast_limit(df):
        return False
    return "Generate " not in df._jdf.queryExecution().optimizedPlan().toString()


def skew_join(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner", write_left: bool = False
) -> DataFrame:
    """``left.join(right, keys, how)`` that never gathers a hot key of ``left`` in one task.

    When the estimated size of ``right`` is within the session's broadcast threshold, it is broadcast
    and ``left`` does not move at all. Otherwise rows of hot keys stay where they are and meet a
    broadcast of the right rows for those keys alone; the other rows shuffle, each key being at most
    1/HOT_SHARE of the data.

    ``right`` must hold a small fixed number of rows per key (one, as a rule), which bounds the second
    broadcast by that number times HOT_SHARE. ``left`` is then read by three branches. A stored table,
    or one that ends in a shuffle they can share, is fine as it is; ``write_left`` is for a left side
    that would be computed three times, and writes it to the shared folder first. Keys of ``left``
    must not be null. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    if write_left:
        left = stage(left, "skew-left")
    hot = F.broadcast(hot_keys(left, keys))
    hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
    hot_part = left.join(hot, keys, "left_semi").join(hot_right, keys, how)
    cold_part = left.join(hot, keys, "left_anti").join(right, keys, how)
    return hot_part.unionByName(cold_part)
