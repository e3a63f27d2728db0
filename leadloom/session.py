"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call sites per expression cost more than the planning of the deep expressions used here.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    # JSON objects that repeat a key keep its last value, as common parsers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_local_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every job here relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="leadloom-")
    return _local_dirs[app]


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and continue from the written table.

    Used where several branches read the same costly intermediate: it cuts the lineage, survives
    lost executors, and later reads prune columns and know the table's size.
    """
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, for what a run writes and reads again; ``drop_staged`` removes it."""
    return f"{_staged_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _staged_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Remove everything this application has staged or written to run folders.

    For the end of a run, after its results are written or published: frames that still read staged tables
    fail afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; file sizes for stored tables, an upper bound after aggregation."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SMALL_INPUT_BYTES = 64 * 1024 * 1024


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of an input too small to be split by file size.

    Text work is heavy per byte, so a few megabytes in one split would keep one core busy. Larger
    inputs come in enough splits of their own and are not shuffled.
    """
    if estimated_bytes(df) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
