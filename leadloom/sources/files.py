"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom import schemas
from leadloom.functions.urls import canonical_domain

FORMATS = ("csv", "json")


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of URL lists or CSV files as ``(pos, value)``, in file and line order.

    ``pos`` is unique and increasing in input order but not dense; it costs no shuffle.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as ``(page_seq, url, raw_html)``."""
    return spark.read.schema(schemas.PAGES).parquet(path).select(
        F.col("page_id").alias("page_seq"), "url", F.col("html").alias("raw_html")
    )


def read_fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages with their metadata and domain."""
    pages = spark.read.schema(schemas.FETCHED_PAGES).parquet(path)
    return pages.withColumn("canonical_domain", canonical_domain(F.col("url")))


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the stored tables, by its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def append_log(df: DataFrame, path: str, timestamp: str) -> None:
    """Append log rows, partitioned by the day of ``timestamp``."""
    day = F.to_date(F.col(timestamp))
    df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it takes it."""
    located = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return located.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), located


def exists(spark: SparkSession, path: str) -> bool:
    fs, located = _file_system(spark, path)
    return fs.exists(located)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds."""
    fs, located = _file_system(spark, path)
    fs.delete(located, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    fs, located = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(located)) if fs.exists(located) else []


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``<prefix><number>`` in ``path``, ascending; none where there is no such path."""
    numbers = [n.removeprefix(prefix) for n in folders(spark, path) if n.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit())


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` by the hash of ``key`` and return it as table ``table`` of the session.

    Two tables of equally many buckets join by their keys without moving a row. A key that holds much of the rows
    is written by several tasks.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(4)))
    dealt.write.bucketBy(buckets, key).format("parquet").option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename a directory on whichever file system holds it; the target must not exist."""
    (fs, src), (_, dst) = _file_system(spark, source), _file_system(spark, target)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise OSError(f"cannot publish {target}")


def write_export(rows: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    """Write an export and return its directory; it appears under its name only when complete."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}")
    spark = rows.sparkSession
    staging, target = f"{folder}/_staging-{uuid.uuid4().hex}", f"{folder}/{name}.{fmt}"
    writer = rows.write.option("header", True) if fmt == "csv" else rows.write
    writer.format(fmt).save(staging)
    rename(spark, staging, target)
    return target
