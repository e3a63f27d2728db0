"""Stored tables as plain Parquet folders, in buckets by the key that their rows belong to.

A table is ``<root>/<name>/bucket=<n>/``, and a log has a folder per day below that. A row's bucket is a hash of its key,
so rows that concern each other are found by reading a few folders, and a change rewrites only the
buckets it touches, by Spark's dynamic partition overwrite. Nothing else is kept: any reader of partitioned Parquet
can read the tables.

A change is written aside and checked before any bucket is replaced, so a broken rule leaves everything as it was.
Replacing is not one atomic step for readers; where that matters, keep the folders under a table format with commits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom import schemas
from leadloom.operators import quality
from leadloom.operators.skew import skew_join
from leadloom.session import stage
from leadloom.sources.files import delete, exists, folders, numbered_folders

#: The column whose hash is the bucket. Children of a business lie in its bucket.
KEYS = {
    "candidates": "candidate_id", "businesses": "business_id", "contacts": "business_id", "social_profiles": "business_id",
    "evidence": "business_id", "crawl_runs": "candidate_id", "crawl_pages": "crawl_run_id", "page_cache": "url",
    "validated": "canonical_domain", "contact_values": "value",
}
#: Logs have a folder per day of this column.
DAYS = {"evidence": "observed_at", "crawl_runs": "started_at", "crawl_pages": "fetched_at", "validated": "validated_at"}


class QualityError(ValueError):
    """A table rule is violated; nothing was changed."""


@dataclass(frozen=True)
class Store:
    """The tables under ``root``. ``buckets`` is fixed for the life of the folders."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def of(self, keys: DataFrame) -> list[int]:
        """The buckets of a one-column frame of keys; nulls have none. At most as many numbers as there are buckets."""
        keys, key = keys.toDF("key"), F.col("key")
        return sorted(r[0] for r in keys.where(key.isNotNull()).select(self.bucket(key)).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table, or those of some buckets, of whose folders alone files are read."""
        rows = self._partitions(name)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return rows.select(*schemas.TABLES[name].names)

    def _partitions(self, name: str) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TABLES[name].fields)
        schema = f"{fields}, bucket int" + (", day date" if name in DAYS else "")
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _placed(self, name: str, rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("bucket", self.bucket(F.col(KEYS[name])))
        return placed.withColumn("day", F.to_date(DAYS[name])) if name in DAYS else placed

    def merge(
        self, changes: Mapping[str, tuple[DataFrame, list[int]]], logs: Mapping[str, DataFrame] | None = None
    ) -> None:
        """Replace whole buckets of tables and append to logs, once all rules hold.

        ``changes`` gives, by table, the rows that some buckets hold from now on, and those buckets.
        Rules are checked for these rows and the new log rows; parents are looked up in the buckets that hold them.
        """
        logs = logs or {}
        rows = {name: stage(schemas.conform(df, schemas.TABLES[name]), f"next-{name}") for name, (df, _) in changes.items()}
        added = {name: stage(schemas.conform(df, schemas.TABLES[name]), f"added-{name}") for name, df in logs.items()}
        self._check(rows, added, {name: touched for name, (_, touched) in changes.items()})
        held = self._held(rows)
        for name in rows:
            before = self._stored_folders(name, changes[name][1])
            self._write(name, rows[name], "overwrite")
            for gone in before - held:  # overwriting leaves alone what gets no row
                delete(self.spark, f"{self.root}/{gone}")
        for name, new in added.items():
            self._write(name, new, "append")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        # Rebalancing splits a bucket that holds much and lets small ones share a task.
        placed = self._placed(name, rows).hint("rebalance", "bucket")
        columns = ["bucket", "day"] if name in DAYS else ["bucket"]
        writer = placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
        writer.parquet(self.path(name))

    def _held(self, rows: Mapping[str, DataFrame]) -> set[str]:
        """The folders that get rows."""
        if not rows:
            return set()
        parts = []
        for name, df in rows.items():
            day = F.concat(F.lit("/day="), F.col("day").cast("string")) if name in DAYS else F.lit("")
            folder = F.concat(F.lit(f"{name}/bucket="), F.col("bucket").cast("string"), day)
            parts.append(self._placed(name, df).select(folder.alias("folder")).distinct())
        for part in parts[1:]:
            parts[0] = parts[0].unionByName(part)
        return {r.folder for r in parts[0].collect()}  # one row per folder

    def _stored_folders(self, name: str, touched: list[int]) -> set[str]:
        """The folders of some buckets that there are, below ``root``."""
        there = [f"{name}/bucket={b}" for b in numbered_folders(self.spark, self.path(name), "bucket=") if b in touched]
        if name not in DAYS:
            return set(there)
        return {f"{bucket}/{day}" for bucket in there for day in folders(self.spark, f"{self.root}/{bucket}") if day.startswith("day=")}

    def _check(self, rows: Mapping[str, DataFrame], added: Mapping[str, DataFrame], touched: Mapping[str, list[int]]) -> None:
        new = {**rows, **added}
        parts = [quality.unique_rule(name, new[name], keys) for name, keys in quality.UNIQUE if name in rows]
        for name, keys in quality.UNIQUE:
            if name in added:  # keys that the log has already, in the buckets of the new rows
                own = added[name].select(*keys, KEYS[name])
                stored = self.read(name, self.of(own.select(KEYS[name]))).select(*keys, KEYS[name])
                parts.append(quality.unique_rule(name, own.unionByName(skew_join(stored, own.select(*keys).distinct(), list(keys), "left_semi")), keys))
        for name, column, parent, key in quality.FOREIGN:
            if name in new:
                used = new[name].select(column).where(F.col(column).isNotNull()).distinct()
                parts.append(quality.foreign_rule(name, used, column, parent, self._parents(parent, key, used, new, touched), key))
        for name, df in new.items():
            parts += quality.row_rules(name, df)
        if not parts:
            return
        report = parts[0]
        for part in parts[1:]:
            report = report.unionByName(part)
        broken = report.where(F.col("violations") > 0).collect()  # at most one row per rule
        if broken:
            raise QualityError("; ".join(f"{r.rule}: {r.violations}" for r in broken))

    def _parents(self, parent: str, key: str, used: DataFrame, new: Mapping[str, DataFrame], touched: Mapping[str, list[int]]) -> DataFrame:
        """Keys of the parents that ``used`` may refer to: those in the change and those stored that it leaves."""
        holding = self.of(used) if KEYS[parent] == key else list(range(self.buckets))
        kept = self.read(parent, [b for b in holding if b not in touched.get(parent, [])]).select(key)
        return kept.unionByName(new[parent].select(key)) if parent in new else kept

    def delete_businesses(self, ids: DataFrame) -> None:
        """Remove the businesses of ``ids (business_id)`` with their contacts, socials, evidence and contact values.

        What refers to them otherwise, candidates and duplicates, refers to nothing from then on.
        """
        gone = stage(ids.select("business_id").where("business_id is not null").distinct(), "gone")
        touched = self.of(gone)
        children = ("contacts", "social_profiles", "evidence")
        values = stage(self.read("contacts", touched).join(gone, "business_id", "left_semi").select("value").distinct(), "gone-values")
        changes = {name: (self._without(self.read(name, touched), gone), touched) for name in children}
        # Duplicates of what goes, and candidates that led to it, may lie in any bucket; only those with one are rewritten.
        duplicates = self._referring("businesses", "duplicate_of_id", gone)
        own = sorted({*touched, *duplicates})
        changes["businesses"] = (self._unlinked(self._without(self.read("businesses", own), gone), "duplicate_of_id", gone), own)
        led = self._referring("candidates", "business_id", gone)
        changes["candidates"] = (self._unlinked(self.read("candidates", led), "business_id", gone), led)
        held = self.of(values)
        changes["contact_values"] = (self._without(self.read("contact_values", held), gone), held)
        self.merge(changes)

    def delete_candidates(self, ids: DataFrame) -> None:
        """Remove the candidates of ``ids (candidate_id)`` with their crawl runs and the pages of these."""
        gone = stage(ids.select("candidate_id").where("candidate_id is not null").distinct(), "gone")
        touched = self.of(gone)
        runs = stage(skew_join(self.read("crawl_runs", touched), gone, "candidate_id", "left_semi").select("crawl_run_id"), "gone-runs")
        held = self.of(runs)
        self.merge({
            "crawl_pages": (skew_join(self.read("crawl_pages", held), runs, "crawl_run_id", "left_anti"), held),
            "crawl_runs": (skew_join(self.read("crawl_runs", touched), gone, "candidate_id", "left_anti"), touched),
            "candidates": (self.read("candidates", touched).join(gone, "candidate_id", "left_anti"), touched),
        })

    @staticmethod
    def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return skew_join(rows, gone, "business_id", "left_anti").select(*rows.columns)

    def _referring(self, name: str, column: str, gone: DataFrame) -> list[int]:
        links = self.read(name).select(KEYS[name], F.col(column).alias("link")).where("link is not null")
        hit = skew_join(links, gone.withColumnRenamed("business_id", "link"), "link", "left_semi")
        return self.of(hit.select(KEYS[name]))

    @staticmethod
    def _unlinked(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
        known = gone.select(F.col("business_id").alias("gone_id"))
        joined = rows.join(known, F.col(column) == F.col("gone_id"), "left")
        link = F.when(F.col("gone_id").isNull(), F.col(column))
        return joined.withColumn(column, link).select(*rows.columns)
