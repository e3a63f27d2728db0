"""Token ids as Parquet list columns: ordered files, controlled row groups and pages, selective reads.

Layout of a folder: ``tokens/`` holds one row per document ``(doc_id, part, place, n_tokens, ids)`` in
ascending order of document within and between its files; ``place`` counts the ids before the document
within its part. ``parts/`` holds one row per part with the ids of all parts before it. Ids are written
as a dictionary of the vocabulary by default, or as bit-packed differences. Parquet keeps the least and
largest ``doc_id`` of every row group and page, so a range of documents reads only the pages it needs,
and counts are read without the ids.

Null texts count as empty. Rows with equal ``doc_id`` are kept, in the order of their texts' hashes; a null
``doc_id`` comes first. An empty table gives empty folders. Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leadloom.llm.chunk_encoder import encoder, tokenizer_path
from leadloom.llm.common import slices, small_batches, text_of

TOKENS = "doc_id bigint, part int, place bigint, n_tokens bigint, ids array<int>"
PARTS = "part int, base bigint"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
) -> None:
    """Encode ``(doc_id, text)`` and write the folder; ``end_id`` follows every document unless None.

    Texts move once, into ranges of ``(doc_id, hash of text)``, so even a repeated id is split.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = text_of(docs, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer_path(tokenizer, "byte_bpe_50k.json"))
        for batch in batches:
            for some in slices(batch):
                ids, counts = own.encode(some.column("text").to_pylist())
                ids = np.insert(ids.astype(np.int32), np.repeat(np.cumsum(counts), len(tail)), tail * len(counts))
                counts = counts + len(tail)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id").cast(pa.int64()), pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(place + ends - counts), pa.array(counts), lists,
                ], names=["doc_id", "part", "place", "n_tokens", "ids"])
                place += int(counts.sum())

    writer = ordered.mapInArrow(run, TOKENS).write.option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    spark = docs.sparkSession
    with small_batches(spark):
        writer.parquet(f"{path}/tokens")
    sums = spark.read.schema(TOKENS).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written part
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents, or of those from ``low`` to ``high``.

    ``start`` is the number of ids of all documents before; columns that are not used are not read.
    """
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    if low is not None:
        tokens = tokens.where(F.col("doc_id") >= low)
    if high is not None:
        tokens = tokens.where(F.col("doc_id") <= high)
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts")  # a row per part, so small enough to send to all
    return tokens.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids"
    )


def id_checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of the ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column(n) for n in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
