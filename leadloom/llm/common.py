"""Reading tables and mapping Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Texts handled at once inside a task; what a task holds beside its Arrow batch is bounded by it.
SLICE_CHARS = 1_000_000
#: Rows handled at once where a task holds a matrix row or a signature for each, however short its text.
SLICE_ROWS = 256
#: Text that goes to a Python worker in one Arrow batch, about; a longer row goes alone.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``BATCH`` for what is run inside, then the session's own settings again."""
    before = {key: spark.conf.get(key, None) for key in BATCH}
    try:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text, null texts as empty ones; other columns are left behind."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns by name."""
    fields = StructType.fromDDL(schema)
    arrow = [(f.name, _arrow(f.dataType.simpleString())) for f in fields]
    target = pa.schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = function(part)
                arrays = [a if isinstance(a := out[n], pa.Array) else pa.array(a, type=t) for n, t in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def slices(
    batch: pa.RecordBatch, column: str = "text", bytes_at_once: int = SLICE_CHARS, rows_at_once: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``bytes_at_once`` bytes of text, and ``rows_at_once`` rows, at most.

    A part has one row at least.
    """
    if column not in batch.schema.names or batch.num_rows == 0:
        yield batch
        return
    import pyarrow.compute as pc

    ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)).to_numpy()
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(done + bytes_at_once, side="right")))
        if rows_at_once is not None:
            stop = min(stop, start + rows_at_once)
        yield batch.slice(start, stop - start)
        start = stop


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind]
