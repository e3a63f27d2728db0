"""Which pages carry content."""

from pyspark.sql import DataFrame, functions as F


def fresh_pages(pages: DataFrame) -> DataFrame:
    """Pages that carry content: not from cache, with a non-empty body."""
    df = pages
    if "from_cache" in df.columns:
        df = df.where(~F.col("from_cache"))
    return df.where(F.length("raw_html") > 0)
