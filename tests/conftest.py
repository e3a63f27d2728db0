import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadloom.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture
def shuffled_joins(spark):
    """Broadcasting by size switched off, so skewed joins take their split form."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def observe(spark):
    """Observations of literal pages, given as (url, html) pairs."""
    from leadloom.operators.extraction import ALL_SECTIONS, observations

    def run(*pages, sections=ALL_SECTIONS):
        rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
        df = spark.createDataFrame(rows, "page_seq long, url string, raw_html string")
        return observations(df, sections)

    return run
