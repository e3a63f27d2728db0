"""Queries with check SQL, row by row against DuckDB."""

import duckdb
import pytest

from leadloom.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got = QUERIES[name](spark, SF_DIR)
    result = connection.sql(ORACLE[name])
    assert sorted(result.columns) == sorted(got.columns)
    expected = [tuple(row[result.columns.index(c)] for c in got.columns) for row in result.fetchall()]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_every_operator_has_one_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
