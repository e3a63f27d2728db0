"""Registered queries against their check SQL on the smallest tables, broadcasts on and off."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from leadloom.plans.oracle import ORACLE
from leadloom.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "pages")
PLAIN = sorted(ORACLE)
SPLIT = ("robots_filter", "winning_evidence", "resolve_entities", "match_pairs", "verification_outcome", "eligible_contacts",
         "cached_pages_by_domain", "business_listing", "surviving_contacts")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def tidy(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def check(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(tidy(row[c]) for c in columns) for row in df.collect()]
    result = duck.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    expected = [tuple(tidy(row[i]) for i in places) for row in result.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_split_joins(spark, duck, shuffled_joins, name):
    check(spark, duck, name)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["select_pages", "platform_by_domain", "candidate_states", "domain_emails", "contacts_upsert"])
def test_plans_stay_declarative(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ExistingRDD"):
        assert operator not in plan
