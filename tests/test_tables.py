"""Stored tables in buckets: what a change touches, checks and deletes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.plans import lifecycle
from leadloom.sources.tables import QualityError, Store

T0 = datetime(2024, 6, 1)
HTML = '<title>{0}</title><a href="mailto:both@a.com">m</a><a href="mailto:own@{0}.com">o</a><a href="https://facebook.com/{0}">f</a>'


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def make(spark, name, *rows):
    schema = schemas.TABLES[name]
    return spark.createDataFrame([{f.name: None for f in schema.fields} | r for r in rows], schemas.T.StructType(
        [schemas.T.StructField(f.name, f.dataType, True) for f in schema.fields]))


def business(i, **columns):
    return {"business_id": i, "canonical_domain": f"{i}.com", "merge_status": "active", "created_at": T0, "updated_at": T0} | columns


def contact(i, owner, value="a@b.com", **columns):
    return {"contact_id": i, "business_id": owner, "type": "email", "value": value, "verification_attempts": 0, "created_at": T0} | columns


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"), buckets=8)


def everything(store):
    return list(range(store.buckets))


def put(store, spark, name, *rows):
    df = make(spark, name, *rows)
    store.merge({name: (df, everything(store))})


def bucket_files(store, name):
    return sorted(store.read(name).inputFiles())


def test_a_change_rewrites_the_buckets_it_touches(store, spark):
    put(store, spark, "businesses", *[business(i) for i in range(50)])
    before = bucket_files(store, "businesses")
    touched = store.of(spark.createDataFrame([(7,), (None,)], "business_id long"))
    assert len(touched) == 1
    rows = store.read("businesses", touched).withColumn("name", F.lit("new"))
    store.merge({"businesses": (rows, touched)})
    kept = set(before) & set(bucket_files(store, "businesses"))
    assert kept == {f for f in before if f"bucket={touched[0]}/" not in f}
    assert store.read("businesses").count() == 50 and store.read("businesses").where("business_id = 7 and name = 'new'").count() == 1
    plan = store.read("businesses", touched)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"(bucket#" in plan
    assert store.read("businesses", []).count() == 0


def test_nothing_changes_when_a_rule_breaks(store, spark):
    put(store, spark, "businesses", business(1))
    before = bucket_files(store, "businesses")
    for broken, rule in (
        ({"contacts": (make(spark, "contacts", contact(1, 99)), everything(store))}, "foreign contacts.business_id"),
        ({"businesses": (make(spark, "businesses", business(2, duplicate_of_id=77)), store.of(spark.range(2, 3)))}, "foreign businesses.duplicate_of_id"),
        ({"businesses": (make(spark, "businesses", business(2), business(2)), store.of(spark.range(2, 3)))}, "unique businesses"),
        ({"businesses": (make(spark, "businesses", business(3)), everything(store)),
          "contacts": (make(spark, "contacts", contact(1, 3, type="fax")), everything(store))}, "vocabulary contacts.type"),
    ):
        with pytest.raises(QualityError, match=rule):
            store.merge(broken)
    assert bucket_files(store, "businesses") == before and store.read("contacts").count() == 0
    # A parent in a bucket that stays, and one that the change brings along, both count.
    store.merge({"businesses": (make(spark, "businesses", business(2, duplicate_of_id=1)), store.of(spark.range(2, 3)))})
    store.merge({"contacts": (make(spark, "contacts", contact(1, 1), contact(2, 2)), everything(store))})
    assert store.read("contacts").count() == 2


def test_deleting_businesses_takes_all_that_is_theirs(store, spark):
    lifecycle.discover_into(store, spark.createDataFrame([(i, f"{d}.com") for i, d in enumerate("abc")], "pos long, url string"), now())
    pages = [(i, f"https://{d}.com/", HTML.format(d)) for i, d in enumerate("abc")]
    lifecycle.ingest_into(store, spark.createDataFrame(pages, "page_seq long, url string, raw_html string"), now())
    ids = {r.canonical_domain: r.business_id for r in store.read("businesses").collect()}
    flagged = {r.canonical_domain: r.duplicate_of_id for r in store.read("businesses").collect()}
    assert flagged == {"a.com": None, "b.com": ids["a.com"], "c.com": ids["a.com"]}
    store.delete_businesses(spark.createDataFrame([(ids["a.com"],), (12345,), (None,)], "business_id long"))
    left = {ids["b.com"], ids["c.com"]}
    assert {r.business_id: r.duplicate_of_id for r in store.read("businesses").collect()} == dict.fromkeys(left)
    for name in ("contacts", "social_profiles", "evidence", "contact_values"):
        assert {r.business_id for r in store.read(name).collect()} == left
    assert {r.canonical_domain: r.business_id for r in store.read("candidates").collect()} == {
        "a.com": None, "b.com": ids["b.com"], "c.com": ids["c.com"]}
    store.delete_businesses(store.read("businesses").select("business_id"))
    assert [store.read(n).count() for n in ("businesses", "contacts", "social_profiles", "evidence", "contact_values")] == [0] * 5


def test_a_small_ingest_reads_the_buckets_of_its_values(store, spark, monkeypatch):
    first = [(i, f"https://{d}.com/", HTML.format(d)) for i, d in enumerate("abcdefgh")]
    lifecycle.ingest_into(store, spark.createDataFrame(first, "page_seq long, url string, raw_html string"), now())
    seen = {}
    read = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, buckets=None: (seen.setdefault(name, []).append(buckets), read(self, name, buckets))[1])
    late = [(0, "https://z.com/", '<title>z</title><a href="mailto:own@e.com">o</a>')]
    lifecycle.ingest_into(store, spark.createDataFrame(late, "page_seq long, url string, raw_html string"), now())
    for name in ("businesses", "contacts", "contact_values", "page_cache", "candidates"):
        assert seen[name] and all(buckets is not None and len(buckets) <= 2 for buckets in seen[name])
    ids = {r.canonical_domain: r.business_id for r in read(store, "businesses").collect()}
    z = read(store, "businesses").where("canonical_domain = 'z.com'").first()
    assert (z.merge_status, z.duplicate_of_id) == ("possible_duplicate", ids["e.com"])
    assert read(store, "contact_values").where("value = 'own@e.com'").count() == 2


def test_unchanged_pages_are_not_read_again(store, spark):
    pages = [(0, "https://a.com/", HTML.format("a")), (1, "https://a.com/x", '<a href="mailto:x@a.com">x</a>')]
    df = spark.createDataFrame(pages, "page_seq long, url string, raw_html string")
    lifecycle.ingest_into(store, df, now())
    evidence = store.read("evidence").count()
    lifecycle.ingest_into(store, df.where("page_seq = 1"), now())
    assert store.read("evidence").count() == evidence and store.read("contacts").count() == 3


def test_empty_tables_and_changes(store, spark):
    assert all(store.read(name).count() == 0 for name in schemas.TABLES)
    store.merge({})
    store.merge({"businesses": (make(spark, "businesses"), [])}, {"evidence": make(spark, "evidence")})
    store.delete_businesses(spark.createDataFrame([(1,)], "business_id long"))
    lifecycle.ingest_into(store, spark.createDataFrame([], "page_seq long, url string, raw_html string"), now())
    assert store.read("businesses").count() == 0
