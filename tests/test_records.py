"""Resolution, validation and merging, against plain sequential restatements of the rules."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.functions.ids import stable_id
from leadloom.operators import crawling, merging, resolution, validation
from leadloom.plans import lifecycle
from leadloom.sources.tables import QualityError, Store


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def random_case(seed, n_records=60, n_stored=8):
    """A third of the records share one contact value, as an agency's clients would."""
    rng = random.Random(seed)
    stored = {f"d{i}.com": i + 1 for i in rng.sample(range(n_records + 5), n_stored)}
    values = {d: {f"v{rng.randrange(25)}" for _ in range(rng.randrange(3))} for d in stored}
    records = [(f"d{i}.com", order) for order, i in enumerate(rng.sample(range(n_records), n_records))]
    contacts = {
        d: {f"v{rng.randrange(40)}" for _ in range(rng.randrange(3))} | ({"hot"} if rng.random() < 0.34 else set())
        for d, _ in records
    }
    return stored, values, records, contacts


def frames(spark, stored, values, records, contacts):
    return (
        spark.createDataFrame(records, "canonical_domain string, record_order long"),
        spark.createDataFrame([(d, v) for d, vs in contacts.items() for v in vs], "canonical_domain string, value string"),
        spark.createDataFrame([(d, i) for d, i in stored.items()], "canonical_domain string, business_id long"),
        spark.createDataFrame([(stored[d], v) for d, vs in values.items() for v in vs], "business_id long, value string"),
    )


def one_after_another(stored, values, records, contacts, new_ids):
    """Records resolved in turn: each sees what the stored tables held and what earlier ones added."""
    holders = [(-1, stored[d], d, set(vs)) for d, vs in values.items()]
    results = {}
    for domain, order in records:
        mine = contacts[domain]
        if domain in stored:
            results[domain] = ("auto_merge", stored[domain], 1.0)
            holders.append((order, stored[domain], domain, mine))
            continue
        sharing = [(since, b) for since, b, _, held in holders if held & mine]
        results[domain] = ("flag_possible_duplicate", min(sharing)[1], 0.85) if sharing else ("create_new", None, None)
        holders.append((order, new_ids[domain], domain, mine))
    return results


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split", [False, True])
def test_set_resolution_equals_one_after_another(spark, request, seed, split):
    if split:
        request.getfixturevalue("shuffled_joins")
    case = random_case(seed)
    records, record_values, businesses, stored_values = frames(spark, *case)
    new_ids = dict(records.select("canonical_domain", stable_id(F.col("canonical_domain"))).collect())
    got = {
        r.canonical_domain: (r.action, r.target_business_id, r.match_score)
        for r in resolution.resolve(records, record_values, businesses, stored_values).collect()
    }
    assert got == one_after_another(*case, new_ids)


@pytest.mark.parametrize("split", [False, True])
def test_match_candidates_are_the_true_top(spark, request, split):
    if split:
        request.getfixturevalue("shuffled_joins")
    stored = {f"s{i}.com": i for i in range(40)}
    values = {d: {"hot"} | ({f"v{i % 7}"} if i % 3 == 0 else set()) for d, i in stored.items()}
    records = [("s5.com", 0), ("s39.com", 1), ("new.com", 2), ("alone.com", 3)]
    contacts = {"s5.com": {"hot"}, "s39.com": {"v3", "hot"}, "new.com": {"v0", "v1"}, "alone.com": {"x"}}
    got = {}
    for r in resolution.match_candidates(*frames(spark, stored, values, records, contacts), limit=4).collect():
        got.setdefault(r.canonical_domain, []).append((r["rank"], r.business_id, r.match_score))
    for domain, _ in records:
        scored = [(-1.0 if d == domain else -0.85, i) for d, i in stored.items() if d == domain or values[d] & contacts[domain]]
        expected = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:4])]
        assert sorted(got.get(domain, [])) == expected


def test_best_match_and_thresholds(spark):
    pairs = spark.createDataFrame([("a", 7, 0.85), ("a", 3, 0.85), ("b", 9, 1.0), ("b", 1, 0.85), ("c", 4, 0.0)],
                                  "canonical_domain string, business_id long, match_score double")
    got = {r.canonical_domain: (r.target_business_id, r.action) for r in resolution.best_match(pairs).collect()}
    assert got == {"a": (3, "flag_possible_duplicate"), "b": (9, "auto_merge"), "c": (4, "create_new")}


def test_a_custom_score_decides(spark):
    case = ({"s.com": 1}, {"s.com": {"v"}}, [("r.com", 0)], {"r.com": {"v"}})
    lenient = F.when(F.col("shares_contact"), 0.5).otherwise(0.0)
    row = resolution.resolve(*frames(spark, *case), score=lenient).first()
    assert (row.action, row.target_business_id, row.match_score) == ("create_new", None, None)


def test_validation_keeps_and_explains_invalid_records(spark):
    headers = spark.createDataFrame([("a", "Shop", 1, 0), ("b", None, 0, 1), ("c", "", 0, 0)],
                                    "canonical_domain string, name string, n_contacts long, n_socials long")
    got = {r.canonical_domain: (r.is_valid, r.validation_errors) for r in validation.validate(headers).collect()}
    assert got == {
        "a": (True, []), "b": (False, ["missing business name"]),
        "c": (False, ["missing business name", "no contacts or social profiles found"])}


def stored_business(spark, **columns):
    row = {f.name: None for f in schemas.BUSINESSES.fields}
    row |= {"business_id": 1, "canonical_domain": "a.com", "merge_status": "active",
            "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1)} | columns
    return schemas.conform(spark.createDataFrame([row], schemas.BUSINESSES), schemas.BUSINESSES)


RESOLUTION = "canonical_domain string, business_id long, action string, target_business_id long, match_score double"
RECORD = "canonical_domain string, name string, city string, platform string, platform_confidence double"


def test_merge_fills_only_nulls_and_touches_only_changed_rows(spark):
    stored = stored_business(spark, name="Kept", platform="unknown")
    records = spark.createDataFrame([("a.com", "New", "Austin", "shopify", 0.97)], RECORD)
    resolved = spark.createDataFrame([("a.com", 1, "auto_merge", 1, 1.0)], RESOLUTION)
    row = merging.merge_businesses(stored, records, resolved, now()).first()
    assert (row.name, row.city, row.platform, float(row.platform_confidence)) == ("Kept", "Austin", "unknown", 0.97)
    assert row.created_at == datetime(2024, 1, 1) and row.updated_at == datetime(2024, 6, 1)
    again = merging.merge_businesses(merging.merge_businesses(stored, records, resolved, now()), records, resolved,
                                     F.lit("2025-01-01 00:00:00").cast("timestamp")).first()
    assert again.updated_at == datetime(2024, 6, 1)


def test_flagged_records_are_inserted_and_stored_domains_survive_conflicts(spark):
    stored = stored_business(spark, name="Old")
    records = spark.createDataFrame([("a.com", "X", "Y", "wix", 0.95), ("b.com", "B", None, "wix", 0.95)], RECORD)
    resolved = spark.createDataFrame(
        [("a.com", 5, "create_new", None, None), ("b.com", 6, "flag_possible_duplicate", 1, 0.85)], RESOLUTION)
    rows = {r.canonical_domain: r for r in merging.merge_businesses(stored, records, resolved, now()).collect()}
    assert (rows["a.com"].business_id, rows["a.com"].name, rows["a.com"].city) == (1, "Old", None)
    assert rows["a.com"].updated_at == datetime(2024, 1, 1)
    flagged = rows["b.com"]
    assert (flagged.business_id, flagged.merge_status, flagged.duplicate_of_id, float(flagged.match_score)) == (
        6, "possible_duplicate", 1, 0.85)


def test_the_first_observation_of_a_contact_is_stored_once(spark):
    seen = spark.createDataFrame(
        [("a.com", 2, 0, "email", "x@a.com", "late", 0.97), ("a.com", 1, 1, "email", "x@a.com", "first", 0.6),
         ("b.com", 1, 0, "email", "x@a.com", "other", 0.6)],
        "canonical_domain string, page_seq long, seq int, field_name string, field_value string, source_url string, confidence double")
    rows = merging.contact_rows(seen, now())
    assert sorted((r.source_url, float(r.extraction_confidence)) for r in rows.collect()) == [("first", 0.6), ("other", 0.6)]
    known = rows.where("source_url = 'first'").withColumn("verification_status", F.lit("verified"))
    merged = merging.insert_absent(known, rows, ["business_id", "type", "value"]).collect()
    assert sorted((r.source_url, r.verification_status) for r in merged) == [("first", "verified"), ("other", None)]


def test_a_second_ingest_merges_and_appends_evidence(spark, tmp_path):
    html = '<title>A</title><a href="mailto:x@a.com">m</a><a href="https://facebook.com/a">f</a> static.wixstatic.com'
    pages = spark.createDataFrame([(0, "https://a.com/", html)], "page_seq long, url string, raw_html string")
    store = Store(spark, str(tmp_path / "tables"), buckets=4)
    lifecycle.discover_into(store, spark.createDataFrame([(0, "a.com")], "pos long, url string"), now())
    for version in (1, 2):
        lifecycle.ingest_into(store, pages, now())
        counts = {name: store.read(name).count() for name in ("businesses", "contacts", "social_profiles", "evidence", "contact_values")}
        assert counts == {"businesses": 1, "contacts": 1, "social_profiles": 1, "evidence": 3 * version, "contact_values": 1}
    candidate, business = store.read("candidates").first(), store.read("businesses").first()
    assert (candidate.state, candidate.business_id, candidate.attempts) == ("success", business.business_id, 0)
    assert (business.name, business.platform, business.merge_status) == ("A", "wix", "active")


FETCHES = ("canonical_domain string, crawl_no long, page_seq long, url string, page_type string, fetched_via string, "
           "http_status_code int, is_timeout boolean, content_hash string, has_body boolean, from_cache boolean, fetched_at timestamp")


def test_crawl_logs_grow_and_the_cache_is_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), buckets=4)
    lifecycle.discover_into(store, spark.createDataFrame([(0, "a.com")], "pos long, url string"), now())
    for crawl in (1, 2):
        log = spark.createDataFrame(
            [("a.com", crawl, 0, "https://a.com/", "homepage", "http", 200, False, f"h{crawl}", True, False, datetime(2024, 6, crawl))], FETCHES)
        lifecycle.record_crawls_into(store, log, now())
    assert (store.read("crawl_runs").count(), store.read("crawl_pages").count()) == (2, 2)
    assert sorted(p.name for p in (tmp_path / "tables" / "crawl_pages").glob("bucket=*/day=*")) == ["day=2024-06-01", "day=2024-06-02"]
    assert [r.content_hash for r in store.read("page_cache").collect()] == ["h2"]
    with pytest.raises(QualityError, match="unique crawl_runs"):
        lifecycle.record_crawls_into(store, log, now())
    assert (store.read("crawl_runs").count(), store.read("crawl_pages").count()) == (2, 2)
    store.delete_candidates(store.read("candidates").select("candidate_id"))
    assert [store.read(n).count() for n in ("candidates", "crawl_runs", "crawl_pages", "page_cache")] == [0, 0, 0, 1]


def test_records_merged_by_score_share_their_target(spark):
    html = '<title>{0}</title><a href="mailto:both@a.com">m</a><a href="mailto:own@{0}.com">o</a><a href="https://facebook.com/{0}">f</a>'
    pages = spark.createDataFrame([(i, f"https://{d}.com/", html.format(d)) for i, d in enumerate("abc")], "page_seq long, url string, raw_html string")
    urls = spark.createDataFrame([(i, f"{d}.com") for i, d in enumerate("abc")], "pos long, url string")
    tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    tables["candidates"] = lifecycle.discover(urls, tables["candidates"], now())
    records = lifecycle.normalize(lifecycle.extract(pages))
    stored = resolution.stored_contact_values(tables["businesses"], tables["contacts"])
    lenient = F.when(F.col("shares_contact"), 0.99).otherwise(0.0)
    resolved = resolution.resolve(
        records.headers, lifecycle.contact_values(records.contacts), tables["businesses"], stored, score=lenient)
    after, logs = lifecycle.apply_records(tables, records, resolved, now())
    business = after["businesses"].collect()
    assert [(b.canonical_domain, b.name) for b in business] == [("a.com", "a")]
    only = {business[0].business_id}
    assert {r.business_id for r in after["contacts"].collect()} == only and after["contacts"].count() == 4
    assert {r.business_id for r in after["social_profiles"].collect()} == only and after["social_profiles"].count() == 3
    assert {r.business_id for r in logs["evidence"].collect()} == only
    assert {(r.state, r.business_id) for r in after["candidates"].collect()} == {("success", business[0].business_id)}


def test_chains_of_merges_end_where_a_business_stays(spark):
    rows = [(f"r{i}", i, i, "auto_merge", i - 1, 0.99, "strong") for i in range(1, 9)] + [("r0", 0, 0, "create_new", None, None, None)]
    df = spark.createDataFrame(rows, "canonical_domain string, record_order long, business_id long, action string, "
                               "target_business_id long, match_score double, match_level string")
    got = {r.canonical_domain: r.target_business_id for r in resolution.follow_merges(df).collect()}
    assert got == {f"r{i}": 0 for i in range(1, 9)} | {"r0": None}


def test_two_records_fill_one_target_in_order(spark):
    stored = stored_business(spark, name=None)
    records = spark.createDataFrame([("c.com", "Late", "Oslo", None, None), ("b.com", "Early", None, None, None)], RECORD)
    resolved = spark.createDataFrame([("b.com", 2, "auto_merge", 1, 0.99, 0), ("c.com", 3, "auto_merge", 1, 0.99, 1)], RESOLUTION + ", record_order long")
    rows = merging.merge_businesses(stored, records, resolved, now()).collect()
    assert [(r.business_id, r.name, r.city) for r in rows] == [(1, "Early", "Oslo")]


def test_unknown_actions_are_refused(spark):
    resolved = spark.createDataFrame([("a.com", 5, "bogus", None, None)], RESOLUTION)
    records = spark.createDataFrame([("a.com", "X", "Y", "wix", 0.95)], RECORD)
    with pytest.raises(Exception, match="unknown resolution action bogus"):
        merging.merge_businesses(stored_business(spark).limit(0), records, resolved, now()).collect()


def test_a_merged_record_needs_a_target(spark):
    resolved = spark.createDataFrame([("a.com", 5, "auto_merge", None, None)], RESOLUTION)
    records = spark.createDataFrame([("a.com", "X", "Y", "wix", 0.95)], RECORD)
    with pytest.raises(Exception, match="no target"):
        merging.merge_businesses(stored_business(spark).limit(0), records, resolved, now()).collect()
    with pytest.raises(Exception, match="no target"):
        merging.owners(resolved).collect()


def test_an_older_fetch_does_not_replace_a_newer_row(spark):
    cache = spark.createDataFrame([("u", "may", 200, "e", None, datetime(2024, 5, 1))], schemas.PAGE_CACHE)
    fetched = lambda *t: spark.createDataFrame([(0, "u", "new", 200, datetime(*t))], "page_seq long, url string, content_hash string, http_status_code int, fetched_at timestamp")
    assert [crawling.upsert_page_cache(cache, fetched(2024, m, 1)).first().content_hash for m in (1, 5, 6)] == ["may", "new", "new"]
