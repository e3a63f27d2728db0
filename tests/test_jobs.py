"""Discovery, crawling, candidate states, verification, export, browsing and quality."""

import hashlib
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.operators import browsing, candidates, crawling, discovery, exporting, merging, quality, skew, verification
from leadloom.plans import lifecycle
from leadloom.sources import files


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")
T0 = datetime(2024, 6, 1)


def make(spark, schema, *rows):
    """Rows of a stored table; columns that are not given are NULL."""
    return spark.createDataFrame([{f.name: None for f in schema.fields} | r for r in rows], schemas.T.StructType(
        [schemas.T.StructField(f.name, f.dataType, True) for f in schema.fields]))


# --- discovery ------------------------------------------------------------------------------------


def test_url_lists_join_in_order_without_repeats(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" a.com \n\nb.com, shop ,x\n,empty\na.com\n")
    typed = discovery.parse_url_lines(files.read_url_lines(spark, str(tmp_path / "urls.txt")))
    more = spark.createDataFrame([(0, "b.com"), (1, "c.com")], "pos long, url string")
    rows = discovery.combine_url_sources(typed, more).orderBy("source_rank", "pos").collect()
    assert [r.url for r in rows] == ["a.com", "b.com", "c.com"]


def test_discovery_keeps_the_first_row_of_new_domains(spark):
    urls = spark.createDataFrame([(2, "http://a.com"), (1, "https://www.A.com/x"), (3, "known.com"), (4, "")], "pos long, url string")
    known = spark.createDataFrame([("known.com",)], "canonical_domain string")
    rows = lifecycle.discover(urls, known, now()).collect()
    assert [(r.canonical_domain, r.discovery_metadata, r.state) for r in rows] == [("a.com", {"scheme": "https"}, "pending")]
    assert [r.raw_url for r in discovery.import_urls(urls, 2).orderBy("pos").collect()] == ["https://www.A.com/x", "http://a.com"]
    assert discovery.import_urls(urls, None).count() == 4


def test_criteria_hash_is_that_of_the_sorted_request(spark):
    requests = [("Köln \U0001F600", None, None, ["b", "a\"\\"], ["u"], 100), ("x", "c", "shopify", [], [], 5)]
    df = spark.createDataFrame(requests, "l string, c string, p string, k array<string>, u array<string>, n int")
    got = [r[0] for r in df.select(discovery.criteria_hash(*[F.col(c) for c in "lcpkun"])).collect()]
    expected = [
        hashlib.sha256(json.dumps({"location": l, "category": c, "platform_hint": p, "keywords": sorted(k), "urls": sorted(u),
                                   "limit": n}, sort_keys=True).encode()).hexdigest()[:16]
        for l, c, p, k, u, n in requests]
    assert got == expected


# --- crawling -------------------------------------------------------------------------------------


def test_pages_to_read_next(spark):
    html = ('<a href="/blog/x">b</a><a href="/contact">c</a><a href="/about#x">a</a><a href="https://e.com/contact">e</a>'
            '<a href="/">h</a><a href="/contact?x=1">c</a>')
    pages = spark.createDataFrame([(0, "https://a.com/", html)], "page_seq long, url string, raw_html string")
    urls = [r.url for r in crawling.select_pages(pages).orderBy("rank").collect()]
    assert urls == ["https://a.com/contact", "https://a.com/about", "https://a.com/blog/x"]
    assert crawling.select_pages(pages, max_pages=2).count() == 1 and crawling.select_pages(pages, max_pages=1).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_robots_first_matching_rule_decides(spark, request, split):
    if split:
        request.getfixturevalue("shuffled_joins")
    rng = random.Random(3)
    parts = ["/a", "/ab", "/abc", "/b", "/b/c", "/", "*", ""]
    rules = [(f"h{h}", n, rng.random() < 0.4, rng.choice(parts)) for h in range(6) for n in range(rng.randrange(5))]
    paths = ["/", "/a", "/abx", "/abc/d", "/b/cd", "/z", "/abc?q=1"]
    urls = [(f"h{h}", f"https://h{h}{p}") for h in range(7) for p in paths]

    def allowed(host, path):
        for h, _, allow, prefix in rules:
            if h == host and (prefix in ("", "*") or path.startswith(prefix)):
                return allow or prefix == ""
        return True

    got = crawling.allowed_by_robots(
        spark.createDataFrame(urls, "canonical_domain string, url string"),
        spark.createDataFrame(rules, "host string, seq int, allow boolean, path string"))
    assert sorted(r.url for r in got.collect()) == sorted(u for h, u in urls if allowed(h, u.removeprefix(f"https://{h}")))


AGENT_LINES = ["User-agent: *", "User-agent: lead", "user-agent: LOOM", "User-Agent: other", "Disallow: /", "Disallow: /a", "Allow: /a/b", "Disallow:",
               "Allow:", "Disallow: /caf%C3%A9", "Disallow: /x y", "Disallow: *", "Allow: /%61b", "disallow : /a?q=1", "Crawl-delay: 3", "", "", "# note",
               "Disallow: /a # note", "Sitemap: https://a.com/s", "nonsense", "   ", "User-agent:", "Disallow: /%zz"]
AGENT_PATHS = ["/", "/a", "/a/b/c", "/ab", "/café", "/caf%C3%A9/x", "/x%20y", "/x y", "/a?q=1", "/%zz", "/z"]


def test_robots_files_equal_the_standard_parser(spark):
    from urllib import robotparser

    rng = random.Random(17)
    bodies = [rng.choice(["\n", "\r\n"]).join(rng.choices(AGENT_LINES, k=rng.randrange(14))) for _ in range(300)]
    robots = spark.createDataFrame([(f"h{i}", 200, b) for i, b in enumerate(bodies)] + [("shut", 403, None), ("none", 404, "User-agent: *\nDisallow: /")],
                                   "host string, status int, body string")
    urls = [(h, f"https://{h}{p}") for h in [f"h{i}" for i in range(len(bodies))] + ["shut", "none", "unknown"] for p in AGENT_PATHS]
    allowed = set()
    for i, body in enumerate(bodies):
        parser = robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        allowed |= {f"https://h{i}{p}" for p in AGENT_PATHS if parser.can_fetch("LeadLoom/1.0", f"https://h{i}{p}")}
    allowed |= {f"https://{h}{p}" for h in ("none", "unknown") for p in AGENT_PATHS}
    rules = crawling.robots_rules(robots, "LeadLoom/1.0")
    got = crawling.allowed_by_robots(spark.createDataFrame(urls, "canonical_domain string, url string"), rules)
    wrong = {r.url for r in got.collect()} ^ allowed
    assert not wrong, [(u, bodies[int(u.split("/")[2][1:])]) for u in sorted(wrong)[:3]]


FETCH = ("canonical_domain string, crawl_no long, page_seq long, url string, page_type string, fetched_via string, "
         "http_status_code int, is_timeout boolean, content_hash string, has_body boolean, from_cache boolean, fetched_at timestamp")


def test_crawl_outcomes(spark):
    def page(domain, seq, status, timeout=False, body=True, cached=False, via="http"):
        return (domain, 0, seq, f"https://{domain}/{seq}", "other", via, status, timeout, "h", body, cached, T0 + timedelta(minutes=seq))

    log = spark.createDataFrame([
        page("ok", 1, 200), page("ok", 2, 500, body=False), page("ok", 3, 200, via="browser"), page("slow", 1, None, timeout=True),
        page("shut", 1, 429), page("shut", 2, 200), page("dead", 1, None), page("same", 1, 304, body=False, cached=True)], FETCH)
    ids = {merging_id: d for d in ("ok", "slow", "shut", "dead", "same")
           for merging_id in [spark.range(1).select(merging.business_id_of(F.lit(d))).first()[0]]}
    runs = {ids[r.candidate_id]: r for r in crawling.crawl_runs(log, now()).collect()}
    assert {d: (r.status, r.pages_crawled, r.used_browser) for d, r in runs.items()} == {
        "ok": ("success", 2, True), "slow": ("timeout", 0, False), "shut": ("blocked", 0, False), "dead": ("failed", 0, False),
        "same": ("failed", 1, False)}
    assert runs["same"].error_message == "no extractable pages" and runs["ok"].started_at == T0 + timedelta(minutes=1)
    assert runs["shut"].http_status_code == 429 and crawling.crawl_pages(log).count() == 4


def test_page_cache_takes_the_newest_and_keeps_validators(spark):
    cache = make(spark, schemas.PAGE_CACHE, {"url": "u", "content_hash": "old", "status_code": 200, "etag": "e", "fetched_at": T0})
    fetched = spark.createDataFrame([(1, "u", "new", 200, T0 + timedelta(hours=1)), (0, "u", "mid", 200, T0), (2, "v", "v", 200, T0)],
                                    "page_seq long, url string, content_hash string, http_status_code int, fetched_at timestamp")
    rows = {r.url: (r.content_hash, r.etag) for r in crawling.upsert_page_cache(cache, fetched).collect()}
    assert rows == {"u": ("new", "e"), "v": ("v", None)}


def test_unchanged_pages_are_skipped_except_the_homepage(spark):
    pages = spark.createDataFrame([(0, "https://a.com/", "x"), (1, "https://a.com/1", "x"), (2, "https://a.com/2", "y")],
                                  "page_seq long, url string, raw_html string")
    cached = pages.select("url", F.sha2(F.lit("x"), 256).alias("content_hash"))
    assert [r.from_cache for r in crawling.changed_pages(pages, cached).orderBy("page_seq").collect()] == [False, True, False]


def test_each_row_is_decided_by_its_own_url(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", "same"), (1, "https://b.com/y", "new"), (2, "https://c.com/z", None)],
                                  "page_seq long, url string, raw_html string")
    cached = spark.createDataFrame([("https://a.com/x", hashlib.sha256(b"same").hexdigest()), ("https://c.com/z", None)], "url string, content_hash string")
    assert [r.url for r in lifecycle.pages_to_read(pages, cached).collect()] == ["https://b.com/y"]  # numbers may repeat


def test_bucketed_pages_do_not_move_to_meet_the_cache(spark, shuffled_joins, tmp_path):
    rows = [(i, f"https://a.com/{i if i % 3 else 0}", f"text {i}") for i in range(300)]  # one URL in a third of the rows
    pages = spark.createDataFrame(rows, "page_seq long, url string, raw_html string")
    cached = pages.where("page_seq % 2 = 0").groupBy("url").agg(F.max_by(F.sha2("raw_html", 256), "page_seq").alias("content_hash"))
    landed = files.save_bucketed(pages, "landed_pages", str(tmp_path / "pages"), "url", 4)
    known = files.save_bucketed(cached, "landed_cache", str(tmp_path / "cache"), "url", 4)
    chosen = lifecycle.pages_to_read(landed, known)
    expected = {r.url: r.content_hash for r in cached.collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r.page_seq for r in chosen.collect()) == [i for i, url, text in rows if expected.get(url) != digest(text)]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "hashpartitioning" not in plan
    assert not any("raw_html" in line for line in below_exchanges(plan))


def below_exchanges(plan):
    """The lines of a plan that stand below an exchange, that is, what moves."""
    depth, out = None, []
    for line in plan.split("\n"):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth is not None and own <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "Exchange" in line:
            depth = own
    return out


def test_policy_reads_the_latest_run(spark):
    found = lifecycle.discover(spark.createDataFrame([(0, "a.com"), (1, "b.com")], "pos long, url string"),
                               make(spark, schemas.CANDIDATES), now())
    a = found.where("canonical_domain = 'a.com'").first().candidate_id
    runs = make(spark, schemas.CRAWL_RUNS, *[
        {"crawl_run_id": i, "candidate_id": a, "started_at": T0 + timedelta(hours=h), "http_status_code": s, "pages_crawled": 0,
         "used_browser": False} for i, h, s in ((1, 0, 200), (2, 2, 403), (3, 1, 200))])
    policy = {r.canonical_domain: (r.last_status_code, r.circuit_open) for r in crawling.domain_policy(found, runs).collect()}
    assert policy == {"a.com": (403, True), "b.com": (None, False)}


# --- candidate states -------------------------------------------------------------------------------


def test_trail_equals_a_fold_over_the_log(spark):
    rng = random.Random(5)
    log = [(c, e, T0 + timedelta(minutes=rng.randrange(500)), rng.choice(["success", "blocked"] + ["failed"] * 6 + ["timeout"] * 4))
           for e, c in enumerate([rng.randrange(30) if rng.random() < 0.66 else 0 for _ in range(400)])]
    expected = {}
    for c, e, at, outcome in sorted(log, key=lambda r: (r[0], r[2], r[1])):
        state, attempts, _ = expected.get(c, ("pending", 0, None))
        if state not in ("pending", "retry"):
            continue
        if outcome == "success":
            expected[c] = ("success", attempts, None)
            continue
        attempts += 1
        if outcome == "blocked" or attempts >= 5:
            expected[c] = ("blocked" if outcome == "blocked" else "abandoned", attempts, None)
        else:
            expected[c] = ("retry", attempts, at + timedelta(minutes=[2, 8, 32, 120, 480][attempts - 1]))
    df = spark.createDataFrame(log, "candidate_id long, event_id long, attempted_at timestamp, outcome string")
    trail = candidates.attempt_trail(df)
    got = {r.candidate_id: (r.state, r.attempts, r.next_attempt_at) for r in candidates.states_from_trail(trail).collect()}
    assert got == expected
    plan = trail._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a hot candidate is cut down before the shuffle


def candidate(**columns):
    return {"candidate_id": 1, "canonical_domain": "a.com", "source": "url_import", "state": "pending", "attempts": 0,
            "max_attempts": 5, "created_at": T0, "updated_at": T0} | columns


def test_claims(spark):
    rows = make(spark, schemas.CANDIDATES, candidate(), candidate(candidate_id=2, state="crawling", last_attempt_at=T0 - timedelta(minutes=31)),
                candidate(candidate_id=3, state="crawling", last_attempt_at=T0 - timedelta(minutes=29)),
                candidate(candidate_id=4, state="retry"), candidate(candidate_id=5, state="blocked"))
    claimed = candidates.claim(rows.withColumn("updated_at", F.lit("2020-01-01 00:00:00").cast("timestamp")), now()).collect()
    got = {r.candidate_id: (r.claimed, r.state) for r in claimed}
    assert all((r.updated_at == T0) == r.claimed for r in claimed)
    assert got == {1: (True, "crawling"), 2: (True, "crawling"), 3: (False, "crawling"), 4: (True, "crawling"), 5: (False, "blocked")}


def test_routing(spark):
    rows = make(spark, schemas.CANDIDATES, *[candidate(candidate_id=i, attempts=a) for i, a in enumerate((0, 3, 4, 2, 0, 0, 0))])
    outcomes = spark.createDataFrame(
        [(0, "timeout", None, False), (1, "failed", "no extractable pages", False), (2, "failed", None, False),
         (3, "blocked", None, False), (4, "success", None, False), (5, "success", None, True)],
        "candidate_id long, status string, reason string, storage_conflict boolean")
    got = {r.candidate_id: (r.state, r.attempts, r.failure_reason, r.next_attempt_at) for r in candidates.route_outcomes(rows, outcomes, now()).collect()}
    assert got == {
        0: ("retry", 1, "timeout", T0 + timedelta(minutes=2)), 1: ("retry", 4, "no extractable pages", T0 + timedelta(minutes=120)),
        2: ("abandoned", 5, "failed", None), 3: ("blocked", 3, "blocked", None), 4: ("success", 0, None, None),
        5: ("abandoned", 1, "duplicate_domain", None), 6: ("pending", 0, None, None)}


def test_an_open_circuit_keeps_a_claim_out(spark):
    rows = make(spark, schemas.CANDIDATES, candidate(candidate_id=1, canonical_domain="a.com"), candidate(candidate_id=2, canonical_domain="b.com"),
                candidate(candidate_id=3, canonical_domain="c.com"))
    policy = spark.createDataFrame([("a.com", True), ("b.com", False)], "canonical_domain string, circuit_open boolean")
    got = {r.candidate_id: (r.claimed, r.state) for r in candidates.claim(rows, now(), policy=policy).collect()}
    assert got == {1: (False, "pending"), 2: (True, "crawling"), 3: (True, "crawling")}


def test_due_retries_come_longest_due_first(spark):
    rows = make(spark, schemas.CANDIDATES, *[
        candidate(candidate_id=i, state=s, next_attempt_at=T0 - timedelta(minutes=m))
        for i, s, m in ((1, "retry", 5), (2, "retry", 9), (3, "retry", -1), (4, "blocked", 9))])
    assert [r.candidate_id for r in candidates.due_retries(rows, now()).collect()] == [2, 1]
    assert [r.candidate_id for r in candidates.due_retries(rows, now(), 1).collect()] == [2]


# --- verification and export ----------------------------------------------------------------------------


def contact(i, value, **columns):
    return {"contact_id": i, "business_id": i % 3, "type": "email", "value": value, "verification_attempts": 0, "created_at": T0} | columns


@pytest.fixture
def contact_table(spark):
    return make(
        spark, schemas.CONTACTS, contact(1, "a@mx.com"), contact(2, "b@nx.com"), contact(3, "c@down.com"),
        contact(4, "d@down.com", verification_attempts=4), contact(5, "e@odd.com", verification_status="pending"),
        contact(6, "f@mx.com", next_verification_attempt_at=T0 + timedelta(minutes=1)), contact(7, "g@mx.com", verification_status="verified"),
        contact(8, "+12024561111", type="phone"), contact(9, "stop@mx.com"), contact(10, "bad@"), contact(11, "new@unlisted.com"))


MX = [("mx.com", "mx"), ("nx.com", "nxdomain"), ("down.com", "unavailable"), ("odd.com", "inconclusive")]


@pytest.mark.parametrize("split", [False, True])
def test_verification_run(spark, request, contact_table, split):
    if split:
        request.getfixturevalue("shuffled_joins")
    stop = spark.createDataFrame([("stop@mx.com",), ("stop@mx.com",)], "email string")
    after, summary = lifecycle.verify(contact_table, stop, spark.createDataFrame(MX, "domain string, outcome string"), now())
    assert summary.first().asDict() == {
        "verified": 5, "skipped_suppressed": 1, "retried": 1, "exhausted": 1, "status_verified": 1, "status_invalid": 2, "status_unknown": 2}
    rows = {r.contact_id: (r.verification_status, r.verification_attempts, r.next_verification_attempt_at) for r in after.collect()}
    lease = T0 + timedelta(minutes=15)
    assert rows == {
        1: ("verified", 1, lease), 2: ("invalid", 1, lease), 3: (None, 1, T0 + timedelta(minutes=5)), 4: ("unknown", 5, None),
        5: ("unknown", 1, lease), 6: (None, 0, T0 + timedelta(minutes=1)), 7: ("verified", 0, None), 8: (None, 0, None),
        9: (None, 0, lease), 10: ("invalid", 1, lease), 11: ("unknown", 1, lease)}


def test_a_verification_batch_takes_the_oldest(spark):
    rows = make(spark, schemas.CONTACTS, contact(1, "a@b.com"), contact(2, "b@b.com", created_at=T0 - timedelta(days=1)))
    assert [r.contact_id for r in verification.lease(rows, now(), limit=1).collect()] == [2]


def test_a_missing_suppression_table_stops_everything(spark, contact_table, tmp_path):
    with pytest.raises(ValueError):
        lifecycle.verify(contact_table, None, spark.createDataFrame(MX, "domain string, outcome string"), now())
    with pytest.raises(ValueError):
        lifecycle.export(contact_table, make(spark, schemas.BUSINESSES), None, now(), str(tmp_path), "e")
    assert list(tmp_path.iterdir()) == []


def business(i, **columns):
    return {"business_id": i, "canonical_domain": f"{i}.com", "merge_status": "active", "created_at": T0, "updated_at": T0} | columns


@pytest.mark.parametrize("limit", [500, None])
def test_export_writes_then_stamps(spark, tmp_path, limit):
    contacts = make(spark, schemas.CONTACTS, *[contact(i, f"{i}@a.com", verification_status="verified" if i else None) for i in range(6)])
    businesses = make(spark, schemas.BUSINESSES, business(0, platform="wix"), business(1, platform="shopify"), business(2, platform="shopify"))
    stop = spark.createDataFrame([("4@a.com",)], "email string")
    path, stamped = lifecycle.export(contacts, businesses, stop, now(), str(tmp_path), "leads", platform="shopify", limit=limit)
    written = spark.read.option("header", True).csv(path)
    assert written.columns == ["business_id", "contact_id", "email", "verification_status"]
    assert sorted(r.contact_id for r in written.collect()) == ["1", "2", "5"]
    assert {r.contact_id for r in stamped.where("last_exported_at IS NOT NULL").collect()} == {1, 2, 5}
    with pytest.raises(OSError):
        lifecycle.export(contacts, businesses, stop, now(), str(tmp_path), "leads")
    with pytest.raises(ValueError):
        lifecycle.export(contacts, businesses, stop, now(), str(tmp_path), "other", fmt="xlsx")
    path, _ = lifecycle.export(contacts, businesses, stop, now(), str(tmp_path), "leads", fmt="json")
    assert spark.read.schema("email string").json(path).count() == 4


def test_suppression_comes_after_the_limit(spark):
    contacts = make(spark, schemas.CONTACTS, *[contact(i, f"{i}@a.com", verification_status="verified") for i in range(4)])
    businesses = make(spark, schemas.BUSINESSES, *[business(i) for i in range(3)])
    eligible = exporting.eligible_contacts(contacts, businesses, limit=2)
    stop = spark.createDataFrame([("0@a.com",)], "email string")
    assert [r.contact_id for r in exporting.exportable(eligible, stop).collect()] == [1]


# --- browsing, quality ---------------------------------------------------------------------------


def test_listing_and_tiles(spark):
    businesses = make(spark, schemas.BUSINESSES, business(1), business(2, name="Two", platform="wix", merge_status="possible_duplicate"))
    contacts = make(spark, schemas.CONTACTS, contact(1, "a@b.com"), contact(4, "+1", type="phone"), contact(9, "orphan@b.com"))
    socials = make(spark, schemas.SOCIAL_PROFILES, {"social_id": 1, "business_id": 2, "platform": "x", "url": "javascript:x", "created_at": T0})
    lines = browsing.business_listing(businesses, contacts, socials).orderBy("business_id", "part", "item_id").collect()
    assert [(r.business_id, r.kind, r.label, r.detail, r.link) for r in lines] == [
        (1, "business", "(no name)", "unknown platform", "1.com"), (1, "email", "a@b.com", "unverified", None),
        (1, "phone", "+1", "unverified", None), (2, "business", "Two", "wix", "2.com"), (2, "x", "javascript:x", "", None)]
    overview = browsing.business_overview(businesses, contacts, socials)
    assert browsing.dashboard(overview).first().asDict() == {
        "total": 2, "with_verified_email": 0, "awaiting_verification": 1, "no_contacts": 1}
    assert [r.business_id for r in browsing.filter_overview(overview, search="tWo").collect()] == [2]
    assert browsing.filter_overview(overview, exclude_duplicates=True, platform="wix").count() == 0
    assert [r.business_id for r in browsing.page_of(overview, 2, per_page=1).collect()] == [2]
    later = browsing.overview_page(businesses, contacts, socials, after=1, per_page=1)
    assert [(r.business_id, r.total) for r in later.collect()] == [(2, businesses.count())]
    assert later.drop("total").collect() == overview.where("business_id = 2").collect()


def test_batch_counts(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "candidate_id long")
    results = spark.createDataFrame([(1, "success"), (2, "abandoned"), (9, "success")], "candidate_id long, result string")
    assert browsing.batch_status(ids, results).first().asDict() == {"total": 3, "success": 1, "failed": 1, "pending": 1}


def test_quality_rules_find_faults(spark):
    tables = {
        "businesses": make(spark, schemas.BUSINESSES, business(1), business(1, merge_status="odd", duplicate_of_id=77)),
        "contacts": make(spark, schemas.CONTACTS, contact(1, None, business_id=5, type="fax", extraction_confidence=Decimal("1.50"))),
    }
    broken = {r.rule: r.violations for r in quality.quality_report(tables).where("violations > 0").collect()}
    assert broken.keys() >= {
        "unique businesses(business_id)", "unique businesses(canonical_domain)", "vocabulary businesses.merge_status",
        "foreign businesses.duplicate_of_id -> businesses", "foreign contacts.business_id -> businesses",
        "vocabulary contacts.type", "not null contacts.value", "range contacts.extraction_confidence"}


def test_append_log_partitions_by_day(spark, tmp_path):
    rows = make(spark, schemas.CRAWL_PAGES, {"crawl_run_id": 1, "url": "u", "fetched_at": T0})
    for _ in range(2):
        files.append_log(rows, str(tmp_path / "log"), "fetched_at")
    assert spark.read.parquet(str(tmp_path / "log")).where("day = '2024-06-01'").count() == 2


# --- skewed joins -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_a_plain_join(spark, shuffled_joins, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    left = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 60, 2)], "k long, v string")
    got = skew.skew_join(left, right, "k", how)
    plain = left.join(right, "k", how)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert [r.k for r in skew.hot_keys(left, ["k"]).collect()] == [0]


def test_a_small_right_side_is_broadcast_whole(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "r"))
    right = spark.read.schema("id long").parquet(str(tmp_path / "r"))
    plan = skew.skew_join(spark.range(1000), right, "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" not in plan
