"""Crawl logs and page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom import fixed_values as V, schemas
from leadloom.functions import html as H, urls as U
from leadloom.functions.ids import stable_id
from leadloom.operators.pages import fresh_pages
from leadloom.operators.skew import skew_join
from leadloom.session import spread_small, stage


def thin_pages(pages: DataFrame) -> DataFrame:
    """``(page_seq, url, visible_length, is_thin)``: too little text means a script-built page."""
    length = H.visible_length(H.visible_markup(F.col("raw_html")))
    return spread_small(pages, "page_seq").select("page_seq", "url", length.alias("visible_length")).withColumn(
        "is_thin", F.col("visible_length") < V.MIN_VISIBLE_TEXT
    )


def is_unchanged(cached_hash: Column) -> Column:
    """Whether a page's text is that of its cached copy; never for a homepage, which is always read."""
    unchanged = H.content_hash(F.col("raw_html")).eqNullSafe(cached_hash)
    return F.coalesce(unchanged & ~U.path(F.col("url")).isin("", "/"), F.lit(False))


def changed_pages(pages: DataFrame, page_cache: DataFrame) -> DataFrame:
    """Pages worth reading again: changed since the cached copy, never cached, or a homepage.

    The hash is computed before the join, so the page text never moves.
    """
    hashed = pages.select(
        "page_seq", "url", H.content_hash(F.col("raw_html")).alias("content_hash"),
        U.path(F.col("url")).isin("", "/").alias("is_homepage"),
    )
    cached = page_cache.select("url", F.col("content_hash").alias("cached_hash"))
    unchanged = F.col("content_hash").eqNullSafe(F.col("cached_hash"))
    return skew_join(hashed, cached, "url", "left", write_left=True).withColumn(
        "from_cache", unchanged & ~F.col("is_homepage")
    ).select("page_seq", "url", "content_hash", "is_homepage", "from_cache")


def candidate_links(pages: DataFrame, seed_scheme: Column | None = None) -> DataFrame:
    """Distinct in-site URLs linked from the stored pages of each domain, classified and ranked.

    Links are resolved and made distinct inside each page first, so little is left to shuffle.
    """
    scheme = seed_scheme if seed_scheme is not None else F.lit("https")
    found = spread_small(fresh_pages(pages), "page_seq").select(
        U.canonical_domain(F.col("url")).alias("canonical_domain"),
        scheme.alias("scheme"),
        H.links(H.tags(H.visible_markup(F.col("raw_html")), "a")).alias("hrefs"),
    )
    in_site = F.transform(
        F.col("hrefs"), lambda href: U.resolve_link(F.col("scheme"), F.col("canonical_domain"), href)
    )
    exploded = found.select("canonical_domain", F.explode(F.array_distinct(F.array_compact(in_site))).alias("url"))
    distinct = exploded.distinct().withColumn("path", U.path(F.col("url")))
    return distinct.select(
        "canonical_domain", "url", U.page_type(F.col("path")).alias("page_type"),
        U.page_priority(F.col("path")).alias("priority"),
    )


def top_pages(links: DataFrame, max_pages: int = V.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """The best ``max_pages - 1`` URLs per domain, priority first, then URL.

    Spark keeps only that many rows per domain and task before it shuffles, so a hot domain is small.
    """
    ranked = Window.partitionBy("canonical_domain").orderBy(F.desc("priority"), "url")
    return links.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max_pages - 1)


# Line ends, and the names of the lines that belong to a group of agents.
_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_RULE_LINES = ("allow", "disallow", "crawl-delay", "request-rate")


def percent_normalized(path: Column) -> Column:
    """A path with its percent escapes decoded and written anew, so that spellings of one path are equal."""
    whole = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    encoded = F.url_encode(F.coalesce(F.try_url_decode(whole), path))
    for written, meant in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(written), F.lit(meant))
    return encoded


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``(host, seq, allow, path)``: what robots files say to ``agent``, in the order in which rules count.

    ``robots(host, status, body)`` has a row per host. A file groups lines: names of agents and then rules, ended by
    a blank line or the next names. The first group one of whose names is part of the agent's name before
    its version counts, else the first group for ``*``. A file that may not be read, by status 401 or 403, shuts
    everything; one that is missing or could not be fetched shuts nothing. Lines are numbered and groups found by
    windows over the lines of a host, so a file of any length is read in linear time.
    """
    fetched = robots.where("status between 200 and 299 and body is not null")
    lines = fetched.select("host", F.posexplode(F.split("body", _LINE_ENDS)).alias("pos", "line"))
    text = F.trim(F.substring_index("line", "#", 1), F.lit(H.BLANKS))
    name, colon = F.lower(F.trim(F.substring_index(text, ":", 1), F.lit(H.BLANKS))), F.instr(text, ":")
    kind = (
        F.when(F.col("line") == "", "blank").when(colon == 0, None).when(name == "user-agent", "agent")
        .when(name.isin(*_RULE_LINES), "rule")
    )
    value = F.trim(F.substring(text, colon + 1, F.length(text)), F.lit(H.BLANKS))
    known = lines.select("host", "pos", kind.alias("kind"), name.alias("name"), value.alias("value")).where("kind is not null")
    in_order = Window.partitionBy("host").orderBy("pos")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("pos"))).over(upto), F.lit(-1))
    begins = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_order), F.lit("")) != "agent")
    grouped = known.select(
        "*", F.sum(begins.cast("long")).over(upto).alias("group"), (last("agent") > last("blank")).alias("open"),
    ).where("open")  # rules after a blank line belong to nobody
    # A group without a rule line does not count, whatever it names.
    short = agent.split("/")[0].lower()
    named = F.lower(F.trim(F.col("value"), F.lit(H.BLANKS)))
    groups = grouped.groupBy("host", "group").agg(
        F.bool_or(F.col("kind") == "rule").alias("ruled"),
        F.bool_or((F.col("kind") == "agent") & (F.col("value") == "*")).alias("default"),
        F.bool_or((F.col("kind") == "agent") & F.lit(short).contains(named)).alias("meant"),
    ).where("ruled and (default or meant)")
    chosen = groups.groupBy("host").agg(F.min(F.struct("default", "group")).alias("first")).select("host", "first.group")
    path = percent_normalized(F.col("value"))  # a sign like ``*`` stands for itself in a file
    rules = skew_join(grouped.where("name in ('allow', 'disallow')"), chosen, ["host", "group"], "left_semi").select(
        "host", F.col("pos").alias("seq"), (F.col("name") == "allow").alias("allow"), path.alias("path"))
    shut = robots.where("status in (401, 403)").select(
        "host", F.lit(0).alias("seq"), F.lit(False).alias("allow"), F.lit("*").alias("path"))
    return rules.unionByName(shut)


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(canonical_domain, url, ...)`` that the rules of their host allow.

    ``rules(host, seq, allow, path)``, as ``robots_rules`` makes them of files: the first rule whose path starts the URL's path decides, and
    no rule means allowed. An empty path allows everything and ``*`` matches everything. Instead of
    comparing every URL with every rule, a URL looks up its own prefixes, at the rule lengths its host
    uses. Those are at most as many as a path has characters.
    """
    everything = F.col("path").isin("", "*")
    prefixed = rules.select(
        F.col("host").alias("canonical_domain"),
        F.when(everything, "/").otherwise(percent_normalized(F.col("path"))).alias("prefix"),
        "seq",
        (F.col("allow") | (F.col("path") == "")).alias("allow"),
    )
    first_rules = prefixed.groupBy("canonical_domain", "prefix").agg(F.min(F.struct("seq", "allow")).alias("rule"))
    lengths = first_rules.groupBy("canonical_domain").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    targets = urls.select("canonical_domain", "url").distinct()
    without_fragment = F.regexp_replace(F.col("url"), r"#.*$", "")
    with_query = F.regexp_replace(without_fragment, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?]*", "")
    path = percent_normalized(F.when(with_query.startswith("/"), with_query).otherwise(F.concat(F.lit("/"), with_query)))
    usable = F.filter(F.col("lengths"), lambda n: n <= F.length("path"))
    prefixes = (
        skew_join(targets, lengths, "canonical_domain")
        .withColumn("path", path)
        .select("canonical_domain", "url", "path", F.explode(usable).alias("n"))
        .select("canonical_domain", "url", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix"))
    )
    decided = (
        skew_join(prefixes, first_rules, ["canonical_domain", "prefix"], write_left=True)
        .groupBy("canonical_domain", "url")
        .agg(F.min("rule").alias("rule"))
    )
    denied = stage(decided.where(~F.col("rule.allow")).select("canonical_domain", "url"), "denied")
    return skew_join(urls, denied, ["canonical_domain", "url"], "left_anti").select(*urls.columns)


def select_pages(pages: DataFrame, rules: DataFrame | None = None, max_pages: int = V.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """Pages to read next per domain: rank the linked URLs, take the best, drop disallowed ones."""
    chosen = top_pages(candidate_links(pages), max_pages)
    return chosen if rules is None else allowed_by_robots(chosen, rules)


def classify_fetch(status: Column, is_timeout: Column) -> Column:
    """Why a homepage fetch failed; NULL when it did not."""
    ok = status.between(200, 399)
    return (
        F.when(is_timeout, "timeout")
        .when(status.isin(*V.BLOCKING_STATUS_CODES), "blocked")
        .when(F.coalesce(~ok, F.lit(True)), "failed")
    )


def crawl_runs(fetch_log: DataFrame, now: Column) -> DataFrame:
    """One row per crawl of a domain from its fetch log.

    ``fetch_log`` has a row per fetched page: ``canonical_domain, crawl_no, page_seq, url, page_type,
    fetched_via, http_status_code, is_timeout, content_hash, has_body, from_cache, fetched_at``. The
    first page is the homepage; its failure decides the crawl. The status code is that of the
    homepage fetch, failed or not, so a later circuit check can see a block. A failed page counts
    neither as crawled nor as content.
    """
    failure = classify_fetch(F.col("http_status_code"), F.col("is_timeout"))
    log = fetch_log.withColumn("failure", failure)
    kept = F.col("failure").isNull()
    runs = log.groupBy("canonical_domain", "crawl_no").agg(
        F.min("fetched_at").alias("started_at"),
        F.max("fetched_at").alias("completed_at"),
        F.min_by(F.struct("http_status_code", "failure"), "page_seq").alias("home"),
        F.count(F.when(kept, 1)).alias("kept"),
        F.bool_or(kept & (F.col("fetched_via") == "browser")).alias("browser"),
        F.bool_or(kept & F.col("has_body") & ~F.col("from_cache")).alias("readable"),
    )
    failed_home = F.col("home.failure")
    code = F.col("home.http_status_code")
    status = F.coalesce(failed_home, F.when(F.col("readable"), "success").otherwise("failed"))
    message = (
        F.when(failed_home == "timeout", "timeout")
        .when(failed_home.isNotNull(), F.concat(F.lit("HTTP "), code.cast("string")))
        .when(~F.col("readable"), "no extractable pages")
    )
    return schemas.conform(
        runs.select(
            stable_id(F.col("canonical_domain"), F.col("crawl_no")).alias("crawl_run_id"),
            stable_id(F.col("canonical_domain")).alias("candidate_id"),
            F.coalesce("started_at", now).alias("started_at"),
            F.coalesce("completed_at", now).alias("completed_at"),
            status.alias("status"),
            code.alias("http_status_code"),
            F.when(failed_home.isNull(), F.col("kept")).otherwise(0).alias("pages_crawled"),
            (failed_home.isNull() & F.col("browser")).alias("used_browser"),
            message.alias("error_message"),
        ),
        schemas.CRAWL_RUNS,
    )


def crawl_pages(fetch_log: DataFrame) -> DataFrame:
    """Log rows of the pages that were fetched without an error."""
    ok = classify_fetch(F.col("http_status_code"), F.col("is_timeout")).isNull()
    rows = fetch_log.where(ok).withColumn("crawl_run_id", stable_id(F.col("canonical_domain"), F.col("crawl_no")))
    return schemas.conform(rows, schemas.CRAWL_PAGES)


def upsert_page_cache(page_cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Next state of the page cache: the newest fetch of a URL replaces hash, status and time.

    ``etag`` and ``last_modified`` of a stored row stay. At equal times the new fetch wins.
    """
    new = fetched.select(
        "url", "content_hash", F.col("http_status_code").alias("status_code"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        "fetched_at", F.lit(1).alias("is_new"), F.col("page_seq").alias("tie"),
    )
    old = page_cache.select(
        *[f.name for f in schemas.PAGE_CACHE.fields], F.lit(0).alias("is_new"), F.lit(-1).cast("long").alias("tie")
    )
    latest = old.unionByName(new).groupBy("url").agg(
        F.max_by(
            F.struct("content_hash", "status_code", "fetched_at"), F.struct("fetched_at", "is_new", "tie")
        ).alias("row"),
        F.max("etag").alias("etag"),
        F.max("last_modified").alias("last_modified"),
    )
    return schemas.conform(
        latest.select("url", "row.content_hash", "row.status_code", "etag", "last_modified", "row.fetched_at"),
        schemas.PAGE_CACHE,
    )


def cached_pages(page_cache: DataFrame, pages: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct cached pages per domain, for all domains at once.

    The page log is cut to distinct run and URL pairs first; each later join meets a unique key.
    """
    visits = pages.select("crawl_run_id", "url").distinct()
    by_candidate = (
        skew_join(visits, runs.select("crawl_run_id", "candidate_id"), "crawl_run_id")
        .select("candidate_id", "url")
        .distinct()
    )
    by_domain = skew_join(by_candidate, candidates.select("candidate_id", "canonical_domain"), "candidate_id")
    return by_domain.select("canonical_domain", "url").distinct().join(
        page_cache.select("url", "content_hash", "etag", "last_modified"), "url"
    ).select("canonical_domain", "url", "content_hash", "etag", "last_modified")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per candidate, as ``(candidate_id, crawl_run_id, status, http_status_code)``."""
    newest = runs.groupBy("candidate_id").agg(
        F.max_by(
            F.struct("crawl_run_id", "status", "http_status_code"), F.struct("started_at", "crawl_run_id")
        ).alias("run")
    )
    return newest.select("candidate_id", "run.*")


def domain_policy(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures, last attempt and last status per domain, and whether it may be crawled now."""
    last = latest_runs(runs).select("candidate_id", F.col("http_status_code").alias("last_status_code"))
    return candidates.join(last, "candidate_id", "left").select(
        "canonical_domain",
        F.col("attempts").alias("consecutive_failures"),
        "last_status_code",
        "last_attempt_at",
        F.coalesce(F.col("last_status_code").isin(*V.BLOCKING_STATUS_CODES), F.lit(False)).alias("circuit_open"),
    )
