"""Inputs of the registered queries, all derived from the given tables.

The stored pages carry hardly any contact signal, so every page gets deterministic additions keyed by
its id. The same SQL text builds them here and in the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom import schemas
from leadloom.functions import html as H, urls as U
from leadloom.functions.contacts import email_domain
from leadloom.functions.ids import stable_id
from leadloom.operators import extraction, merging, normalization
from leadloom.session import stage, tune

NOW = "2024-06-01 00:00:00"
EARLIER = "2024-01-01 00:00:00"

SIGNAL_HTML = """replace(replace(html, '</head>', concat(
  CASE WHEN page_id % 8 = 1 THEN concat('<meta property="og:title" content="OG ', cast(page_id % 20 AS STRING), '"><meta content="Shop ', cast(page_id % 20 AS STRING), '" property="og:site_name">') ELSE '' END,
  CASE WHEN page_id % 9 = 2 THEN '<meta name="description" content=" Fine caf&eacute; &#0000000066;ar goods &amp; more "><meta name="generator" content="WordPress 5.9 site">' ELSE '' END,
  CASE WHEN page_id % 12 = 5 THEN concat('<link title=', chr(39), '<meta name="generator" content="In a value"><meta property="og:title" content="In a value">', chr(39), ' href="/x.css">') ELSE '' END,
  '</head>')), '</body>', concat(
  CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json">{"@type":"Organization","name":"Store ', cast(page_id % 20 AS STRING), '","email":"Info', cast(page_id % 20 AS STRING), '@Shop', cast(page_id % 20 AS STRING), '.com","telephone":"+1 202 456 1', cast(200 + page_id % 20 AS STRING), '","address":{"addressLocality":"Halden","addressRegion":"VK","addressCountry":"NO"},"sameAs":["https://instagram.com/s', cast(page_id % 20 AS STRING), '"]}</script>') ELSE '' END,
  CASE WHEN page_id % 11 = 5 THEN concat('<script type="application/ld+json">[{"@type":["Thing","Product"],"name":"Widget ', cast(page_id % 13 AS STRING), '","category":"Widgets","sameAs":"https://www.youtube.com/w"},{"name":7}]</script>') ELSE '' END,
  CASE WHEN page_id % 20 IN (1, 7, 14) THEN concat('<script type="application/ld+json">{"@type":"Organization","email":"Kontakt@', CASE page_id % 20 WHEN 1 THEN 'München' WHEN 7 THEN 'xn--mnchen-3ya' ELSE 'münchen' END, '.de"}</script>') ELSE '' END,
  CASE WHEN page_id % 17 = 0 THEN '<script type="application/ld+json">{bad json,,</script>' ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('<a href="mailto:sales', cast(page_id % 15 AS STRING), '@shop.com?subject=x">Mail</a>') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<a href="tel:(202) 456-1', cast(100 + page_id % 30 AS STRING), '">Call</a>') WHEN page_id % 5 = 1 THEN '<a href="tel:123">Bad</a><a href="tel:+1 230 555 1234">Nowhere</a>' WHEN page_id % 5 = 2 THEN concat('<a href="tel:+33 000000000">Never</a><a href="tel:+33 1 42 68 53 ', cast(10 + page_id % 9 AS STRING), '">Ici</a>') WHEN page_id % 5 = 3 THEN '<a href="tel:237-555-1234">Nowhere</a>' ELSE '' END,
  CASE WHEN page_id % 6 = 0 THEN concat('<a href="https://www.facebook.com/p', cast(page_id % 9 AS STRING), '">f</a><a href="https://netflix.com/z">n</a><a href="https://twitter.com/t">t</a>') ELSE '' END,
  CASE WHEN page_id % 10 = 3 THEN concat('<p>Write to help', cast(page_id % 25 AS STRING), '@shop.com or bad..dots@shop.com today.</p>') ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN '<a href="/contact">c</a><a href="/about-us?x=1#y">a</a><a href="/collections/all">s</a><a href="/blog/news">b</a>' ELSE '<a href="/products/one">p</a><a href="/privacy-policy">v</a><a href="https://external.example/">e</a><a href="/">h</a>' END,
  CASE WHEN page_id % 7 = 0 THEN '<script src="https://cdn.shopify.com/s/theme.js"></script>' WHEN page_id % 7 = 1 THEN '<link href="/wp-content/plugins/woocommerce/a.css">' WHEN page_id % 7 = 2 THEN '<link href="/wp-content/themes/a.css">' WHEN page_id % 7 = 3 THEN '<img src="https://static.wixstatic.com/i.png">' ELSE '' END,
  CASE WHEN page_id % 12 < 3 THEN concat('<div title=', chr(39), '<a href="/in-a-value">x</a>', chr(39), '>d</div><a title=">" href="/behind-a-sign">y</a><abbr href="/abbr">z</abbr>') ELSE '' END,
  CASE WHEN page_id % 13 = 4 THEN concat('<a title="see href=foo now" href="/contact-real">q</a><a class="x"href="/about-tight">n</a><template><a href="/blog/in-template">t</a>hidden@shop.com</template><a ', repeat('data-x="v" ', 70), 'href="/products/many">m</a>') ELSE '' END,
  '</body>'))"""


def now():
    return F.lit(NOW).cast("timestamp")


def earlier():
    return F.lit(EARLIER).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages as ``(page_seq, url, raw_html)``."""
    tune(spark)
    return spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("page_seq"), "url", F.col("html").alias("raw_html")
    )


def signal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with their additions, as ``(page_seq, url, raw_html)``."""
    tune(spark)
    pages = spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("page_seq"), "url", F.expr(SIGNAL_HTML).alias("raw_html"))


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the pages with their first page, from the URL column alone."""
    pages = raw_pages(spark, sf_dir).select("page_seq", U.canonical_domain(F.col("url")).alias("canonical_domain"))
    return pages.groupBy("canonical_domain").agg(F.min("page_seq").alias("record_order"))


def known_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored businesses: hosts whose first page has an even id. Half of them lack a name."""
    hosts = page_domains(spark, sf_dir).where(F.col("record_order") % 2 == 0)
    named = F.when(F.col("record_order") % 4 == 0, F.concat(F.lit("Known "), F.col("canonical_domain")))
    unknown = F.when(F.col("record_order") % 4 == 0, "unknown")
    rows = hosts.select(
        stable_id(F.col("canonical_domain")).alias("business_id"),
        "canonical_domain",
        named.alias("name"),
        unknown.alias("platform"),
        F.when(F.col("record_order") % 4 == 0, 0.0).alias("platform_confidence"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "website", "description", "category", "subcategory", "country", "state", "city", "address")],
        F.lit("active").alias("merge_status"),
        F.lit(None).cast("long").alias("duplicate_of_id"),
        F.lit(None).cast("double").alias("match_score"),
        earlier().alias("created_at"),
        earlier().alias("updated_at"),
    )
    return schemas.conform(rows, schemas.BUSINESSES)


def known_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contacts: one sales address per stored business, shared by several of them."""
    hosts = page_domains(spark, sf_dir).where(F.col("record_order") % 2 == 0)
    observed = hosts.select(
        "canonical_domain",
        F.lit("email").alias("field_name"),
        F.concat(F.lit("sales"), (F.col("record_order") % 15).cast("string"), F.lit("@shop.com")).alias("field_value"),
        F.concat(F.lit("https://"), F.col("canonical_domain"), F.lit("/")).alias("source_url"),
        F.lit(0.97).alias("confidence"),
        F.col("record_order").alias("page_seq"),
        F.lit(0).alias("seq"),
    )
    return merging.contact_rows(observed, earlier())


def known_socials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored social profiles: of every known business one whose address some page repeats."""
    rows = known_businesses(spark, sf_dir).join(page_domains(spark, sf_dir), "canonical_domain").withColumn(
        "url", F.concat(F.lit("https://www.facebook.com/p"), (F.col("record_order") % 9).cast("string")))
    return schemas.conform(rows.select(
        stable_id(F.col("canonical_domain"), F.lit("known"), F.col("url")).alias("social_id"), "business_id", F.lit("facebook").alias("platform"),
        "url", F.concat(F.lit("https://"), F.col("canonical_domain"), F.lit("/")).alias("source_url"), earlier().alias("created_at"),
    ), schemas.SOCIAL_PROFILES)


def normalized_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized contact observations of the signal pages, written once for the branches that follow."""
    observed = extraction.observations(signal_pages(spark, sf_dir), ["contact"])
    return stage(normalization.normalized_contacts(observed), "contacts")


def contact_table(contacts: DataFrame) -> DataFrame:
    """Contact table of the observations, with verification states spread over it by a fixed rule."""
    rows = merging.contact_rows(contacts, earlier())
    n = F.length("source_url")
    return schemas.conform(
        rows.withColumns({
            "verification_status": F.when(F.col("type") == "email", F.when(n % 4 == 0, "verified").when(n % 4 == 1, "pending")),
            "verification_attempts": F.length("value") % 6,
            "next_verification_attempt_at": F.when(n % 3 == 1, now() - F.expr("INTERVAL 1 HOUR")).when(
                n % 3 == 2, now() + F.expr("INTERVAL 1 HOUR")
            ),
        }),
        schemas.CONTACTS,
    )


def suppression_list(contacts: DataFrame) -> DataFrame:
    """Suppressed emails: those whose trailing number is even."""
    emails = contacts.where(F.col("field_name") == "email").select(F.col("field_value").alias("email")).distinct()
    number = F.regexp_extract("email", r"([0-9]{1,9})@", 1)
    return emails.where((number != "") & (number.try_cast("int") % 2 == 0))


def mx_records(contacts: DataFrame) -> DataFrame:
    """Mail-exchanger outcome per email domain, by its length and its first number."""
    emails = contacts.where(F.col("field_name") == "email")
    domains = emails.select(email_domain(F.col("field_value")).alias("domain")).distinct()
    digits = F.regexp_extract("domain", "([0-9]{1,9})", 1)
    number = F.coalesce(digits.try_cast("int"), F.lit(0))
    kinds = F.array(*[F.lit(k) for k in ("mx", "nxdomain", "inconclusive", "unavailable", "no_answer")])
    return domains.withColumn("outcome", F.element_at(kinds, (F.length("domain") + number) % 5 + 1))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal pages as a log of fetches; a domain's pages of one hour are one crawl."""
    kind = F.col("page_seq") % 10
    ok = kind <= 5
    status = (
        F.when(kind <= 4, 200).when(kind == 5, 304).when(kind == 6, 403).when(kind == 7, 429).when(kind == 8, 500)
    )
    thin = H.visible_length(H.visible_markup(F.col("raw_html"))) < 50
    return signal_pages(spark, sf_dir).select(
        U.canonical_domain(F.col("url")).alias("canonical_domain"),
        F.floor(F.col("page_seq") / 60).alias("crawl_no"),
        "page_seq",
        "url",
        U.page_type(U.path(F.col("url"))).alias("page_type"),
        F.when(thin, "browser").otherwise("http").alias("fetched_via"),
        status.alias("http_status_code"),
        (kind == 9).alias("is_timeout"),
        F.when(ok, H.content_hash(F.col("raw_html"))).alias("content_hash"),
        (kind <= 4).alias("has_body"),
        (kind == 5).alias("from_cache"),
        (earlier() + F.make_dt_interval(mins=F.col("page_seq").cast("int"))).alias("fetched_at"),
    )


def cached_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A former page cache: two thirds of the pages, some with another content."""
    pages = signal_pages(spark, sf_dir).where(F.col("page_seq") % 3 != 0)
    digest = H.content_hash(F.col("raw_html"))
    rows = pages.select(
        "url",
        F.when(F.col("page_seq") % 5 == 0, F.concat(F.lit("old-"), digest)).otherwise(digest).alias("content_hash"),
        F.lit(200).alias("status_code"),
        F.when(F.col("page_seq") % 2 == 0, F.concat(F.lit("etag-"), F.col("page_seq").cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        earlier().alias("fetched_at"),
        "page_seq",
    )
    newest = rows.groupBy("url").agg(F.max_by(F.struct("content_hash", "status_code", "etag", "last_modified", "fetched_at"), "page_seq").alias("row"))
    return schemas.conform(newest.select("url", "row.*"), schemas.PAGE_CACHE)


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per host: even name lengths disallow the blog, odd ones allow it; all shut one shelf."""
    hosts = page_domains(spark, sf_dir).select(F.col("canonical_domain").alias("host"))
    rules = F.array(
        F.struct(F.lit(0).alias("seq"), (F.length("host") % 2 == 1).alias("allow"), F.lit("/blog/").alias("path")),
        F.struct(F.lit(1).alias("seq"), F.lit(True).alias("allow"), F.lit("/collections/all").alias("path")),
        F.struct(F.lit(2).alias("seq"), F.lit(False).alias("allow"), F.lit("/collections").alias("path")),
        F.struct(F.lit(3).alias("seq"), F.lit(False).alias("allow"), F.lit("/en/4").alias("path")),
    )
    return stage(hosts.select("host", F.inline(rules)), "robots")


#: Files of hosts by the length of their names: comments, groups, blank lines, escapes, agents of others.
ROBOTS_FILES = (
    "# all\nUser-agent: *\nDisallow: /blog/ # no blog\nAllow: /collections/all\nDisallow: /collections\n",
    "User-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow:\n",
    "User-agent: *\nDisallow: /\n\nUSER-AGENT: lead\nuser-agent: bot\nCrawl-delay: 2\nDisallow: /%65n/\nDisallow /broken\n",
    "Disallow: /\n\nUser-agent: *\n\nDisallow: /blog\nUser-agent: *\nAllow: /pt\r\nDisallow: *\n",
    "<html>not found</html>",
)
AGENT = "LeadLoom/1.0"


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file per host, picked by the length of its name; some may not be read, some are missing."""
    hosts = page_domains(spark, sf_dir).select(F.col("canonical_domain").alias("host"))
    pick = F.length("host") % 7
    status = F.when(pick == 5, 403).when(pick == 6, 404).otherwise(200)
    bodies = F.array(*[F.lit(body) for body in ROBOTS_FILES])
    return stage(hosts.select("host", status.alias("status"), F.element_at(bodies, F.least(pick, F.lit(4)) + 1).alias("body")), "robots")


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempt outcomes; a user's day is a candidate."""
    outcome = (
        F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "blocked")
        .when(F.col("event_type") == "error", "timeout").otherwise("failed")
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("candidate_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("attempted_at"),
        outcome.alias("outcome"),
    )
