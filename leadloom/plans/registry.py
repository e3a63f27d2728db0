"""Registered queries: each runs one job of the library over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom import fixed_values as V, schemas
from leadloom.functions import contacts as FC, urls as U
from leadloom.operators import (
    browsing, candidates, crawling, detection, discovery, exporting, extraction, merging, normalization, quality,
    resolution, verification,
)
from leadloom.functions.ids import stable_id
from leadloom.plans import corpus, lifecycle
from leadloom.plans.corpus import earlier, now
from leadloom.session import run_folder, stage, tune
from leadloom.sources import files
from leadloom.sources.tables import Store
from leadloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _at_rest(df: DataFrame) -> DataFrame:
    """Decimals of stored tables as doubles, for comparison."""
    return df.select([
        F.col(f.name).cast("double").alias(f.name) if f.dataType == schemas.UNIT else F.col(f.name)
        for f in df.schema.fields
    ])


# --- flagship ------------------------------------------------------------------------------------


@query
def domain_emails(spark, sf_dir):
    """Which emails does each domain publish, where first, and with what confidence."""
    observed = extraction.observations(corpus.signal_pages(spark, sf_dir), ["contact"])
    emails = normalization.normalized_contacts(observed).where(F.col("field_name") == "email")
    best = F.struct(F.col("confidence"), -F.col("page_seq"), -F.col("seq"))
    return emails.groupBy("canonical_domain", F.col("field_value").alias("email")).agg(
        F.count(F.lit(1)).alias("observations"),
        F.max("confidence").alias("confidence"),
        F.max_by("extraction_method", best).alias("extraction_method"),
        F.max_by("source_url", best).alias("source_url"),
    )


# --- URLs and discovery -------------------------------------------------------------------------------


@query
def canonical_domains(spark, sf_dir):
    pages = corpus.raw_pages(spark, sf_dir).select("page_seq", "url")
    domain, scheme = U.canonical_domain(F.col("url")), U.scheme(F.col("url"))
    return pages.select(
        "page_seq", domain.alias("canonical_domain"), scheme.alias("scheme"), U.seed_url(scheme, domain).alias("seed_url"),
        U.path(F.col("url")).alias("path"), U.page_type(U.path(F.col("url"))).alias("page_type"),
        U.page_priority(U.path(F.col("url"))).alias("priority"),
    )


@query
def discover_new(spark, sf_dir):
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    found = lifecycle.discover(urls, corpus.known_businesses(spark, sf_dir), now())
    return found.select(
        "candidate_id", "canonical_domain", "source", "state", "attempts",
        F.col("discovery_metadata")["scheme"].alias("scheme"),
    )


@query
def hinted_candidates(spark, sf_dir):
    """Candidates of a provider that knows a name for every other page."""
    pages = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), F.col("url").alias("raw_url"))
    found = pages.select(
        "*", F.lit("directory").alias("source"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Shop "), "pos")).alias("name_hint"),
        F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("scheme"), F.lit("given"))).alias("discovery_metadata"),
    )
    hinted = discovery.new_candidates(found, corpus.known_businesses(spark, sf_dir), now())
    return hinted.select("candidate_id", "canonical_domain", "source", F.col("discovery_metadata")["name_hint"].alias("name_hint"),
                         F.col("discovery_metadata")["scheme"].alias("scheme"))


@query
def url_list_parse(spark, sf_dir):
    """Two lists, one as CSV lines, joined in order without repeats."""
    pages = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    seed = U.seed_url(F.lit("https"), U.canonical_domain(F.col("url")))
    typed = pages.select("pos", F.concat(F.lit("  "), seed, F.lit(" ")).alias("value"))
    uploaded = pages.select("pos", F.concat(F.col("url"), F.lit(" ,shop,"), F.col("pos").cast("string")).alias("value"))
    return discovery.combine_url_sources(discovery.parse_url_lines(typed), discovery.parse_url_lines(uploaded))


@query
def import_limited(spark, sf_dir):
    """The first hundred pages as a discovery batch: the import limit is the feature."""
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    return discovery.import_urls(urls, V.DISCOVERY_LIMIT).select("pos", "raw_url", "source")


@query
def candidate_seeds(spark, sf_dir):
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    nothing = spark.createDataFrame([], schemas.CANDIDATES)
    return discovery.candidate_seed_urls(lifecycle.discover(urls, nothing, now()))


@query
def candidate_lookup(spark, sf_dir):
    """Domains of the ids that customers and pages ask for; unknown ids are reported as such."""
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    known = lifecycle.discover(urls, corpus.known_businesses(spark, sf_dir), now())
    asked = corpus.page_domains(spark, sf_dir).select(stable_id(F.col("canonical_domain")).alias("candidate_id"))
    return discovery.lookup_candidates(asked, known)


@query
def criteria_dedupe(spark, sf_dir):
    """Discovery requests made of customers' nations and segments, repeats collapsed by hash."""
    customers = corpus.table(spark, sf_dir, "customer")
    requests = customers.select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("location"),
        F.col("c_mktsegment").alias("category"),
        F.array(F.lit("shop"), F.lower("c_mktsegment")).alias("a"),
        F.array(F.lower("c_mktsegment"), F.lit("shop")).alias("b"),
        (F.col("c_custkey") % 2 == 0).alias("swapped"),
    )
    hashed = requests.withColumn(
        "criteria_hash",
        discovery.criteria_hash(
            F.col("location"), F.col("category"), F.lit(None).cast("string"),
            F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")),
            F.array().cast("array<string>"), F.lit(100),
        ),
    )
    return hashed.groupBy("criteria_hash").agg(
        F.min("location").alias("location"), F.min("category").alias("category"), F.count(F.lit(1)).alias("requests")
    )


# --- page selection and crawl filters ------------------------------------------------------------------


@query
def page_links(spark, sf_dir):
    return extraction.page_links(corpus.signal_pages(spark, sf_dir))


@query
def select_pages(spark, sf_dir):
    return crawling.select_pages(corpus.signal_pages(spark, sf_dir)).select(
        "canonical_domain", "url", "page_type", "priority", "rank"
    )


@query
def select_allowed_pages(spark, sf_dir):
    links = stage(crawling.candidate_links(corpus.signal_pages(spark, sf_dir)), "links")
    chosen = crawling.top_pages(links)
    return crawling.allowed_by_robots(chosen, corpus.robots_rules(spark, sf_dir)).select(
        "canonical_domain", "url", "page_type", "priority", "rank"
    )


@query
def robots_filter(spark, sf_dir):
    pages = corpus.raw_pages(spark, sf_dir).select("page_seq", "url", U.canonical_domain(F.col("url")).alias("canonical_domain"))
    return crawling.allowed_by_robots(pages, corpus.robots_rules(spark, sf_dir)).select("page_seq", "canonical_domain", "url")


@query
def robots_from_files(spark, sf_dir):
    """The rules that the hosts' robots files have for this crawler."""
    return crawling.robots_rules(corpus.robots_files(spark, sf_dir), corpus.AGENT)


@query
def pages_allowed_by_files(spark, sf_dir):
    """Pages that the hosts' robots files allow."""
    pages = corpus.raw_pages(spark, sf_dir).select("page_seq", "url", U.canonical_domain(F.col("url")).alias("canonical_domain"))
    rules = stage(crawling.robots_rules(corpus.robots_files(spark, sf_dir), corpus.AGENT), "robots-rules")
    return crawling.allowed_by_robots(pages, rules).select("page_seq", "canonical_domain", "url")


@query
def thin_pages(spark, sf_dir):
    return crawling.thin_pages(corpus.raw_pages(spark, sf_dir))


@query
def changed_pages(spark, sf_dir):
    return crawling.changed_pages(corpus.signal_pages(spark, sf_dir), corpus.cached_copy(spark, sf_dir))


# --- extraction ----------------------------------------------------------------------------------------


def _observed(spark, sf_dir, *sections):
    return extraction.observations(corpus.signal_pages(spark, sf_dir), sections or extraction.SECTIONS)


@query
def json_ld_fields(spark, sf_dir):
    """JSON-LD fields among the business fields and products."""
    return _observed(spark, sf_dir, "business", "product").where(F.col("extraction_method") == "json-ld")


@query
def html_meta_fields(spark, sf_dir):
    return _observed(spark, sf_dir, "business", "generator").where(F.col("extraction_method") != "json-ld")


@query
def business_fields(spark, sf_dir):
    return _observed(spark, sf_dir, "business")


@query
def product_fields(spark, sf_dir):
    return _observed(spark, sf_dir, "product")


@query
def contact_observations(spark, sf_dir):
    return _observed(spark, sf_dir, "contact")


@query
def social_observations(spark, sf_dir):
    return _observed(spark, sf_dir, "social")


@query
def strict_social_observations(spark, sf_dir):
    return extraction.observations(corpus.signal_pages(spark, sf_dir), ["social"], strict_socials=True)


@query
def all_observations(spark, sf_dir):
    return _observed(spark, sf_dir)


@query
def document_emails(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = extraction.text_emails(docs, "doc_id", "text")
    return found.withColumn("email", FC.normalize_email(F.col("raw_email")))


@query
def document_phones(spark, sf_dir):
    """Phone-shaped parts of documents, normalized; numbers that are none come out NULL."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    shaped = F.regexp_extract_all(F.col("text"), F.lit(r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"), F.lit(0))
    found = docs.select("doc_id", F.posexplode(F.array_distinct(shaped)).alias("seq", "raw_phone"))
    return found.withColumn("phone", FC.normalize_phone(F.col("raw_phone")))


# --- platform ------------------------------------------------------------------------------------------


@query
def platform_evidence(spark, sf_dir):
    return detection.platform_evidence(corpus.signal_pages(spark, sf_dir))


@query
def platform_by_domain(spark, sf_dir):
    evidence = detection.platform_evidence(corpus.signal_pages(spark, sf_dir))
    return detection.platform_by_domain(corpus.page_domains(spark, sf_dir), evidence)


@query
def platform_with_hint(spark, sf_dir):
    pages = corpus.signal_pages(spark, sf_dir)
    hints = detection.generator_hints(extraction.observations(pages, ["generator"]))
    return detection.platform_by_domain(corpus.page_domains(spark, sf_dir), detection.platform_evidence(pages), hints)


@query
def winning_evidence(spark, sf_dir):
    evidence = stage(detection.platform_evidence(corpus.signal_pages(spark, sf_dir)), "evidence")
    platforms = detection.platform_by_domain(corpus.page_domains(spark, sf_dir), evidence)
    return detection.winning_evidence(evidence, platforms)


# --- records -------------------------------------------------------------------------------------------


@query
def best_business_fields(spark, sf_dir):
    return normalization.best_fields(_observed(spark, sf_dir, "business"))


@query
def normalized_contacts(spark, sf_dir):
    return normalization.normalized_contacts(_observed(spark, sf_dir, "contact"))


def _records(spark, sf_dir) -> lifecycle.Records:
    return lifecycle.normalize(lifecycle.extract(corpus.signal_pages(spark, sf_dir)))


def _confidence_text(df: DataFrame) -> DataFrame:
    """The bounded confidence map as text, ``field=confidence`` by field name."""
    entries = F.array_sort(F.map_entries("field_confidence"))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 2))), ","
    )
    return df.withColumn("field_confidence", text)


@query
def normalized_records(spark, sf_dir):
    return _confidence_text(_records(spark, sf_dir).headers)


def _resolution(spark, sf_dir, records: lifecycle.Records) -> DataFrame:
    return lifecycle.resolve(
        records, corpus.known_businesses(spark, sf_dir), corpus.known_contacts(spark, sf_dir)
    )


@query
def validate_records(spark, sf_dir):
    records = _records(spark, sf_dir)
    checked = lifecycle.validated_records(records, _resolution(spark, sf_dir, records))
    return checked.select(
        "canonical_domain", "is_valid", F.array_join("validation_errors", "; ").alias("validation_errors"),
        "n_contacts", "n_socials", "action",
    )


@query
def match_pairs(spark, sf_dir):
    """Up to twenty stored businesses per record, best first."""
    contacts = corpus.normalized_contacts(spark, sf_dir)
    businesses = corpus.known_businesses(spark, sf_dir)
    stored = resolution.stored_contact_values(businesses, corpus.known_contacts(spark, sf_dir))
    return resolution.match_candidates(
        corpus.page_domains(spark, sf_dir), lifecycle.contact_values(contacts), businesses, stored,
        V.MATCH_CANDIDATE_LIMIT,
    )


@query
def best_matches(spark, sf_dir):
    return resolution.best_match(match_pairs(spark, sf_dir))


@query
def resolve_entities(spark, sf_dir):
    contacts = corpus.normalized_contacts(spark, sf_dir)
    businesses = corpus.known_businesses(spark, sf_dir)
    stored = resolution.stored_contact_values(businesses, corpus.known_contacts(spark, sf_dir))
    return resolution.resolve(
        corpus.page_domains(spark, sf_dir), lifecycle.contact_values(contacts), businesses, stored
    )


# --- merging -------------------------------------------------------------------------------------------


@query
def merge_businesses(spark, sf_dir):
    records = _records(spark, sf_dir)
    resolved = stage(_resolution(spark, sf_dir, records), "resolution")
    return _at_rest(merging.merge_businesses(corpus.known_businesses(spark, sf_dir), records.headers, resolved, now()))


@query
def contacts_upsert(spark, sf_dir):
    contacts = normalization.normalized_contacts(_observed(spark, sf_dir, "contact"))
    merged = merging.insert_absent(
        corpus.known_contacts(spark, sf_dir), merging.contact_rows(contacts, now()), ["business_id", "type", "value"]
    )
    return _at_rest(merged).select(
        "contact_id", "business_id", "type", "value", "source_url", "extraction_confidence", "verification_attempts",
        "created_at",
    )


@query
def socials_upsert(spark, sf_dir):
    """Stored profiles and those that pages add; a stored one stays as it is."""
    socials, known = _observed(spark, sf_dir, "social"), stage(corpus.known_socials(spark, sf_dir), "known-socials")
    return merging.insert_absent(known, merging.social_rows(socials, now()), ["business_id", "platform", "url"])


@query
def evidence_log(spark, sf_dir):
    records = _records(spark, sf_dir)
    return _at_rest(merging.evidence_rows(records.contacts, records.socials, records.evidence, now()))


@query
def finished_candidates(spark, sf_dir):
    """Candidates of all pages after their records were stored."""
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    nothing = spark.createDataFrame([], schemas.CANDIDATES)
    found = lifecycle.discover(urls, nothing, earlier())
    done = merging.finish_candidates(found, resolve_entities(spark, sf_dir), now())
    return done.select("candidate_id", "canonical_domain", "state", "attempts", "business_id", "updated_at")


# --- crawl logs ----------------------------------------------------------------------------------------


@query
def crawl_run_summary(spark, sf_dir):
    return crawling.crawl_runs(corpus.fetch_log(spark, sf_dir), now())


@query
def crawl_page_log(spark, sf_dir):
    return crawling.crawl_pages(corpus.fetch_log(spark, sf_dir))


def _fetched(spark, sf_dir):
    log = corpus.fetch_log(spark, sf_dir)
    return log.where(crawling.classify_fetch(F.col("http_status_code"), F.col("is_timeout")).isNull())


@query
def page_cache_upsert(spark, sf_dir):
    return crawling.upsert_page_cache(corpus.cached_copy(spark, sf_dir), _fetched(spark, sf_dir))


@query
def cached_pages_by_domain(spark, sf_dir):
    log = corpus.fetch_log(spark, sf_dir)
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    found = lifecycle.discover(urls, spark.createDataFrame([], schemas.CANDIDATES), earlier())
    return crawling.cached_pages(
        corpus.cached_copy(spark, sf_dir), crawling.crawl_pages(log), crawling.crawl_runs(log, now()), found
    )


@query
def domain_policy(spark, sf_dir):
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    found = lifecycle.discover(urls, spark.createDataFrame([], schemas.CANDIDATES), earlier())
    return crawling.domain_policy(found, crawling.crawl_runs(corpus.fetch_log(spark, sf_dir), now()))


@query
def claimed_by_policy(spark, sf_dir):
    """Candidates claimed while the domains with an open circuit are kept out."""
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    found = lifecycle.discover(urls, spark.createDataFrame([], schemas.CANDIDATES), earlier())
    policy = crawling.domain_policy(found, crawling.crawl_runs(corpus.fetch_log(spark, sf_dir), now()))
    return candidates.claim(found, now(), policy=policy).select("candidate_id", "canonical_domain", "state", "last_attempt_at", "claimed")


# --- candidate states ----------------------------------------------------------------------------------


def _states(spark, sf_dir):
    return candidates.states_from_trail(candidates.attempt_trail(corpus.outcome_log(spark, sf_dir)))


@query
def candidate_transitions(spark, sf_dir):
    return candidates.attempt_trail(corpus.outcome_log(spark, sf_dir))


@query
def candidate_states(spark, sf_dir):
    return _states(spark, sf_dir)


LATE_JANUARY = "2024-01-20 12:00:00"


@query
def claimable_candidates(spark, sf_dir):
    """Candidates claimed at a moment in January; two in five were already being crawled."""
    moment = F.lit(LATE_JANUARY).cast("timestamp")
    crawling_now = F.col("candidate_id") % 5 < 2
    rows = _states(spark, sf_dir).withColumn("state", F.when(crawling_now, "crawling").otherwise(F.col("state")))
    return candidates.claim(rows, moment).select("candidate_id", "state", "last_attempt_at", "claimed")


@query
def routed_outcomes(spark, sf_dir):
    """All candidates after one more crawl, whose outcome follows from their id."""
    rows = _states(spark, sf_dir)
    kind = F.floor(F.col("candidate_id") / 100) % 6
    outcome = (
        F.when(kind == 0, "success").when(kind == 1, "success").when(kind == 2, "blocked").when(kind == 3, "timeout")
        .when(kind == 4, "failed")
    )
    crawled = rows.where(kind < 5).select(
        "candidate_id", outcome.alias("status"),
        F.when(kind == 4, "no extractable pages").alias("reason"), (kind == 1).alias("storage_conflict"),
    )
    return candidates.route_outcomes(rows, crawled, now())


@query
def retry_due(spark, sf_dir):
    return candidates.due_retries(_states(spark, sf_dir), F.lit(LATE_JANUARY).cast("timestamp"), None)


@query
def retry_batch(spark, sf_dir):
    """The hundred longest due: the batch limit is the feature."""
    return lifecycle.sweep_retries(_states(spark, sf_dir), now(), V.RETRY_BATCH)


# --- verification --------------------------------------------------------------------------------------


@query
def verification_due(spark, sf_dir):
    contacts = corpus.contact_table(normalization.normalized_contacts(_observed(spark, sf_dir, "contact")))
    return verification.lease(contacts, now()).select(
        "contact_id", F.col("value").alias("email"), "verification_attempts", "next_verification_attempt_at"
    )


@query
def verification_batch(spark, sf_dir):
    """The fifty oldest due emails: the batch limit is the feature."""
    contacts = corpus.contact_table(normalization.normalized_contacts(_observed(spark, sf_dir, "contact")))
    return verification.lease(contacts, now(), limit=50).select("contact_id", F.col("value").alias("email"))


def _verified(spark, sf_dir):
    observed = corpus.normalized_contacts(spark, sf_dir)
    contacts = stage(corpus.contact_table(observed), "contact-table")
    done = verification.outcomes(
        verification.lease(contacts, now()), corpus.suppression_list(observed), corpus.mx_records(observed), now()
    )
    return observed, contacts, done


@query
def verification_outcome(spark, sf_dir):
    _, _, done = _verified(spark, sf_dir)
    return done.select(
        "contact_id", F.col("value").alias("email"), "outcome", "verification_status", "verification_provider",
        "verified_at", "verification_attempts", "last_verification_attempt_at", "next_verification_attempt_at",
        "verification_failure_reason",
    )


@query
def verification_summary(spark, sf_dir):
    return verification.summary(_verified(spark, sf_dir)[2])


@query
def contacts_after_verification(spark, sf_dir):
    _, contacts, done = _verified(spark, sf_dir)
    return verification.apply_outcomes(contacts, stage(done, "verified")).select(
        "contact_id", "business_id", "type", "value", "verification_status", "verification_attempts"
    )


# --- export --------------------------------------------------------------------------------------------


def _export_inputs(spark, sf_dir):
    found = lifecycle.extract(corpus.signal_pages(spark, sf_dir))
    observed = stage(normalization.normalized_contacts(found.observations), "contacts")
    contacts = stage(corpus.contact_table(observed), "contact-table")
    platforms = detection.platform_by_domain(found.domains, found.evidence)
    fields = normalization.business_columns(found.observations)
    businesses = platforms.join(fields.select("canonical_domain", "state"), "canonical_domain", "left").select(
        stable_id(F.col("canonical_domain")).alias("business_id"), "platform", "state",
        F.lit(None).cast("string").alias("category"),
    )
    return observed, contacts, businesses


@query
def eligible_contacts(spark, sf_dir):
    """Verified emails of the businesses of one state on one platform."""
    _, contacts, businesses = _export_inputs(spark, sf_dir)
    return exporting.eligible_contacts(contacts, businesses, platform="shopify", state="VK", limit=None)


@query
def export_stamped(spark, sf_dir):
    """The usual export batch, suppression after its limit, and the contacts it stamps."""
    observed, contacts, businesses = _export_inputs(spark, sf_dir)
    eligible = exporting.eligible_contacts(contacts, businesses, limit=V.EXPORT_LIMIT)
    rows = stage(exporting.exportable(eligible, corpus.suppression_list(observed)), "export")
    return exporting.stamp_exported(contacts, rows, now()).select("contact_id", "type", "value", "last_exported_at")


# --- browsing ------------------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """Businesses, contacts and socials as stored after one ingest."""
    records = _records(spark, sf_dir)
    resolved = stage(_resolution(spark, sf_dir, records), "resolution")
    businesses = merging.merge_businesses(corpus.known_businesses(spark, sf_dir), records.headers, resolved, now())
    contacts = corpus.contact_table(records.contacts)
    socials = merging.social_rows(records.socials, now())
    return stage(businesses, "businesses"), stage(contacts, "contact-table"), stage(socials, "socials")


@query
def business_listing(spark, sf_dir):
    return browsing.business_listing(*_stored(spark, sf_dir))


@query
def business_overview(spark, sf_dir):
    return browsing.business_overview(*_stored(spark, sf_dir))


@query
def filtered_overview(spark, sf_dir):
    """Businesses in the list search: text, kind of contact, duplicates excluded."""
    overview = browsing.business_overview(*_stored(spark, sf_dir))
    return browsing.filter_overview(overview, search="EXAMPLE.com", contact_status="verified", exclude_duplicates=True)


@query
def platform_overview(spark, sf_dir):
    """Businesses on one platform, duplicates excluded."""
    return browsing.filter_overview(browsing.business_overview(*_stored(spark, sf_dir)), platform="wordpress", exclude_duplicates=True)


@query
def paged_list(spark, sf_dir):
    """First page of fifty, with the total: the page size is the feature."""
    return browsing.overview_page(*_stored(spark, sf_dir)).select(
        "business_id", "canonical_domain", "name", "platform", "total"
    )


def _lines_of(store: Store, name: str, key: str | None, owner: str | None, *columns: str) -> DataFrame:
    """Rows of a stored table as ``(name, id, owner, detail)``."""
    number = lambda c: F.col(c).cast("long") if c else F.lit(None).cast("long")
    detail = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return store.read(name).select(F.lit(name).alias("name"), number(key).alias("id"), number(owner).alias("owner"), detail.alias("detail"))


@query
def published_tables(spark, sf_dir):
    """Whole rows of the stored tables after the corpus was ingested twice and every sixth business deleted."""
    tune(spark)
    store = Store(spark, run_folder(spark, "tables"), buckets=8)
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    lifecycle.discover_into(store, urls, earlier())
    for _ in range(2):
        lifecycle.ingest_into(store, corpus.signal_pages(spark, sf_dir), now(), skip_unchanged=False)
    gone = corpus.page_domains(spark, sf_dir).where("record_order % 6 = 0").select(stable_id(F.col("canonical_domain")).alias("business_id"))
    store.delete_businesses(gone)
    parts = [
        _lines_of(store, "businesses", "business_id", "duplicate_of_id", "canonical_domain", "name", "city", "platform", "platform_confidence", "merge_status", "updated_at"),
        _lines_of(store, "candidates", "candidate_id", "business_id", "canonical_domain", "state", "attempts"),
        _lines_of(store, "contacts", "contact_id", "business_id", "type", "value", "source_url", "extraction_confidence"),
        _lines_of(store, "social_profiles", "social_id", "business_id", "platform", "url", "source_url"),
        _lines_of(store, "evidence", None, "business_id", "field_name", "field_value", "source_url", "extraction_method", "confidence"),
        _lines_of(store, "validated", None, "target_business_id", "canonical_domain", "is_valid", "action"),
        _lines_of(store, "page_cache", None, None, "url", "content_hash", "status_code"),
        _lines_of(store, "contact_values", None, "business_id", "value"),
    ]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


@query
def resolved_in_two_ingests(spark, sf_dir):
    """Businesses after the odd pages and then the even ones were ingested: shared contacts are found by value."""
    tune(spark)
    store = Store(spark, run_folder(spark, "tables"), buckets=8)
    for half in (1, 0):
        pages = corpus.signal_pages(spark, sf_dir).where(F.col("page_seq") % 2 == half)
        lifecycle.ingest_into(store, pages, now())
    return store.read("businesses").select("business_id", "canonical_domain", "merge_status", "duplicate_of_id")


@query
def reread_pages(spark, sf_dir):
    """Pages that a second ingest parses when every fifth page has changed: those, and homepages."""
    nothing = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    tables, _ = lifecycle.ingest(corpus.signal_pages(spark, sf_dir), nothing, earlier())
    edited = F.when(F.col("page_seq") % 5 == 0, F.concat("raw_html", F.lit("<!-- edited -->"))).otherwise(F.col("raw_html"))
    pages = corpus.signal_pages(spark, sf_dir).withColumn("raw_html", edited)
    # Both in buckets by URL, as a crawler lands them, so that no page text moves to meet the cache.
    run = uuid.uuid4().hex
    buckets = spark.sparkContext.defaultParallelism
    landed = files.save_bucketed(pages, f"pages_{run}", run_folder(spark, "landed-pages"), "url", buckets)
    cache = files.save_bucketed(tables["page_cache"], f"cache_{run}", run_folder(spark, "landed-cache"), "url", buckets)
    return lifecycle.pages_to_read(landed, cache).select("page_seq", "url")


@query
def export_file(spark, sf_dir):
    """All eligible contacts without suppressed ones, as read from the file they are exported to."""
    observed, contacts, businesses = _export_inputs(spark, sf_dir)
    folder = run_folder(spark, "exports")
    path, _ = lifecycle.export(contacts, businesses, corpus.suppression_list(observed), now(), folder, "leads")
    return spark.read.schema("business_id long, contact_id long, email string, verification_status string").option(
        "header", True).csv(path).select("contact_id", "email")


@query
def export_lines(spark, sf_dir):
    """The contacts of shops on one platform, as read from the JSON lines they are exported to."""
    observed, contacts, businesses = _export_inputs(spark, sf_dir)
    folder = run_folder(spark, "exports")
    path, _ = lifecycle.export(
        contacts, businesses, corpus.suppression_list(observed), now(), folder, "leads", fmt="json", platform="shopify")
    return spark.read.schema("business_id long, contact_id long, email string, verification_status string").json(path)


@query
def crawl_pages_by_day(spark, sf_dir):
    """The crawl page log appended by day, and what each day's folder holds."""
    path = run_folder(spark, "crawl-pages")
    files.append_log(crawling.crawl_pages(corpus.fetch_log(spark, sf_dir)), path, "fetched_at")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query
def dashboard(spark, sf_dir):
    return browsing.dashboard(browsing.business_overview(*_stored(spark, sf_dir)))


@query
def platform_facets(spark, sf_dir):
    evidence = detection.platform_evidence(corpus.signal_pages(spark, sf_dir))
    return browsing.platform_facets(detection.platform_by_domain(corpus.page_domains(spark, sf_dir), evidence))


@query
def known_domains(spark, sf_dir):
    submitted = corpus.raw_pages(spark, sf_dir).select(U.canonical_domain(F.col("url")).alias("canonical_domain"))
    return browsing.known_domains(submitted, corpus.known_businesses(spark, sf_dir))


@query
def batch_status(spark, sf_dir):
    """Status of the batch of all page domains, of which the stored half has a result."""
    batch = corpus.page_domains(spark, sf_dir).select(stable_id(F.col("canonical_domain")).alias("candidate_id"))
    results = corpus.known_businesses(spark, sf_dir).select(
        F.col("business_id").alias("candidate_id"), F.when(F.col("name").isNotNull(), "success").otherwise("retry").alias("result")
    )
    return browsing.batch_status(batch, results)


@query
def batch_results(spark, sf_dir):
    """The businesses that the pages' candidates led to, for those submitted over https."""
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    found = lifecycle.discover(urls, spark.createDataFrame([], schemas.CANDIDATES), earlier())
    businesses = corpus.known_businesses(spark, sf_dir)
    linked = found.drop("business_id").join(businesses.select("canonical_domain", "business_id"), "canonical_domain", "left")
    batch = found.where(F.col("discovery_metadata")["scheme"] == "https").select("candidate_id")
    return browsing.batch_businesses(batch, linked, businesses).select("business_id", "canonical_domain", "name", "platform")


# --- quality -------------------------------------------------------------------------------------------


@query
def quality_report(spark, sf_dir):
    """Rules over tables made from the pages, with faults that some pages bring in."""
    log = corpus.fetch_log(spark, sf_dir)
    found = _observed(spark, sf_dir, "contact", "social")
    contacts = corpus.contact_table(normalization.normalized_contacts(found.where("section = 'contact'")))
    urls = corpus.raw_pages(spark, sf_dir).select(F.col("page_seq").alias("pos"), "url")
    listed = lifecycle.discover(urls, spark.createDataFrame([], schemas.CANDIDATES), earlier())
    faulty = F.length("canonical_domain") % 3 == 0
    evidence = merging.evidence_rows(found.where("section = 'social'"), found.limit(0), found.limit(0), now())
    tables = {
        "businesses": corpus.known_businesses(spark, sf_dir),
        "candidates": stage(listed.withColumns({
            "state": F.when(faulty, "lost").otherwise(F.col("state")),
            "business_id": F.col("candidate_id"),
        }), "candidates"),
        "contacts": stage(contacts, "contact-table"),
        "social_profiles": stage(merging.social_rows(found.where("section = 'social'"), now()).withColumn(
            "platform", F.when(F.col("platform") == "youtube", "tube").otherwise(F.col("platform"))), "socials"),
        "evidence": stage(evidence.withColumn("confidence", F.when(
            F.col("field_name") == "x", F.lit(1.5)).otherwise(F.col("confidence")).cast(schemas.UNIT)), "evidence"),
        "crawl_runs": stage(crawling.crawl_runs(log, now()), "runs"),
        "crawl_pages": stage(crawling.crawl_pages(log), "crawl-pages"),
        "page_cache": corpus.cached_copy(spark, sf_dir),
    }
    return quality.quality_report(tables)


@query
def surviving_contacts(spark, sf_dir):
    """Contacts whose business is still stored."""
    contacts = corpus.contact_table(corpus.normalized_contacts(spark, sf_dir))
    kept = merging.drop_orphans(stage(contacts, "contact-table"), corpus.known_businesses(spark, sf_dir))
    return kept.select("contact_id", "business_id", "type", "value")


# --- streaming -----------------------------------------------------------------------------------------


def _in_files(df: DataFrame, folder: str, parts: int, key: str) -> None:
    """Write ``df`` as a file for each of ``parts`` shares by ``key``, of which a stream takes one at a time."""
    df.repartition(parts, key).write.mode("append").parquet(folder)


@query
def stream_discover(spark, sf_dir):
    """Domains that a stream over several files of pages finds, each once."""
    tune(spark)
    work = run_folder(spark, "stream")
    _in_files(corpus.table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{work}/pages", 3, "page_id")
    for _ in range(2):
        pages = ingest.page_stream(spark, f"{work}/pages", files_per_batch=1)
        ingest.start_discovery(pages, f"{work}/domains", f"{work}/checkpoint").awaitTermination()
        ingest.compact_domains(spark, f"{work}/domains")
    return ingest.read_domains(spark, f"{work}/domains")


@query
def stream_pages(spark, sf_dir):
    """Observations of the stored pages as a stream writes them."""
    tune(spark)
    work = run_folder(spark, "stream")
    pages = ingest.page_stream(spark, sf_dir, glob="pages.parquet")
    ingest.start_ingest(pages, f"{work}/observations", f"{work}/cache", f"{work}/checkpoint", earlier).awaitTermination()
    return ingest.read_observations(spark, f"{work}/observations")


@query
def stream_page_cache(spark, sf_dir):
    """The page cache that a stream over two halves of the pages leaves, compacted after the first."""
    tune(spark)
    work = run_folder(spark, "stream")
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    middle = pages.agg(F.max("page_id")).first()[0] // 2
    for first, half in ((True, F.col("page_id") <= middle), (False, F.col("page_id") > middle)):
        _in_files(pages.where(half), f"{work}/pages", 2, "page_id")
        stream = ingest.page_stream(spark, f"{work}/pages")
        ingest.start_ingest(stream, f"{work}/observations", f"{work}/cache", f"{work}/checkpoint", earlier).awaitTermination()
        if first:
            ingest.compact_page_cache(spark, f"{work}/cache")
    return ingest.read_page_cache(spark, f"{work}/cache").select("url", "content_hash", "status_code", "fetched_at")


def _outcome_stream(spark, sf_dir) -> str:
    """Fold the outcomes, in several files and not in order, into states; where these are."""
    tune(spark)
    work = run_folder(spark, "stream")
    _in_files(corpus.outcome_log(spark, sf_dir), f"{work}/log", 3, "event_id")
    stream = spark.readStream.schema(ingest.OUTCOMES).option("maxFilesPerTrigger", 1).parquet(f"{work}/log")
    ingest.start_outcomes(stream, f"{work}/states", f"{work}/checkpoint", buckets=8).awaitTermination()
    return f"{work}/states"


@query
def stream_states(spark, sf_dir):
    """Candidate states that a stream over several files of outcomes ends in."""
    return ingest.read_states(spark, _outcome_stream(spark, sf_dir))


@query
def stream_due(spark, sf_dir):
    """Candidates whose retry is due by a moment in January, by the states of the stream."""
    return ingest.due_now(spark, _outcome_stream(spark, sf_dir), F.lit(LATE_JANUARY).cast("timestamp"))
