"""The whole-table jobs: from pages to the next state of every stored table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V, schemas
from leadloom.operators import (
    candidates as C, crawling, detection, discovery, exporting, extraction, merging, normalization, resolution,
    validation, verification,
)
from leadloom.functions.ids import stable_id
from leadloom.functions.urls import canonical_domain
from leadloom.operators.skew import skew_join
from leadloom.session import stage
from leadloom.sources import files
from leadloom.sources.tables import Store


@dataclass
class Extracted:
    """What the pages say: observations, platform signals, and the domains that were read."""

    observations: DataFrame
    evidence: DataFrame
    domains: DataFrame

    def section(self, name: str) -> DataFrame:
        return self.observations.where(F.col("section") == name)


def discover(urls: DataFrame, candidates: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """New candidates from a ``(pos, url)`` list."""
    return discovery.new_candidates(discovery.import_urls(urls, limit), candidates, now)


def extract(pages: DataFrame) -> Extracted:
    """Read the corpus once and keep what it says as a written table.

    Page text is by far the largest input, so nothing downstream goes back to it.
    """
    observed = stage(extraction.observations(pages, (*extraction.ALL_SECTIONS, "hash")), "observations")
    read = observed.where(F.col("section") == "page")
    return Extracted(
        observed,
        observed.where(F.col("section") == "platform"),
        read.groupBy("canonical_domain").agg(F.min("page_seq").alias("record_order")),
    )


@dataclass
class Records:
    """Normalized records in long form: a header per domain and its contacts, socials and evidence."""

    headers: DataFrame
    contacts: DataFrame
    socials: DataFrame
    evidence: DataFrame


def normalize(found: Extracted, use_generator_hint: bool = False) -> Records:
    """Records of every domain that was read.

    The generator tag decides the platform only when asked for; by default it is left to the page
    signals.
    """
    contacts = stage(normalization.normalized_contacts(found.observations), "contacts")
    socials = found.section("social")
    hints = detection.generator_hints(found.observations) if use_generator_hint else None
    platforms = detection.platform_by_domain(found.domains, found.evidence, hints)
    headers = normalization.record_headers(
        found.domains, found.observations, platforms, normalization.contact_tallies(contacts, socials)
    )
    evidence = detection.winning_evidence(found.evidence, platforms, hints)
    return Records(headers, contacts, socials, evidence)


def contact_values(contacts: DataFrame) -> DataFrame:
    """Distinct contact values per domain."""
    return contacts.select("canonical_domain", F.col("field_value").alias("value")).distinct()


def resolve(records: Records, businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Resolution of all records against the stored tables."""
    stored = resolution.stored_contact_values(businesses, contacts)
    return resolution.resolve(records.headers, contact_values(records.contacts), businesses, stored)


def apply_records(
    tables: Mapping[str, DataFrame], records: Records, resolved: DataFrame, now: Column
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Next state of businesses, contacts, socials and candidates, and the evidence to append."""
    owned_by = merging.owners(resolved)
    changed = {
        "businesses": merging.merge_businesses(tables["businesses"], records.headers, resolved, now),
        "contacts": merging.insert_absent(
            tables["contacts"], merging.contact_rows(records.contacts, now, owned_by), ["business_id", "type", "value"]
        ),
        "social_profiles": merging.insert_absent(
            tables["social_profiles"], merging.social_rows(records.socials, now, owned_by), ["business_id", "platform", "url"]
        ),
        "candidates": merging.finish_candidates(tables["candidates"], resolved, now),
    }
    evidence = merging.evidence_rows(records.contacts, records.socials, records.evidence, now, owned_by)
    return {**tables, **changed}, {"evidence": evidence}


def pages_to_read(pages: DataFrame, page_cache: DataFrame) -> DataFrame:
    """Pages that are new or changed since they were cached, and homepages, which are always read.

    Each row is decided by itself against the cached row of its URL. Where both sides are bucketed by URL (see
    ``files.save_bucketed``) page text does not move: a bucket of the cache is hashed in memory and its pages stream
    by. Otherwise the join moves the text once, unless the cache is small enough to be sent to all tasks.
    """
    cached = page_cache.select("url", F.col("content_hash").alias("cached_hash"))
    known = skew_join(pages, cached.hint("shuffle_hash"), "url", "left")
    return known.where(~crawling.is_unchanged(F.col("cached_hash"))).select(*pages.columns)


def ingest(
    pages: DataFrame, tables: Mapping[str, DataFrame], now: Column, skip_unchanged: bool = True
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Pages to the next tables and the log rows to append.

    Pages that the page cache knows unchanged are not parsed again unless ``skip_unchanged`` is off, and what
    was read goes to the cache. The ``validated`` log says of each record whether it is valid, and why not.
    """
    chosen = pages_to_read(pages, tables["page_cache"]) if skip_unchanged else pages
    found = extract(chosen)
    records = normalize(found)
    resolved = stage(resolve(records, tables["businesses"], tables["contacts"]), "resolution")
    changed, logs = apply_records(tables, records, resolved, now)
    changed["page_cache"] = crawling.upsert_page_cache(tables["page_cache"], fetched_pages(found, now))
    checked = validated_records(records, resolved).withColumn("validated_at", now)
    logs["validated"] = schemas.conform(checked, schemas.VALIDATED)
    return changed, logs


def fetched_pages(found: Extracted, now: Column) -> DataFrame:
    """What the page cache is to know of the pages that were read."""
    return found.section("hash").select(
        "page_seq", F.col("source_url").alias("url"), F.col("field_value").alias("content_hash"),
        F.lit(200).alias("http_status_code"), now.alias("fetched_at"),
    )


def ingest_into(store: Store, pages: DataFrame, now: Column, skip_unchanged: bool = True) -> None:
    """``ingest`` into stored tables, of which only the buckets that the pages concern are read and written.

    A page's URL says which bucket of the cache and, by its domain, which business, contacts and candidate it may
    concern. Shared contacts are looked up by value in the index of contact values, whose buckets the new values name.
    """
    cache_buckets = store.of(pages.select("url"))
    cache = store.read("page_cache", cache_buckets)
    found = extract(pages_to_read(pages, cache) if skip_unchanged else pages)
    records = normalize(found)
    values = stage(contact_values(records.contacts), "values")
    own = store.of(found.domains.select(stable_id(F.col("canonical_domain"))))
    value_buckets = store.of(values.select("value"))
    stored = store.read("contact_values", value_buckets)
    resolved = stage(resolution.resolve(records.headers, values, store.read("businesses", own), stored), "resolution")
    touched = sorted({*own, *store.of(merging.owners(resolved).select("owner_id"))})
    names = ("businesses", "contacts", "social_profiles", "candidates")
    changed, logs = apply_records({name: store.read(name, touched) for name in names}, records, resolved, now)
    held = skew_join(values, merging.owners(resolved), "canonical_domain").select(
        "value", F.col("owner_id").alias("business_id"))
    checked = validated_records(records, resolved).withColumn("validated_at", now)
    store.merge(
        {
            **{name: (changed[name], touched) for name in names},
            "contact_values": (stored.unionByName(held).distinct(), value_buckets),
            "page_cache": (crawling.upsert_page_cache(cache, fetched_pages(found, now)), cache_buckets),
        },
        {**logs, "validated": checked},
    )


def discover_into(store: Store, urls: DataFrame, now: Column, limit: int | None = None) -> None:
    """``discover`` into the stored candidates: the buckets of the list's domains are read and written."""
    touched = store.of(urls.select(stable_id(canonical_domain(F.col("url")))))
    known = store.read("candidates", touched)
    store.merge({"candidates": (known.unionByName(schemas.conform(discover(urls, known, now, limit), schemas.CANDIDATES)), touched)})


def record_crawls_into(store: Store, fetch_log: DataFrame, now: Column) -> None:
    """``record_crawls`` into the stored page cache and crawl logs."""
    touched = store.of(fetch_log.select("url"))
    changed, logs = record_crawls({"page_cache": store.read("page_cache", touched)}, fetch_log, now)
    store.merge({"page_cache": (changed["page_cache"], touched)}, logs)


def validated_records(records: Records, resolved: DataFrame) -> DataFrame:
    return validation.validate(records.headers, resolved)


def record_crawls(
    tables: Mapping[str, DataFrame], fetch_log: DataFrame, now: Column
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Next page cache, and the crawl log rows to append."""
    ok = crawling.classify_fetch(F.col("http_status_code"), F.col("is_timeout")).isNull()
    cache = crawling.upsert_page_cache(tables["page_cache"], fetch_log.where(ok))
    logs = {"crawl_runs": crawling.crawl_runs(fetch_log, now), "crawl_pages": crawling.crawl_pages(fetch_log)}
    return {**tables, "page_cache": cache}, logs


def verify(
    contacts: DataFrame,
    suppression: DataFrame | None,
    mx_records: DataFrame,
    now: Column,
    limit: int | None = None,
    lease_minutes: int = V.VERIFICATION_LEASE_MINUTES,
) -> tuple[DataFrame, DataFrame]:
    """Next state of ``contacts`` and the one-row summary of a verification run."""
    leased = verification.lease(contacts, now, limit, lease_minutes)
    done = stage(verification.outcomes(leased, suppression, mx_records, now), "verified")
    return verification.apply_outcomes(contacts, done), verification.summary(done)


def export(
    contacts: DataFrame,
    businesses: DataFrame,
    suppression: DataFrame | None,
    now: Column,
    folder: str,
    name: str,
    fmt: str = "csv",
    platform: str | None = None,
    state: str | None = None,
    category: str | None = None,
    limit: int | None = None,
) -> tuple[str, DataFrame]:
    """Write the export file, then return its path and the stamped contacts.

    A failed write raises before anything is stamped.
    """
    eligible = exporting.eligible_contacts(contacts, businesses, platform, state, category, limit)
    rows = stage(exporting.exportable(eligible, suppression), "export")
    path = files.write_export(rows, folder, name, fmt)
    return path, exporting.stamp_exported(contacts, rows, now)


def sweep_retries(candidates: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    return C.due_retries(candidates, now, limit)
