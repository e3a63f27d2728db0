"""Read views of the stored tables: listings, batch results, tiles and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions.urls import safe_link
from leadloom.operators.skew import skew_join


def _or(column: str, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(fallback))


def business_listing(businesses: DataFrame, contacts: DataFrame, socials: DataFrame) -> DataFrame:
    """Businesses with their contacts and socials, one line per item.

    Sort by ``(business_id, part, item_id)`` to read it: a business line, then its contacts, then its
    socials. Lines instead of nested lists keep a business with very many contacts in ordinary rows.
    """
    ids = businesses.select("business_id")
    heads = businesses.select(
        "business_id",
        F.lit(0).alias("part"),
        F.lit(0).cast("long").alias("item_id"),
        F.lit("business").alias("kind"),
        _or("name", "(no name)").alias("label"),
        _or("platform", "unknown platform").alias("detail"),
        F.col("canonical_domain").alias("link"),
    )
    contact_lines = skew_join(contacts, ids, "business_id", "left_semi").select(
        "business_id",
        F.lit(1).alias("part"),
        F.col("contact_id").alias("item_id"),
        F.col("type").alias("kind"),
        F.col("value").alias("label"),
        _or("verification_status", "unverified").alias("detail"),
        F.lit(None).cast("string").alias("link"),
    )
    social_lines = skew_join(socials, ids, "business_id", "left_semi").select(
        "business_id",
        F.lit(2).alias("part"),
        F.col("social_id").alias("item_id"),
        F.col("platform").alias("kind"),
        F.col("url").alias("label"),
        F.lit("").alias("detail"),
        safe_link(F.col("url")).alias("link"),
    )
    return heads.unionByName(contact_lines).unionByName(social_lines)


def contact_status_counts(contacts: DataFrame, socials: DataFrame) -> DataFrame:
    """Per business: numbers of emails by status, phones, and the social platforms it is on."""
    status = F.coalesce("verification_status", F.lit("unverified"))
    is_email = F.col("type") == "email"
    by_contact = contacts.groupBy("business_id").agg(
        *[
            F.count_if(is_email & (status == name)).alias(f"emails_{name}")
            for name in ("verified", "invalid", "unknown", "pending", "risky", "unverified")
        ],
        F.count_if(F.col("type") == "phone").alias("phones"),
    )
    on = socials.groupBy("business_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("platform"))).alias("social_platforms")
    )
    both = by_contact.join(on, "business_id", "full_outer")
    numbers = [c for c in by_contact.columns if c != "business_id"]
    return both.select(
        "business_id",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers],
        F.coalesce("social_platforms", F.lit("")).alias("social_platforms"),
    )


def business_overview(businesses: DataFrame, contacts: DataFrame, socials: DataFrame) -> DataFrame:
    """Every business with its contact counts and social platforms."""
    counts = contact_status_counts(contacts, socials)
    numbers = [c for c in counts.columns if c not in ("business_id", "social_platforms")]
    joined = businesses.select("business_id", "canonical_domain", "name", "platform", "merge_status").join(
        counts, "business_id", "left"
    )
    return joined.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in numbers},
        "social_platforms": F.coalesce("social_platforms", F.lit("")),
    })


def filter_overview(
    overview: DataFrame,
    search: str | None = None,
    platform: str | None = None,
    contact_status: str | None = None,
    exclude_duplicates: bool = False,
) -> DataFrame:
    """Overview rows by name or domain text, platform, kind of contact, and duplicate flag."""
    rows = overview
    if search:
        needle = search.lower()
        rows = rows.where(
            F.lower("canonical_domain").contains(needle) | F.coalesce(F.lower("name").contains(needle), F.lit(False))
        )
    if platform is not None:
        rows = rows.where(F.col("platform") == platform)
    if contact_status is not None:
        rows = rows.where(F.col(f"emails_{contact_status}") > 0)
    if exclude_duplicates:
        rows = rows.where(F.col("merge_status") != "possible_duplicate")
    return rows


def page_of(rows: DataFrame, page: int, per_page: int = 50, order: str = "business_id") -> DataFrame:
    """One page of a list, numbered from 1, for lists of few pages: all pages before it are sorted too."""
    return rows.orderBy(order).offset((page - 1) * per_page).limit(per_page)


def overview_page(
    businesses: DataFrame, contacts: DataFrame, socials: DataFrame, after: int | None = None, per_page: int = 50
) -> DataFrame:
    """The ``per_page`` businesses after id ``after`` with their counts, and the ``total`` of all businesses.

    The page is cut first, so only its own contacts and socials are counted, and a late page costs what the
    first one does.
    """
    chosen = businesses if after is None else businesses.where(F.col("business_id") > after)
    page = chosen.orderBy("business_id").limit(per_page)
    ids = F.broadcast(page.select("business_id"))  # a page of ids
    own = business_overview(page, contacts.join(ids, "business_id", "left_semi"), socials.join(ids, "business_id", "left_semi"))
    total = businesses.agg(F.count(F.lit(1)).alias("total"))
    return own.withColumn("total", total.scalar())


def dashboard(overview: DataFrame) -> DataFrame:
    """One row of tiles over the business overview."""
    waiting = F.col("emails_unverified") + F.col("emails_pending")
    emails = waiting + F.col("emails_verified") + F.col("emails_invalid") + F.col("emails_unknown") + F.col("emails_risky")
    return overview.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("emails_verified") > 0).alias("with_verified_email"),
        F.count_if(waiting > 0).alias("awaiting_verification"),
        F.count_if(emails + F.col("phones") == 0).alias("no_contacts"),
    )


def platform_facets(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("platform").agg(F.count(F.lit(1)).alias("businesses"))


def known_domains(submitted: DataFrame, businesses: DataFrame) -> DataFrame:
    """Submitted domains that already are businesses."""
    return submitted.select("canonical_domain").distinct().join(
        businesses.select("canonical_domain"), "canonical_domain", "left_semi"
    )


def batch_businesses(candidate_ids: DataFrame, candidates: DataFrame, businesses: DataFrame) -> DataFrame:
    """The businesses that a batch of candidates led to."""
    batch = candidates.join(candidate_ids.select("candidate_id"), "candidate_id", "left_semi")
    ids = batch.where(F.col("business_id").isNotNull()).select("business_id").distinct()
    return businesses.join(ids, "business_id", "left_semi")


def batch_status(candidate_ids: DataFrame, results: DataFrame) -> DataFrame:
    """Counts over a batch: candidates without a result yet are pending, all but success failed."""
    joined = candidate_ids.select("candidate_id").distinct().join(
        results.select("candidate_id", "result"), "candidate_id", "left"
    )
    result = F.coalesce("result", F.lit("pending"))
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(result == "success").alias("success"),
        F.count_if(~result.isin("success", "pending")).alias("failed"),
        F.count_if(result == "pending").alias("pending"),
    )
