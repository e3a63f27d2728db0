"""URL expressions: domains, paths, page types, link resolution, social platforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leadloom import fixed_values as V
from leadloom.functions.binding import let

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BLANKS = " \t\n\r\f\u000b"


def _with_authority(raw_url: Column) -> Column:
    return F.when(raw_url.contains("://"), raw_url).otherwise(F.concat(F.lit("//"), raw_url))


def netloc(url: Column) -> Column:
    """Authority part of a URL, ports and user info included; '' when there is none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    """Path of a URL without query, fragment and the parameters of its last segment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    tail = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?", "")
    return F.regexp_replace(tail, r";[^/]*$", "")


def canonical_domain(raw_url: Column) -> Column:
    """Lowercased authority without one leading ``www.``; the scheme is optional in the input."""
    return F.regexp_replace(F.lower(netloc(_with_authority(raw_url))), r"^www\.", "")


def scheme(raw_url: Column) -> Column:
    """Lowercased scheme, ``https`` when the input has none."""
    found = F.lower(F.regexp_extract(_with_authority(raw_url), _SCHEME, 1))
    return F.when(found == "", "https").otherwise(found)


def seed_url(scheme_col: Column, domain: Column) -> Column:
    return F.concat(F.coalesce(scheme_col, F.lit("https")), F.lit("://"), domain, F.lit("/"))


def discovery_metadata(given: Column, name_hint: Column, raw_url: Column) -> Column:
    """``given`` plus ``name_hint`` and ``scheme`` where it has no such keys."""
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    defaults = F.map_filter(
        F.create_map(F.lit("name_hint"), name_hint, F.lit("scheme"), scheme(raw_url)),
        lambda k, v: v.isNotNull() & ~F.map_contains_key(given, k),
    )
    return F.map_concat(given, defaults)


def _fold_dots(p: Column) -> Column:
    """Collapse ``.`` and ``..`` segments of an absolute path."""
    kept = F.aggregate(
        F.split(F.substring(p, 2, 1 << 30), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(p.rlike(r"/\.{1,2}$"), F.regexp_replace(joined, "([^/])$", "$1/")).otherwise(joined)


def resolve_link(seed_scheme: Column, seed_domain: Column, href: Column) -> Column:
    """Absolute in-site URL for ``href`` found on a page of ``seed_domain``.

    Query, fragment and parameters are dropped and the seed's scheme and domain are used. NULL for
    links to another host, to the homepage, and for schemes other than http and https.
    """
    def folded(rooted):
        return F.when(rooted.rlike(r"/\.{1,2}(/|$)"), _fold_dots(rooted)).otherwise(rooted)

    def target(bare):
        absolute = bare.rlike(r"(?i)^https?://") | bare.startswith("//")
        relative = F.concat(F.lit("/"), F.regexp_replace(bare, r"/{2,}", "/"))
        rooted = F.when(bare.startswith("/"), bare).otherwise(relative)
        return (
            F.when(absolute, F.when(netloc(bare) == seed_domain, path(bare)))
            .when(bare.rlike(_SCHEME) | (bare == ""), F.lit(None).cast("string"))
            .otherwise(F.regexp_replace(let(rooted, folded), r";[^/]*$", ""))
        )

    def in_site(p):
        return F.when(~p.isin("", "/"), F.concat(seed_scheme, F.lit("://"), seed_domain, p))

    bare_link = F.regexp_replace(F.trim(href, F.lit(_BLANKS)), r"[?#].*$", "")
    return let(let(bare_link, target), in_site)


def _first_match(rules, otherwise):
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), otherwise)


def page_type(url_path: Column) -> Column:
    """First page type whose pattern is found in the path, else ``other``."""
    rules = [(url_path.rlike("(?i)" + pattern), F.lit(kind)) for kind, _, pattern in V.PAGE_TYPES]
    return _first_match(rules, F.lit("other"))


def page_priority(url_path: Column) -> Column:
    rules = [(url_path.isin("", "/"), F.lit(V.HOMEPAGE_PRIORITY))]
    rules += [(url_path.rlike("(?i)" + pattern), F.lit(rank)) for _, rank, pattern in V.PAGE_TYPES]
    return _first_match(rules, F.lit(V.DEFAULT_PAGE_PRIORITY))


def social_platform(url: Column, strict: bool = False) -> Column:
    """Social platform of a link, NULL for other links.

    By default a domain counts wherever it occurs in the URL, so ``netflix.com`` counts as ``x``;
    ``strict`` compares the host and its subdomains instead.
    """
    lowered = F.lower(url)
    host = netloc(lowered)

    def hit(domain):
        if strict:
            return (host == domain) | host.endswith("." + domain)
        return lowered.contains(domain)

    rules = [(hit(domain), F.lit(platform)) for domain, platform in V.SOCIAL_DOMAINS]
    return _first_match(rules, F.lit(None).cast("string"))


def safe_link(url: Column) -> Column:
    """The URL when it is an http or https link, else NULL."""
    return F.when(url.rlike(r"(?i)^https?://"), url)
