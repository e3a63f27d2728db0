"""Pages to observations: every field found on a page, with provenance and confidence.

One narrow pass over the corpus. A page is cleaned and parsed once into arrays, each section's
fields are put in order inside the row, and a single generator emits them, so nothing shuffles and a
hot domain is just more rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import fixed_values as V
from leadloom.functions import html as H, json_ld
from leadloom.functions.urls import canonical_domain, social_platform
from leadloom.operators.detection import platform_signals
from leadloom.operators.pages import fresh_pages
from leadloom.session import spread_small

SECTIONS = ("business", "product", "contact", "social", "generator")
# "platform" adds the platform signals, "page" one row per page that was read, so that everything
# later jobs need comes from one pass over the page texts. "hash" adds the content hash of each page.
ALL_SECTIONS = SECTIONS + ("platform", "page")


def _fields(values: Column, name: Column | str, method: str, confidence: float) -> Column:
    def one(value):
        field_name = F.lit(name) if isinstance(name, str) else name
        return F.struct(
            field_name.alias("field_name"),
            value.alias("field_value"),
            F.lit(method).alias("extraction_method"),
            F.lit(confidence).alias("confidence"),
        )

    return F.transform(values, one)


def _one(value: Column, name: str, method: str, confidence: float) -> Column:
    return _fields(F.filter(F.array(value), lambda v: v != ""), name, method, confidence)


def _metas(parsed: Column) -> Column:
    """Meta tags in document order as ``(name, property, content)``, content stripped."""
    return F.transform(
        F.filter(parsed, lambda tag: tag["name"] == "meta"),
        lambda tag: F.struct(
            H.attribute(tag, "name").alias("name"),
            H.attribute(tag, "property").alias("property"),
            H.strip(H.attribute(tag, "content")).alias("content"),
        ),
    )


def _open_graph() -> Column:
    """OpenGraph fields in document order; several properties may feed one field."""
    names = F.create_map(*[F.lit(x) for pair in V.OPEN_GRAPH for x in pair])
    known = F.filter(
        F.col("metas"), lambda m: m["property"].isin(*dict(V.OPEN_GRAPH)) & (m["content"] != "")
    )
    return F.transform(
        known,
        lambda m: F.struct(
            names[m["property"]].alias("field_name"),
            m["content"].alias("field_value"),
            F.lit("og-tag").alias("extraction_method"),
            F.lit(V.OPEN_GRAPH_CONFIDENCE).alias("confidence"),
        ),
    )


def _named_meta(name: str) -> Column:
    """Content of the first ``<meta name=...>``; an empty first one hides later ones."""
    tags = F.filter(F.col("metas"), lambda m: m["name"] == name)
    return F.coalesce(F.try_element_at(tags, F.lit(1))["content"], F.lit(""))


def _json_values(name: str) -> Column:
    return F.transform(
        F.filter(F.col("ld"), lambda f: f["field_name"] == name), lambda f: f["field_value"]
    )


def _business() -> Column:
    structured = F.filter(F.col("ld"), lambda f: f["field_name"].isin(*V.BUSINESS_FIELDS))
    return F.concat(
        structured,
        _open_graph(),
        _one(_named_meta("description"), "description", "meta-tag", V.META_CONFIDENCE),
        _one(F.col("title"), "name", "title-tag", V.META_CONFIDENCE),
    )


def _product() -> Column:
    return F.filter(F.col("ld"), lambda f: f["field_name"].isin(*V.PRODUCT_FIELDS))


def _generator() -> Column:
    return _one(_named_meta("generator"), "generator", "meta-tag", V.META_CONFIDENCE)


def _link_values(prefix: str) -> Column:
    """Values of links with a scheme prefix; the address ends at the query for mailto."""
    def value(href):
        rest = F.substring(href, len(prefix) + 1, 1 << 30)
        return H.strip(F.substring_index(rest, "?", 1) if prefix == "mailto:" else rest)

    chosen = F.filter(F.col("hrefs"), lambda h: F.lower(F.substring(h, 1, len(prefix))) == prefix)
    return F.filter(F.transform(chosen, value), lambda v: v != "")


def _contact() -> Column:
    """Emails, then phones; within a type a value counts once, from its first source.

    Sources in order: JSON-LD, links, page text. ``array_except`` keeps the first of equal values, so
    this is linear in the page.
    """
    ld_email, ld_phone = F.array_distinct(_json_values("email")), F.array_distinct(_json_values("telephone"))
    mailto = F.array_except(F.col("mailto"), F.col("ld_email"))
    in_text = F.array_except(F.col("text_emails"), F.array_union(F.col("ld_email"), F.col("mailto")))
    tel = F.array_except(F.col("tel"), F.col("ld_phone"))
    return (
        {"ld_email": ld_email, "ld_phone": ld_phone, "mailto": _link_values("mailto:"), "tel": _link_values("tel:")},
        F.concat(
            _fields(F.col("ld_email"), "email", "json-ld", V.JSON_LD_CONFIDENCE),
            _fields(mailto, "email", "mailto", V.MAILTO_CONFIDENCE),
            _fields(in_text, "email", "regex", V.TEXT_EMAIL_CONFIDENCE),
            _fields(F.col("ld_phone"), "phone", "json-ld", V.JSON_LD_CONFIDENCE),
            _fields(tel, "phone", "tel", V.TEL_CONFIDENCE),
        ),
    )


def _social(strict: bool) -> Column:
    """Profile links from JSON-LD sameAs, then from page links not seen there."""
    def with_platform(urls, method, confidence):
        fields = F.transform(
            urls,
            lambda u: F.struct(
                social_platform(u, strict).alias("field_name"),
                u.alias("field_value"),
                F.lit(method).alias("extraction_method"),
                F.lit(confidence).alias("confidence"),
            ),
        )
        return F.filter(fields, lambda f: f["field_name"].isNotNull())

    return (
        {"same_as": F.array_distinct(_json_values("sameAs"))},
        F.concat(
            with_platform(F.col("same_as"), "json-ld", V.SAME_AS_CONFIDENCE),
            with_platform(F.array_except(F.col("hrefs"), F.col("same_as")), "link", V.SOCIAL_LINK_CONFIDENCE),
        ),
    )


def _numbered(section: str, fields: Column) -> Column:
    return F.call_function(
        "transform",
        fields,
        F.expr(
            f"(f, i) -> struct('{section}' AS section, i AS seq, f.field_name AS field_name,"
            " f.field_value AS field_value, f.extraction_method AS extraction_method, f.confidence AS confidence)"
        ),
    )


def _signals() -> Column:
    """Platform signals as fields; their ``seq`` is the signal's rank, not its place in the page."""
    return F.call_function(
        "transform",
        F.col("signals"),
        F.expr(
            "s -> struct('platform' AS section, s.seq AS seq, 'platform' AS field_name, s.platform AS field_value,"
            " s.method AS extraction_method, s.confidence AS confidence)"
        ),
    )


def _read_mark() -> Column:
    return F.expr(
        "array(struct('page' AS section, 0 AS seq, 'url' AS field_name, source_url AS field_value,"
        " CAST(NULL AS STRING) AS extraction_method, CAST(NULL AS DOUBLE) AS confidence))"
    )


def _hash_mark() -> Column:
    return F.expr(
        "array(struct('hash' AS section, 0 AS seq, 'content_hash' AS field_name, hash AS field_value,"
        " CAST(NULL AS STRING) AS extraction_method, CAST(NULL AS DOUBLE) AS confidence))"
    )


#: Elements whose tags each section needs.
_TAGS = {"contact": "a", "social": "a", "business": "meta", "generator": "meta"}


def _parts(sections: tuple[str, ...]):
    """Parsed page parts that the sections need, by column name."""
    needed = {
        "ld": ({"business", "product", "contact", "social"}, lambda raw, _: json_ld.fields(json_ld.entries(H.json_ld_blocks(raw)))),
        "hrefs": ({"contact", "social"}, lambda *_: H.links(F.col("tags"))),
        "metas": ({"business", "generator"}, lambda *_: _metas(F.col("tags"))),
        "title": ({"business"}, lambda _, markup: H.title(markup)),
        "text_emails": ({"contact"}, lambda _, markup: H.visible_emails(markup)),
        "hash": ({"hash"}, lambda raw, _: H.content_hash(raw)),
        "lowered": ({"platform"}, lambda raw, _: F.lower(raw)),
    }
    return [(name, make) for name, (users, make) in needed.items() if users & set(sections)]


def observations(pages: DataFrame, sections: Iterable[str] = SECTIONS, strict_socials: bool = False) -> DataFrame:
    """Observations of ``pages(page_seq, url, raw_html [, from_cache])``.

    ``page_seq`` orders the pages of a domain and ``seq`` the fields of a page's section, so "first
    seen" stays defined after any shuffle. ``sections`` limits the work to what is needed.
    """
    sections = tuple(sections)
    df = spread_small(fresh_pages(pages), "page_seq").select(
        canonical_domain(F.col("url")).alias("canonical_domain"),
        F.col("page_seq").cast("long").alias("page_seq"),
        F.col("url").alias("source_url"),
        F.col("raw_html"),
        H.visible_markup(F.col("raw_html")).alias("markup"),
    )
    markup, raw = F.col("markup"), F.col("raw_html")
    elements = sorted({_TAGS[s] for s in sections if s in _TAGS})
    if elements:
        df = df.withColumn("tags", H.tags(markup, *elements))
    parsed = df.select(
        "canonical_domain", "page_seq", "source_url", *[make(raw, markup).alias(name) for name, make in _parts(sections)]
    )
    if "platform" in sections:
        parsed = parsed.withColumn("signals", platform_signals())
    arrays: list[Column] = []
    prepared: dict[str, Column] = {}
    for section in sections:
        if section == "contact":
            columns, fields = _contact()
            prepared.update(columns)
            arrays.append(_numbered(section, fields))
        elif section == "social":
            columns, fields = _social(strict_socials)
            prepared.update(columns)
            arrays.append(_numbered(section, fields))
        elif section == "platform":
            arrays.append(_signals())
        elif section == "page":
            arrays.append(_read_mark())
        elif section == "hash":
            arrays.append(_hash_mark())
        else:
            fields = {"business": _business, "product": _product, "generator": _generator}[section]()
            arrays.append(_numbered(section, fields))
    if prepared:
        parsed = parsed.withColumns(prepared)
    rows = parsed.select("canonical_domain", "page_seq", "source_url", F.inline(F.concat(*arrays)))
    return rows.select(
        "canonical_domain", "page_seq", "section", "seq", "field_name", "field_value", "source_url",
        "extraction_method", "confidence",
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page: ``(canonical_domain, page_seq, link_seq, href)``."""
    return spread_small(fresh_pages(pages), "page_seq").select(
        canonical_domain(F.col("url")).alias("canonical_domain"),
        F.col("page_seq").cast("long").alias("page_seq"),
        F.posexplode(H.links(H.tags(H.visible_markup(F.col("raw_html")), "a"))).alias("link_seq", "href"),
    )


def text_emails(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct address-shaped parts of each whole text, first occurrence order in ``seq``."""
    found = F.array_distinct(H.text_emails(F.col(text)))
    return spread_small(texts, key).select(key, F.posexplode(found).alias("seq", "raw_email"))
