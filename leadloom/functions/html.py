"""HTML expressions over whole page texts: markup cleaning, links, meta tags, title, visible text.

Every pattern runs in time linear in the page: repetition over attributes is possessive, so a broken
page can neither backtrack nor recurse deeply, and character references are decoded in one pass.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from leadloom import fixed_values as V
from leadloom.functions.binding import apply

# Comments and elements whose content is not page text; an unclosed one reaches to the end.
_COMMENT = r"!--.*?(?:-->|\z)"
_SCRIPT = r"script\b.*?(?:</script\s*>|\z)"
_STYLE = r"style\b.*?(?:</style\s*>|\z)"
_TEMPLATE = r"template\b.*?(?:</template\s*>|\z)"
HIDDEN = rf"(?is)<(?:{_COMMENT}|{_SCRIPT}|{_STYLE})"
TEMPLATES = rf"(?is)<{_TEMPLATE}"
SCRIPTS = rf"(?is)<(?:{_COMMENT}|{_SCRIPT})"
# Attributes of a tag: a quote opens a value only after "=".
_ATTRIBUTES = r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>=]*+)?+[^>=]*+)*+"
TAG = rf"(?s)</?[A-Za-z!?](?:[^>=]*+>|{_ATTRIBUTES}(?:>|\z))|</?[A-Za-z!?][^>]*(?:>|\z)"
BOUNDARY = "\u0001"
BLANKS = " \t\n\r\f\u000b\u00a0"

# Same matches as the plain pattern, but a local part is only tried where it starts, which keeps
# the search linear on long runs of address characters.
LINEAR_EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)" + V.TEXT_EMAIL.replace("+@", "++@", 1)
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def visible_markup(html: Column) -> Column:
    """The page without comments, scripts and styles; each leaves an empty tag behind.

    Templates stay, since their links and tags count; ``visible_text`` leaves their text out.
    """
    return F.regexp_replace(html, HIDDEN, "<!>")


def tags(markup: Column, *names: str) -> Column:
    """Start tags of some elements as ``(name, names, values)``, in document order, by one scan of the page.

    The scan takes every tag whole, with its quoted values, so what stands inside a value is never taken for a tag.
    ``names`` and ``values`` are the tag's attributes as written, names in lower case.
    """
    # Other tags match too, which moves the scan past them, but leave the wanted group empty.
    pattern = rf"(?is)<(?:((?:{'|'.join(names)})(?=[\s/]){_ATTRIBUTES})|/?[a-z]{_ATTRIBUTES})"
    wanted = F.filter(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1)), lambda tag: tag != "")

    def parsed(tag):
        body = F.regexp_replace(tag, r"^[A-Za-z][^\s/>]*+", "")
        return F.struct(
            F.lower(F.regexp_extract(tag, "^[A-Za-z]+", 0)).alias("name"),
            F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
            F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2)).alias("values"),
        )

    return F.transform(wanted, parsed)


# One attribute after another, quoted values whole, so nothing inside a value is taken for a name.
_ATTRIBUTE = r"(?s)([^\s\"'>/=][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+))?+"


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute ``name`` of a parsed tag; '' when absent or empty."""
    place = F.nullif(F.array_position(tag["names"], name).cast("int"), F.lit(0))
    raw = F.coalesce(F.try_element_at(tag["values"], place), F.lit(""))
    value = F.regexp_replace(raw, r"(?s)^\"([^\"]*)\"?$|^'([^']*)'?$", "$1$2")
    return F.when(raw != "", decode_entities(value, legacy=False)).otherwise("")


# The named references of the HTML standard, as the standard library lists them.
_NAMED = {name.removesuffix(";"): char for name, char in html5.items() if name.endswith(";")}
_LEGACY = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
# References to the code points 128 to 159 mean the characters of Windows-1252.
_WINDOWS = [bytes([n]).decode("cp1252", "replace") if n not in (129, 141, 143, 144, 157) else chr(n) for n in range(128, 160)]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decode_lambda(legacy: bool) -> str:
    """SQL lambda that decodes all character references of a text in one pass.

    The text is cut at its ampersands; each part but the first begins with a reference or not, is mapped on
    its own, and the parts are joined again. So nothing is decoded twice and the work is linear. Code points
    that are no characters become U+FFFD.
    """
    digits = "ltrim('0', lower(regexp_extract(p, '^#[xX]?0*([0-9a-fA-F]+)', 1)))"
    code = f"CASE WHEN length({digits}) > 7 THEN 1114112 WHEN p RLIKE '^#[xX]' THEN CAST(conv({digits}, 16, 10) AS BIGINT)" \
           f" ELSE CAST(coalesce(nullif({digits}, ''), '0') AS BIGINT) END"
    windows = "array(" + ", ".join(_sql(c) for c in _WINDOWS) + ")"
    char = (
        f"CASE WHEN c BETWEEN 128 AND 159 THEN element_at({windows}, CAST(c - 127 AS INT)) ELSE decode(unhex(lpad(hex("
        "CASE WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 THEN c ELSE 65533 END), 8, '0')), 'UTF-32') END"
    )
    rest = "regexp_replace(p, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?', '')"
    numeric = f"concat(transform(array({code}), c -> {char})[0], {rest})"
    common = " ".join(f"WHEN startswith(p, '{n};') THEN concat({_sql(c)}, substring(p, {len(n) + 2}))" for n, c in _COMMON.items())
    # A map is searched from its start, so names are first told apart by two letters.
    by_start: dict[str, dict[str, str]] = {}
    for name, char_ in _NAMED.items():
        by_start.setdefault(name[:2], {})[name] = char_
    table = f"from_json({_sql(json.dumps(by_start))}, 'map<string,map<string,string>>')"
    look_up = lambda name: f"element_at(element_at({table}, substring(p, 1, 2)), {name})"
    known = look_up("regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)")
    named = f"concat({known}, regexp_replace(p, '^[A-Za-z][A-Za-z0-9]*;', ''))"
    bare = "concat('&', p)"
    if legacy:
        prefix = f"regexp_extract(p, '^(?:{'|'.join(_LEGACY)})', 0)"
        bare = f"CASE WHEN {prefix} <> '' THEN concat({look_up(prefix)}, substring(p, length({prefix}) + 1)) ELSE {bare} END"
    part = (
        f"CASE WHEN p RLIKE '^#(?:[xX][0-9a-fA-F]|[0-9])' THEN {numeric} {common}"
        f" WHEN p RLIKE '^[A-Za-z]' THEN coalesce({named}, {bare}) ELSE concat('&', p) END"
    )
    parts = "split(t, '&')"
    return (
        f"t -> CASE WHEN contains(t, '&') THEN array_join(transform({parts}, (p, i) -> CASE WHEN i = 0 THEN p ELSE {part} END), '')"
        " ELSE t END"
    )


_DECODE_TEXT, _DECODE_ATTRIBUTE = _decode_lambda(True), _decode_lambda(False)


def decode_entities(text: Column, legacy: bool = True) -> Column:
    """Decode all named and numeric character references; ``legacy`` accepts the old names without the semicolon."""
    return apply(_DECODE_TEXT if legacy else _DECODE_ATTRIBUTE, text)


def links(parsed: Column) -> Column:
    """Non-empty ``href`` of every ``<a>`` among parsed ``tags``, in document order."""
    anchors = F.filter(parsed, lambda tag: tag["name"] == "a")
    return F.filter(F.transform(anchors, lambda tag: attribute(tag, "href")), lambda h: h != "")


def title(markup: Column) -> Column:
    """Stripped text of the first title; '' when there is none."""
    return strip(decode_entities(F.regexp_extract(markup, r"(?is)<title\b[^>]*>(.*?)</title", 1)))


def visible_text(markup: Column) -> Column:
    """Page text with a space where tags were; templates have none."""
    return decode_entities(F.regexp_replace(F.regexp_replace(markup, TEMPLATES, "<!>"), TAG, " "))


def visible_length(markup: Column) -> Column:
    """Number of characters of the stripped text pieces between tags."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(markup, TEMPLATES, "<!>"), TAG, BOUNDARY), BOUNDARY)
    return F.aggregate(
        pieces, F.lit(0), lambda total, piece: total + F.length(strip(decode_entities(piece)))
    )


def text_emails(text: Column) -> Column:
    """Every address-shaped part of a text, in order, repeats included."""
    lambda_ = (
        f"t -> CASE WHEN contains(t, '@') THEN regexp_extract_all(t, r'{LINEAR_EMAIL}', 0)"
        " ELSE CAST(array() AS ARRAY<STRING>) END"
    )
    return apply(lambda_, text)


def visible_emails(markup: Column) -> Column:
    """``text_emails`` of the visible text; pages without an at sign skip the work."""
    possible = markup.contains("@") | markup.contains("&#")
    return F.when(possible, text_emails(visible_text(markup))).otherwise(F.array().cast("array<string>"))


def json_ld_blocks(html: Column) -> Column:
    """Content of every script typed ``application/ld+json``, in document order."""
    scripts = F.filter(
        F.regexp_extract_all(html, F.lit(SCRIPTS), F.lit(0)),
        lambda s: s.rlike(r"(?i)^<script\s[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"'\s>]"),
    )
    bodies = F.transform(scripts, lambda s: F.regexp_replace(s, r"(?is)^<script[^>]*>|</script\s*>\z", ""))
    return F.when(html.contains("ld+json"), bodies).otherwise(F.array().cast("array<string>"))


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)
