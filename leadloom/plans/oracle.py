"""Check SQL for the registered queries: the same questions asked of DuckDB, over the same tables.

Every statement is assembled from the named subqueries it needs. They are written independently of the
Spark expressions, in set-based SQL, with windows where the jobs aggregate.
"""

from __future__ import annotations

import re

from leadloom import fixed_values as V
from leadloom.plans.corpus import EARLIER, NOW, SIGNAL_HTML

LATE_JANUARY = "2024-01-20 12:00:00"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(value: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({value}, {q(pattern)}, {q(replacement)}, 'g')"


WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))"
now, earlier = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{EARLIER}'"
nothing = {t: f"CAST(NULL AS {t})" for t in ("VARCHAR", "BIGINT", "TIMESTAMP", "DOUBLE", "INTEGER")}


def trim(value: str) -> str:
    return f"trim({value}, {WS})"


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def with_authority(url: str) -> str:
    return f"(CASE WHEN contains({url}, '://') THEN {url} ELSE '//' || {url} END)"


def domain(url: str) -> str:
    return f"regexp_replace(lower({authority(with_authority(url))}), '^www\\.', '')"


def scheme(url: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({with_authority(url)}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)), ''), 'https')"


def path(url: str) -> str:
    bare = f"regexp_replace({url}, '[?#].*$', '')"
    tail = f"regexp_replace({bare}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/]*)?', '')"
    return f"regexp_replace({tail}, ';[^/]*$', '')"


def page_type(p: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({p}, {q('(?i)' + pat)}) THEN {q(kind)}" for kind, _, pat in V.PAGE_TYPES)
    return f"CASE {whens} ELSE 'other' END"


def page_priority(p: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({p}, {q('(?i)' + pat)}) THEN {rank}" for _, rank, pat in V.PAGE_TYPES)
    return f"CAST(CASE WHEN {p} IN ('', '/') THEN 1.0 {whens} ELSE 0.1 END AS DOUBLE)"


def stable_id(*parts: str) -> str:
    key = " || chr(1) || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT)"


def decode(text: str, close: str) -> str:
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " ")):
        text = sub(text, f"&{entity}{close}", char)
    # Of other references the pages hold just these.
    for reference, char in (("eacute;", "é"), ("#0*66;", "B"), ("copy;", "©"), ("middot;", "·")):
        text = sub(text, f"&{reference}", char)
    return sub(text, f"&amp{close}", "&")


def attribute(tag: str, name: str) -> str:
    """Value of the first attribute of that name, from the list of all name and value pairs of the tag."""
    body, pair = f"regexp_replace({tag}, '^<[A-Za-z]+', '')", q(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
    names = f"list_transform(regexp_extract_all({body}, {pair}, 1), lambda n : lower(n))"
    raw = f"coalesce(regexp_extract_all({body}, {pair}, 2)[nullif(list_position({names}, {q(name)}), 0)], '')"
    return decode(f"regexp_replace({raw}, {q(r'''(?s)^["'](.*)["']$''')}, '\\1')", ";")


def social(url: str, strict: bool = False) -> str:
    u = f"lower({url})"
    host = authority(u)
    def hit(d):
        return f"({host} = {q(d)} OR {host} LIKE {q('%.' + d)})" if strict else f"contains({u}, {q(d)})"
    whens = " ".join(f"WHEN {hit(d)} THEN {q(p)}" for d, p in V.SOCIAL_DOMAINS)
    return f"CASE {whens} END"


def normalize_email(value: str) -> str:
    return (
        f"CASE WHEN length({value}) <= 254 AND length(split_part({value}, '@', 1)) <= 64"
        f" AND len(string_split({value}, '@')) = 2 AND NOT contains({value}, '..')"
        f" AND regexp_matches(lower({value}), {q(EMAIL_PARTS)}) AND NOT regexp_matches({value}, {q(EDGES)})"
        f" AND split_part(lower({value}), '.', -1) NOT IN ('alt', 'arpa', 'invalid', 'local', 'localhost', 'onion', 'test')"
        f" THEN replace(nfc_normalize(lower({value})), 'xn--mnchen-3ya', 'm\u00fcnchen') END"  # the one encoded host there is
    )


# An address by what its characters may be and what may not stand at the edges of its parts.
EMAIL_PARTS = r"^[\w.!#$%&'*+/=?^`{|}~-]+@[\p{L}\p{M}0-9.-]+[.](?:[a-z]{2,63}|xn--[a-z0-9-]{0,58}[a-z0-9])$"
EDGES = r"^[.]|[.]@|@[.-]|-[.]|[.]-|@.*[^.@]{64}"
# By calling code of one, two or three digits, every length and first digit that its numbers may have.
NUMBER_KINDS = " ".join(
    f"{code}:{n}:{d}"
    for code, lengths, digits in (line.split() for line in V.NATIONAL_NUMBERS.strip().splitlines())
    for part in lengths.split(",") for n in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)
    for d in range(10) if re.match(f"[{digits}]", str(d)))
AREAS = " ".join(V.AREA_CODES.values())


def normalize_phone(value: str) -> str:
    bare = sub(
        f"regexp_extract({trim(f'lower({value})')}, {q('(?s)[+(0-9].*$')}, 0)",
        r"(?:;ext=|,?\s*ext\.?|\s*x|\s*#)\s*[0-9]{1,7}\s*$",
    )
    keyed = (
        f"CASE WHEN regexp_matches(b, '[a-z][^a-z]*[a-z][^a-z]*[a-z]')"
        f" THEN translate(b, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') ELSE b END"
    )
    return (
        f"(SELECT CASE WHEN n NOT LIKE '+%' OR n LIKE '+1%' THEN"
        f" CASE WHEN ten <> '' AND contains(' {AREAS} ', ' ' || substr(ten, 1, 3) || ' ') THEN '+1' || ten END"
        f" WHEN length(n) <= 16 AND len(list_filter([1, 2, 3], lambda k : contains(' {NUMBER_KINDS} ',"
        f" ' ' || substr(n, 2, k) || ':' || (length(n) - 1 - k) || ':' || substr(n, 2 + k, 1) || ' '))) > 0 THEN n END"
        f" FROM (SELECT n, regexp_extract(n, '^(?:\\+?1)?([2-9][0-9][0-9][2-9][0-9]{{6}})$', 1) AS ten"
        f" FROM (SELECT CASE WHEN b LIKE '+%' OR b LIKE '(+%' THEN '+' || d ELSE regexp_replace(d, '^011', '+') END AS n"
        f" FROM (SELECT b, {sub(keyed, '[^0-9]')} AS d FROM (SELECT {bare} AS b)))))"
    )


def text_at(entry: str, key: str) -> str:
    at = q(f'$."{key}"')
    return f"CASE WHEN json_type({entry}, {at}) = 'VARCHAR' THEN nullif({trim(f'json_extract_string({entry}, {at})')}, '') END"


def strings_at(entry: str, key: str) -> str:
    """A JSON string or list as a list of its elements, kept as JSON."""
    at = q(f'$."{key}"')
    return (
        f"(CASE json_type({entry}, {at}) WHEN 'ARRAY' THEN CAST(json_extract({entry}, {at}) AS JSON[])"
        f" WHEN 'VARCHAR' THEN [json_extract({entry}, {at})] ELSE [] END)"
    )


HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
)
TEMPLATE = r"(?is)<template\b.*?(?:</template\s*>|\z)"
SCRIPTS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
TAG = r"(?s)</?[A-Za-z!?][^>]*(?:>|\z)"

_ld_fields = " UNION ALL ".join(
    f"SELECT *, {rank} AS keypos, 0 AS sub, {q(name)} AS field_name, {text_at(source, key)} AS field_value FROM entry"
    for rank, (source, key, name) in enumerate(
        [("e", k, n) for k, n in V.JSON_LD_SCALARS]
        + [("json_extract(e, '$.address')", k, n) for k, n in V.JSON_LD_ADDRESS]
    )
)
_ld_product = " UNION ALL ".join(
    f"SELECT *, {rank}, 0, {q(name)}, CASE WHEN is_product THEN {text_at('e', key)} END FROM entry"
    for rank, (key, name) in ((20, ("name", "product_name")), (21, ("category", "category")))
)
_signals = ", ".join(
    f"({rank}, {q(platform)}, {q('(?i)' + pattern)}, CAST({confidence} AS DOUBLE), {q(method)})"
    for rank, (platform, pattern, confidence, method) in enumerate(V.PLATFORM_SIGNALS)
)
_business_list = ", ".join(q(f) for f in V.BUSINESS_FIELDS)
_obs_cols = "canonical_domain, page_seq, section, seq, field_name, field_value, source_url, extraction_method, confidence"


def _one_row_per(keys: str, order: str, source: str, columns: str = "*") -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn_ FROM {source}) WHERE rn_ = 1"
    )


def _socials(strict: bool) -> str:
    return f"""
SELECT canonical_domain, page_seq, 'social' AS section, CAST(row_number() OVER (PARTITION BY page_seq ORDER BY src, a, b, c, d) - 1 AS INTEGER) AS seq,
       {social('field_value', strict)} AS field_name, field_value, url AS source_url,
       CASE src WHEN 0 THEN 'json-ld' ELSE 'link' END AS extraction_method, CAST(CASE src WHEN 0 THEN 0.92 ELSE 0.85 END AS DOUBLE) AS confidence
FROM ({_one_row_per('page_seq, field_value', 'src, a, b, c, d', 'social_raw')}) WHERE {social('field_value', strict)} IS NOT NULL"""


def _detail(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)


def _left(link: str) -> str:
    """A reference to a business, unless that was deleted."""
    return f"CASE WHEN {link} NOT IN (SELECT id FROM deleted) THEN {link} END"


def _escaped(path: str) -> str:
    """A path of letters and a few signs with its other signs as escapes."""
    return f"replace(url_encode({path}), '%2F', '/')"


def _half_resolved(half: int, stored: str) -> str:
    """Records of one half of the pages, each with the business that held one of its values first, if any."""
    return f"""
SELECT h.canonical_domain, place, first.business_id AS duplicate_of FROM half_record h LEFT JOIN (
  SELECT v.canonical_domain, min({{'place': o.place, 'business_id': o.business_id}}) AS first
  FROM half_value v JOIN half_record r ON r.half = v.half AND r.canonical_domain = v.canonical_domain
  JOIN ({stored} UNION ALL SELECT value, place, {stable_id('x.canonical_domain')} FROM half_value x JOIN half_record y
        ON x.half = y.half AND x.canonical_domain = y.canonical_domain WHERE x.half = {half}) o ON o.value = v.value AND o.place < r.place
  WHERE v.half = {half} GROUP BY 1) USING (canonical_domain) WHERE h.half = {half}"""


CTES: dict[str, str] = {
    # pages and their parts
    "raw": f"SELECT page_id AS page_seq, url, html, {domain('url')} AS canonical_domain, {path('url')} AS path FROM pages",
    "sig": f"SELECT page_id AS page_seq, url, {domain('url')} AS canonical_domain, {SIGNAL_HTML} AS html FROM pages",
    "page": f"SELECT *, {sub('html', HIDDEN, '<!>')} AS markup FROM sig",
    # Every tag with its quoted values, found by what may stand between its signs.
    "tag": f"""
SELECT page_seq, canonical_domain, url, pos, tag
FROM page, unnest(regexp_extract_all(markup, {q(r"""(?s)<[A-Za-z/!](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*""")})) WITH ORDINALITY AS t(tag, pos)""",
    "link": f"""
SELECT page_seq, canonical_domain, url, CAST(row_number() OVER (PARTITION BY page_seq ORDER BY pos) - 1 AS INTEGER) AS link_seq, href FROM (
  SELECT page_seq, canonical_domain, url, pos, {attribute('tag', 'href')} AS href
  FROM tag WHERE regexp_matches(tag, '(?i)^<a\\s')) WHERE href <> ''""",
    "meta": f"""
SELECT page_seq, canonical_domain, url, pos, {attribute('tag', 'name')} AS name, {attribute('tag', 'property')} AS property,
       {trim(attribute('tag', 'content'))} AS content
FROM tag WHERE regexp_matches(tag, '(?i)^<meta\\s')""",
    "title": f"SELECT page_seq, canonical_domain, url, {trim(decode('regexp_extract(markup, ' + q('(?is)<title[^>]*>(.*?)</title') + ', 1)', ';?'))} AS title FROM page",
    "text_email": f"""
SELECT page_seq, canonical_domain, url, pos, email
FROM page, unnest(regexp_extract_all({decode(sub(sub('markup', TEMPLATE, '<!>'), TAG, ' '), ';?')}, {q(V.TEXT_EMAIL)})) WITH ORDINALITY AS t(email, pos)""",
    # JSON-LD
    "block": f"""
SELECT page_seq, canonical_domain, url, pos AS block, {sub('script', '(?is)^<script[^>]*>|</script\\s*>$')} AS body
FROM sig, unnest(regexp_extract_all(html, {q(SCRIPTS)})) WITH ORDINALITY AS t(script, pos)
WHERE regexp_matches(script, {q('(?i)^<script[^>]*type="application/ld[+]json"')})""",
    "entry": f"""
SELECT page_seq, canonical_domain, url, block, pos AS entry, e,
       len(list_filter({strings_at('e', '@type')}, lambda t : json_type(t) = 'VARCHAR' AND contains(json_extract_string(t, '$'), 'Product'))) > 0 AS is_product
FROM (SELECT *, CAST(body AS JSON) AS j FROM block WHERE json_valid(body)),
     unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) WITH ORDINALITY AS t(e, pos)
WHERE json_type(e) = 'OBJECT'""",
    "ld": f"""
SELECT page_seq, canonical_domain, url, block, entry, keypos, sub, field_name, field_value FROM (
  {_ld_fields}
  UNION ALL SELECT entry.*, 10, pos, 'sameAs', CASE WHEN json_type(s) = 'VARCHAR' THEN nullif({trim("json_extract_string(s, '$')")}, '') END
            FROM entry, unnest({strings_at('e', 'sameAs')}) WITH ORDINALITY AS t(s, pos)
  UNION ALL {_ld_product}) WHERE field_value IS NOT NULL""",
    # observations
    "business_raw": f"""
SELECT page_seq, canonical_domain, url, 0 AS src, block AS a, entry AS b, keypos AS c, field_name, field_value, 'json-ld' AS extraction_method, 0.92 AS confidence FROM ld WHERE field_name IN ({_business_list})
UNION ALL SELECT page_seq, canonical_domain, url, 1, pos, 0, 0, CASE property WHEN 'og:description' THEN 'description' ELSE 'name' END, content, 'og-tag', 0.75 FROM meta WHERE property IN ('og:title', 'og:site_name', 'og:description') AND content <> ''
UNION ALL SELECT page_seq, canonical_domain, url, 2, 0, 0, 0, 'description', content, 'meta-tag', 0.55 FROM ({_one_row_per('page_seq', 'pos', "meta WHERE name = 'description'")}) WHERE content <> ''
UNION ALL SELECT page_seq, canonical_domain, url, 3, 0, 0, 0, 'name', title, 'title-tag', 0.55 FROM title WHERE title <> ''""",
    "business": "SELECT canonical_domain, page_seq, 'business' AS section, CAST(row_number() OVER (PARTITION BY page_seq ORDER BY src, a, b, c) - 1 AS INTEGER) AS seq, field_name, field_value, url AS source_url, extraction_method, CAST(confidence AS DOUBLE) AS confidence FROM business_raw",
    "product": "SELECT canonical_domain, page_seq, 'product' AS section, CAST(row_number() OVER (PARTITION BY page_seq ORDER BY block, entry, keypos) - 1 AS INTEGER) AS seq, field_name, field_value, url AS source_url, 'json-ld' AS extraction_method, CAST(0.92 AS DOUBLE) AS confidence FROM ld WHERE field_name IN ('product_name', 'category')",
    "generator": f"SELECT canonical_domain, page_seq, 'generator' AS section, CAST(0 AS INTEGER) AS seq, 'generator' AS field_name, content AS field_value, url AS source_url, 'meta-tag' AS extraction_method, CAST(0.55 AS DOUBLE) AS confidence FROM ({_one_row_per('page_seq', 'pos', chr(109) + 'eta WHERE name = ' + q('generator'))}) WHERE content <> ''",
    "contact_raw": f"""
SELECT page_seq, canonical_domain, url, CASE field_name WHEN 'email' THEN 'email' ELSE 'phone' END AS field_name, 0 AS src, block AS a, entry AS b, field_value FROM ld WHERE field_name IN ('email', 'telephone')
UNION ALL SELECT page_seq, canonical_domain, url, 'email', 1, link_seq, 0, {trim("split_part(substr(href, 8), '?', 1)")} FROM link WHERE lower(href) LIKE 'mailto:%'
UNION ALL SELECT page_seq, canonical_domain, url, 'phone', 1, link_seq, 0, {trim('substr(href, 5)')} FROM link WHERE lower(href) LIKE 'tel:%'
UNION ALL SELECT page_seq, canonical_domain, url, 'email', 2, pos, 0, email FROM text_email""",
    "contact": f"""
SELECT canonical_domain, page_seq, 'contact' AS section, CAST(row_number() OVER (PARTITION BY page_seq ORDER BY field_name, src, a, b) - 1 AS INTEGER) AS seq,
       field_name, field_value, url AS source_url,
       CASE src WHEN 0 THEN 'json-ld' WHEN 2 THEN 'regex' ELSE CASE field_name WHEN 'email' THEN 'mailto' ELSE 'tel' END END AS extraction_method,
       CAST(CASE src WHEN 0 THEN 0.92 WHEN 2 THEN 0.6 ELSE CASE field_name WHEN 'email' THEN 0.97 ELSE 0.95 END END AS DOUBLE) AS confidence
FROM ({_one_row_per('page_seq, field_name, field_value', 'src, a, b', "contact_raw WHERE field_value <> ''")})""",
    "social_raw": """
SELECT page_seq, canonical_domain, url, 0 AS src, block AS a, entry AS b, keypos AS c, sub AS d, field_value FROM ld WHERE field_name = 'sameAs'
UNION ALL SELECT page_seq, canonical_domain, url, 1, link_seq, 0, 0, 0, href FROM link""",
    "social": _socials(False),
    "strict_social": _socials(True),
    "obs": " UNION ALL ".join(f"SELECT {_obs_cols} FROM {t}" for t in ("business", "product", "contact", "social", "generator")),
    # platform
    "evidence": f"""
SELECT canonical_domain, page_seq, 'platform' AS section, CAST(rank AS INTEGER) AS seq, 'platform' AS field_name, platform AS field_value,
       url AS source_url, method AS extraction_method, confidence
FROM sig JOIN (VALUES {_signals}) AS s(rank, platform, pattern, confidence, method) ON regexp_matches(html, pattern)""",
    "domains": "SELECT canonical_domain, min(page_seq) AS record_order FROM raw GROUP BY 1",
    "best_platform": _one_row_per("canonical_domain", "confidence DESC, page_seq, seq", "evidence"),
    "platform": "SELECT canonical_domain, coalesce(field_value, 'unknown') AS platform, CAST(coalesce(confidence, 0) AS DOUBLE) AS platform_confidence FROM domains LEFT JOIN best_platform USING (canonical_domain)",
    "platform_rows": "SELECT evidence.* FROM evidence JOIN platform ON evidence.canonical_domain = platform.canonical_domain AND field_value = platform",
    # records
    "norm": f"""
SELECT canonical_domain, page_seq, section, seq, field_name, value AS field_value, source_url, extraction_method, confidence FROM (
  SELECT *, CASE field_name WHEN 'email' THEN {normalize_email('field_value')} ELSE {normalize_phone('field_value')} END AS value FROM contact) WHERE value IS NOT NULL""",
    "best_field": _one_row_per("canonical_domain, field_name", "confidence DESC, page_seq, seq", "business", "canonical_domain, field_name, field_value, confidence"),
    "fields": "SELECT canonical_domain, " + ", ".join(f"max(field_value) FILTER (WHERE field_name = {q(f)}) AS {f}" for f in V.BUSINESS_FIELDS) + " FROM best_field GROUP BY 1",
    "tally": """
SELECT canonical_domain, CAST(sum(n) FILTER (WHERE section = 'contact') AS BIGINT) AS n_contacts, CAST(sum(n) FILTER (WHERE section = 'social') AS BIGINT) AS n_socials,
       string_agg(field_name || '=' || printf('%.2f', best), ',' ORDER BY field_name) AS field_confidence
FROM (SELECT canonical_domain, section, field_name, count(*) AS n, max(confidence) AS best FROM (SELECT canonical_domain, section, field_name, confidence FROM norm UNION ALL SELECT canonical_domain, section, field_name, confidence FROM social) GROUP BY ALL) GROUP BY 1""",
    "header": f"""
SELECT canonical_domain, record_order, {', '.join(V.BUSINESS_FIELDS)}, platform, platform_confidence,
       coalesce(n_contacts, 0) AS n_contacts, coalesce(n_socials, 0) AS n_socials, coalesce(field_confidence, '') AS field_confidence
FROM domains LEFT JOIN fields USING (canonical_domain) LEFT JOIN platform USING (canonical_domain) LEFT JOIN tally USING (canonical_domain)""",
    "record_value": "SELECT DISTINCT canonical_domain, field_value AS value FROM norm",
    # stored tables
    "known": f"""
SELECT {stable_id('canonical_domain')} AS business_id, canonical_domain, record_order,
       CASE WHEN record_order % 4 = 0 THEN 'Known ' || canonical_domain END AS name, CASE WHEN record_order % 4 = 0 THEN 'unknown' END AS platform
FROM domains WHERE record_order % 2 = 0""",
    "known_contact": f"""
SELECT {stable_id('canonical_domain', q('email'), 'value')} AS contact_id, business_id, 'email' AS type, value, 'https://' || canonical_domain || '/' AS source_url
FROM (SELECT *, 'sales' || (record_order % 15) || '@shop.com' AS value FROM known)""",
    "known_social": f"""
SELECT {stable_id('canonical_domain', q('known'), 'url')} AS social_id, business_id, 'facebook' AS platform, url,
       'https://' || canonical_domain || '/' AS source_url, {earlier} AS created_at
FROM (SELECT *, 'https://www.facebook.com/p' || (record_order % 9) AS url FROM known)""",
    # resolution
    "placed": f"SELECT d.canonical_domain, d.record_order, k.business_id AS stored_id, coalesce(k.business_id, {stable_id('d.canonical_domain')}) AS business_id FROM domains d LEFT JOIN known k USING (canonical_domain)",
    "holder": """
SELECT value, record_order AS since, business_id FROM record_value JOIN placed USING (canonical_domain)
UNION ALL SELECT value, -1, business_id FROM known_contact""",
    "earlier_holder": """
SELECT r.canonical_domain, h.since, h.business_id, row_number() OVER (PARTITION BY r.canonical_domain ORDER BY h.since, h.business_id) AS n
FROM record_value r JOIN placed p USING (canonical_domain) JOIN holder h ON h.value = r.value AND h.since < p.record_order WHERE p.stored_id IS NULL""",
    "resolved": """
SELECT p.canonical_domain, p.record_order, p.business_id,
       CASE WHEN stored_id IS NOT NULL THEN 'auto_merge' WHEN h.business_id IS NOT NULL THEN 'flag_possible_duplicate' ELSE 'create_new' END AS action,
       coalesce(stored_id, h.business_id) AS target_business_id,
       CAST(CASE WHEN stored_id IS NOT NULL THEN 1.0 WHEN h.business_id IS NOT NULL THEN 0.85 END AS DOUBLE) AS match_score,
       CASE WHEN stored_id IS NOT NULL THEN 'strong' WHEN h.business_id IS NOT NULL THEN 'medium' END AS match_level
FROM placed p LEFT JOIN (SELECT * FROM earlier_holder WHERE n = 1) h USING (canonical_domain)""",
    "match_pair": """
SELECT canonical_domain, business_id, match_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_domain ORDER BY match_score DESC, business_id) AS rank FROM (
    SELECT canonical_domain, business_id, max(score) AS match_score FROM (
      SELECT d.canonical_domain, k.business_id, CAST(1.0 AS DOUBLE) AS score FROM domains d JOIN known k USING (canonical_domain)
      UNION ALL SELECT r.canonical_domain, c.business_id, CAST(0.85 AS DOUBLE) FROM record_value r JOIN known_contact c USING (value)) GROUP BY ALL)) WHERE rank <= 20""",
    "merged": f"""
SELECT coalesce(k.business_id, r.business_id) AS business_id, h.canonical_domain, coalesce(k.name, h.name) AS name, {nothing['VARCHAR']} AS website, h.description,
       {nothing['VARCHAR']} AS category, {nothing['VARCHAR']} AS subcategory, h.country, h.state, h.city, {nothing['VARCHAR']} AS address,
       coalesce(k.platform, h.platform) AS platform, CASE WHEN k.platform IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE h.platform_confidence END AS platform_confidence,
       CASE WHEN r.action = 'flag_possible_duplicate' THEN 'possible_duplicate' ELSE 'active' END AS merge_status,
       CASE WHEN r.action = 'flag_possible_duplicate' THEN r.target_business_id END AS duplicate_of_id,
       CASE WHEN r.action = 'flag_possible_duplicate' THEN r.match_score END AS match_score,
       CASE WHEN k.business_id IS NULL THEN {now} ELSE {earlier} END AS created_at,
       CASE WHEN k.business_id IS NULL OR (k.name IS NULL AND h.name IS NOT NULL) OR h.description IS NOT NULL OR h.country IS NOT NULL OR h.state IS NOT NULL
              OR h.city IS NOT NULL OR k.platform IS NULL THEN {now} ELSE {earlier} END AS updated_at
FROM header h JOIN resolved r USING (canonical_domain) LEFT JOIN known k USING (canonical_domain)""",
    "contact_row": f"""
SELECT {stable_id('canonical_domain', 'field_name', 'field_value')} AS contact_id, {stable_id('canonical_domain')} AS business_id, field_name AS type,
       field_value AS value, source_url, confidence AS extraction_confidence
FROM ({_one_row_per('canonical_domain, field_name, field_value', 'page_seq, seq', 'norm')})""",
    "social_row": f"""
SELECT {stable_id('canonical_domain', 'field_name', 'field_value')} AS social_id, {stable_id('canonical_domain')} AS business_id, field_name AS platform,
       field_value AS url, source_url, {now} AS created_at
FROM ({_one_row_per('canonical_domain, field_name, field_value', 'page_seq, seq', 'social')})""",
    # crawl logs
    "fetched": f"""
SELECT canonical_domain, page_seq // 60 AS crawl_no, page_seq, url, {page_type(path('url'))} AS page_type,
       CASE WHEN visible_length < 50 THEN 'browser' ELSE 'http' END AS fetched_via,
       CAST(CASE WHEN page_seq % 10 <= 4 THEN 200 ELSE CASE page_seq % 10 WHEN 5 THEN 304 WHEN 6 THEN 403 WHEN 7 THEN 429 WHEN 8 THEN 500 END END AS INTEGER) AS code,
       page_seq % 10 <= 5 AS ok, sha256(html) AS content_hash, {earlier} + INTERVAL (page_seq) MINUTE AS fetched_at
FROM (SELECT *, list_sum(list_transform(string_split({sub(sub('markup', TEMPLATE, '<!>'), TAG, chr(1))}, chr(1)), lambda s : length({trim(decode('s', ';?'))}))) AS visible_length FROM page)""",
    "run": f"""
SELECT {stable_id('canonical_domain', 'crawl_no')} AS crawl_run_id, {stable_id('canonical_domain')} AS candidate_id, started_at, completed_at,
       CASE home WHEN 9 THEN 'timeout' WHEN 6 THEN 'blocked' WHEN 7 THEN 'blocked' WHEN 8 THEN 'failed' ELSE CASE WHEN readable THEN 'success' ELSE 'failed' END END AS status,
       code AS http_status_code, CASE WHEN home <= 5 THEN kept ELSE 0 END AS pages_crawled, home <= 5 AND browser AS used_browser,
       CASE WHEN home = 9 THEN 'timeout' WHEN home > 5 THEN 'HTTP ' || code WHEN NOT readable THEN 'no extractable pages' END AS error_message
FROM (SELECT canonical_domain, crawl_no, min(fetched_at) AS started_at, max(fetched_at) AS completed_at, min(page_seq) % 10 AS home, arg_min(code, page_seq) FILTER (WHERE TRUE) AS any_code,
             CASE min(page_seq) % 10 WHEN 9 THEN NULL ELSE arg_min(code, page_seq) END AS code,
             count(*) FILTER (WHERE ok) AS kept, bool_or(ok AND fetched_via = 'browser') AS browser, bool_or(page_seq % 10 <= 4) AS readable FROM fetched GROUP BY ALL)""",
    "cache_old": f"""
SELECT url, content_hash, CAST(200 AS INTEGER) AS status_code, etag, {nothing['VARCHAR']} AS last_modified, {earlier} AS fetched_at FROM ({_one_row_per('url', 'page_seq DESC', '''(
  SELECT page_seq, url, CASE WHEN page_seq % 5 = 0 THEN 'old-' || sha256(html) ELSE sha256(html) END AS content_hash,
         CASE WHEN page_seq % 2 = 0 THEN 'etag-' || page_seq END AS etag FROM sig WHERE page_seq % 3 <> 0)''')})""",
    "crawl_page": f"SELECT {stable_id('canonical_domain', 'crawl_no')} AS crawl_run_id, url, page_type, fetched_via, code AS http_status_code, fetched_at FROM fetched WHERE ok",
    # robots
    "robots": """
SELECT canonical_domain, seq, allow, path FROM (SELECT canonical_domain, unnest([
  {'seq': 0, 'allow': length(canonical_domain) % 2 = 1, 'path': '/blog/'}, {'seq': 1, 'allow': TRUE, 'path': '/collections/all'},
  {'seq': 2, 'allow': FALSE, 'path': '/collections'}, {'seq': 3, 'allow': FALSE, 'path': '/en/4'}], recursive := true) FROM domains)""",
    # What the files of ROBOTS_FILES say to this crawler, read by hand: line numbers, rules and paths.
    "file_rule": """
SELECT canonical_domain, seq, allow, path FROM domains JOIN (VALUES
  (0, 2, FALSE, '/blog/'), (0, 3, TRUE, '/collections/all'), (0, 4, FALSE, '/collections'), (1, 4, FALSE, ''),
  (2, 6, FALSE, '/en/'), (3, 6, TRUE, '/pt'), (3, 7, FALSE, '%2A'), (5, 0, FALSE, '*')) AS r(pick, seq, allow, path)
ON length(canonical_domain) % 7 = pick""",
    "picked": f"""
SELECT canonical_domain, url, page_type, priority, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_domain ORDER BY priority DESC, url) AS rank FROM (
    SELECT canonical_domain, 'https://' || canonical_domain || target AS url, {page_type('target')} AS page_type, {page_priority('target')} AS priority FROM (
      SELECT DISTINCT canonical_domain, CASE
        WHEN regexp_matches(href, '(?i)^(https?:)?//') THEN CASE WHEN {authority('href')} = canonical_domain THEN {path('href')} END
        WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(href, '^([?#]|$)') THEN NULL
        WHEN href LIKE '/%' THEN {path('href')} ELSE '/' || {path('href')} END AS target FROM link) WHERE target NOT IN ('', '/'))) WHERE rank <= 9""",
    # stored tables of two ingests
    "deleted": f"SELECT {stable_id('canonical_domain')} AS id FROM domains WHERE record_order % 6 = 0",
    "first_holder": "SELECT value, arg_min(canonical_domain, record_order) AS holder, min(record_order) AS since FROM record_value JOIN domains USING (canonical_domain) GROUP BY 1",
    "stored_twice": f"""
SELECT {stable_id('h.canonical_domain')} AS own_id, h.canonical_domain, name, city, platform, platform_confidence, duplicate_of,
       coalesce(name, '') <> '' AND n_contacts + n_socials > 0 AS valid,
       CASE WHEN duplicate_of IS NULL THEN 'active' ELSE 'possible_duplicate' END AS merge_status
FROM header h LEFT JOIN (
  SELECT r.canonical_domain, {stable_id('arg_min(f.holder, f.since)')} AS duplicate_of
  FROM record_value r JOIN domains d USING (canonical_domain) JOIN first_holder f ON f.value = r.value AND f.since < d.record_order GROUP BY 1) USING (canonical_domain)""",
    "half_value": "SELECT DISTINCT page_seq % 2 AS half, canonical_domain, field_value AS value FROM norm",
    "half_record": "SELECT page_seq % 2 AS half, canonical_domain, min(page_seq) AS place FROM raw GROUP BY ALL",
    "odd_record": _half_resolved(1, "SELECT NULL AS value, CAST(-1 AS BIGINT) AS place, NULL AS business_id WHERE FALSE"),
    "even_record": _half_resolved(0, f"SELECT value, CAST(-1 AS BIGINT) AS place, {stable_id('canonical_domain')} AS business_id FROM half_value WHERE half = 1"),
    # candidate histories
    "outcome": """
SELECT user_id * 100 + day(ts) AS candidate_id, event_id, ts AS attempted_at,
       CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'blocked' WHEN 'error' THEN 'timeout' ELSE 'failed' END AS outcome FROM events""",
    "trail": f"""
SELECT candidate_id, event_id, attempted_at, outcome, CAST(n AS INTEGER) AS attempt_number, state,
       CASE WHEN state = 'retry' THEN attempted_at + INTERVAL ([2, 8, 32, 120, 480][n]) MINUTE END AS next_attempt_at FROM (
  SELECT *, CASE WHEN outcome IN ('success', 'blocked') THEN outcome WHEN n >= 5 THEN 'abandoned' ELSE 'retry' END AS state FROM (
    SELECT *, row_number() OVER w AS n, coalesce(sum(CASE WHEN outcome IN ('success', 'blocked') THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY attempted_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
    FROM outcome WINDOW w AS (PARTITION BY candidate_id ORDER BY attempted_at, event_id)) WHERE n <= 5 AND ended = 0)""",
    "state": """
SELECT candidate_id, state, CAST(attempt_number - CASE WHEN state = 'success' THEN 1 ELSE 0 END AS INTEGER) AS attempts, attempted_at AS last_attempt_at, next_attempt_at,
       CASE WHEN state <> 'success' THEN outcome END AS failure_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY attempt_number DESC) AS back FROM trail) WHERE back = 1""",
    # verification
    "ctable": f"""
SELECT contact_id, business_id, type, value, source_url, extraction_confidence,
       CASE WHEN type = 'email' THEN CASE length(source_url) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' END END AS verification_status,
       CAST(length(value) % 6 AS INTEGER) AS verification_attempts,
       CASE length(source_url) % 3 WHEN 1 THEN {now} - INTERVAL 1 HOUR WHEN 2 THEN {now} + INTERVAL 1 HOUR END AS next_at
FROM contact_row""",
    "leased": f"SELECT * FROM ctable WHERE type = 'email' AND coalesce(verification_status, 'pending') = 'pending' AND coalesce(next_at, {now}) <= {now}",
    "suppressed": "SELECT DISTINCT field_value AS email FROM norm WHERE field_name = 'email' AND TRY_CAST(regexp_extract(field_value, '([0-9]{1,9})@', 1) AS INTEGER) % 2 = 0",
    "mx": """
SELECT domain, ['mx', 'nxdomain', 'inconclusive', 'unavailable', 'no_answer'][(length(domain) + coalesce(TRY_CAST(regexp_extract(domain, '([0-9]{1,9})', 1) AS INTEGER), 0)) % 5 + 1] AS mx_outcome
FROM (SELECT DISTINCT regexp_extract(field_value, '@(.*)$', 1) AS domain FROM norm WHERE field_name = 'email')""",
    "checked": f"""
SELECT *, CASE WHEN outcome = 'verified' THEN final WHEN outcome = 'exhausted' THEN 'unknown' ELSE verification_status END AS new_status FROM (
  SELECT *, CASE WHEN suppressed THEN 'skipped_suppressed' WHEN final IS NOT NULL THEN 'verified' WHEN verification_attempts + 1 >= 5 THEN 'exhausted' ELSE 'retried' END AS outcome FROM (
    SELECT leased.*, value IN (SELECT email FROM suppressed) AS suppressed,
           CASE mx_outcome WHEN 'mx' THEN 'verified' WHEN 'nxdomain' THEN 'invalid' WHEN 'no_answer' THEN 'invalid' WHEN 'unavailable' THEN NULL ELSE 'unknown' END AS final
    FROM leased LEFT JOIN mx ON domain = regexp_extract(value, '@(.*)$', 1)))""",
    "stored_email": "SELECT c.*, f.state, p.platform, d.canonical_domain FROM ctable c JOIN domains d ON c.business_id = " + stable_id("d.canonical_domain") + " JOIN platform p USING (canonical_domain) LEFT JOIN fields f USING (canonical_domain) WHERE type = 'email' AND verification_status = 'verified'",
    # browsing
    "counts": """
SELECT business_id, """ + ", ".join(
        f"count(*) FILTER (WHERE type = 'email' AND coalesce(verification_status, 'unverified') = {q(s)}) AS emails_{s}"
        for s in ("verified", "invalid", "unknown", "pending", "risky", "unverified")
    ) + """, count(*) FILTER (WHERE type = 'phone') AS phones FROM ctable GROUP BY 1""",
    "overview": """
SELECT m.business_id, canonical_domain, name, platform, merge_status, """ + ", ".join(
        f"coalesce(emails_{s}, 0) AS emails_{s}" for s in ("verified", "invalid", "unknown", "pending", "risky", "unverified")
    ) + """, coalesce(phones, 0) AS phones, coalesce(social_platforms, '') AS social_platforms
FROM merged m LEFT JOIN counts USING (business_id)
LEFT JOIN (SELECT business_id, string_agg(DISTINCT platform, ',' ORDER BY platform) AS social_platforms FROM social_row GROUP BY 1) USING (business_id)""",
}


def assemble(final: str) -> str:
    """``final`` with the subqueries it needs, directly or through others, in front of it."""
    needed: set[str] = set()

    def visit(text):
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+\(*{name}\b|{name}\.\*|FROM {name}\b", text):
                needed.add(name)
                visit(body)

    visit(final)
    head = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in needed)
    return f"WITH {head}\n{final}" if head else final


def _at_most(n: int, order: str, source: str, columns: str) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {order} LIMIT {n}"


_phone_like = r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"


def _distinct_matches(pattern: str, name: str) -> str:
    """First occurrences of a pattern's matches per document, renumbered."""
    return f"""
(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq, m AS {name} FROM (
  SELECT doc_id, m, min(pos) AS pos FROM documents, unnest(regexp_extract_all(text, {q(pattern)})) WITH ORDINALITY AS t(m, pos) GROUP BY ALL))"""


_quality = " UNION ALL ".join(
    [f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for rule, sql in (
        ("unique businesses(business_id)", "SELECT count(*) - count(DISTINCT business_id) FROM known"),
        ("unique businesses(canonical_domain)", "SELECT count(*) - count(DISTINCT canonical_domain) FROM known"),
        ("unique candidates(candidate_id)", "SELECT 0"),
        ("unique candidates(canonical_domain)", "SELECT 0"),
        ("unique social_profiles(business_id, platform, url)", "SELECT 0"),
        ("foreign social_profiles.business_id -> businesses", "SELECT count(DISTINCT business_id) FROM social_row WHERE business_id NOT IN (SELECT business_id FROM known)"),
        ("foreign evidence.business_id -> businesses", "SELECT count(DISTINCT business_id) FROM social_row WHERE business_id NOT IN (SELECT business_id FROM known)"),
        ("foreign candidates.business_id -> businesses", "SELECT count(*) FROM domains WHERE canonical_domain <> '' AND canonical_domain NOT IN (SELECT canonical_domain FROM known)"),
        ("foreign crawl_runs.candidate_id -> candidates", "SELECT count(DISTINCT canonical_domain) FROM fetched WHERE canonical_domain = ''"),
        ("vocabulary candidates.state", "SELECT count(*) FROM domains WHERE canonical_domain <> '' AND length(canonical_domain) % 3 = 0"),
        ("vocabulary social_profiles.platform", "SELECT count(*) FROM social_row WHERE platform = 'youtube'"),
        ("range evidence.confidence", "SELECT count(*) FROM social WHERE field_name = 'x'"),
        ("not null candidates.canonical_domain", "SELECT 0"),
        ("not null social_profiles.url", "SELECT 0"),
        ("not null evidence.field_name", "SELECT 0"),
        ("not null evidence.field_value", "SELECT 0"),
        ("unique contacts(contact_id)", "SELECT count(*) FROM (SELECT contact_id FROM ctable GROUP BY 1 HAVING count(*) > 1)"),
        ("unique contacts(business_id, type, value)", "SELECT count(*) FROM (SELECT business_id, type, value FROM ctable GROUP BY ALL HAVING count(*) > 1)"),
        ("unique crawl_runs(crawl_run_id)", "SELECT count(*) FROM (SELECT crawl_run_id FROM run GROUP BY 1 HAVING count(*) > 1)"),
        ("unique page_cache(url)", "SELECT count(*) FROM (SELECT url FROM cache_old GROUP BY 1 HAVING count(*) > 1)"),
        ("foreign contacts.business_id -> businesses", "SELECT count(DISTINCT business_id) FROM ctable WHERE business_id NOT IN (SELECT business_id FROM known)"),
        ("foreign businesses.duplicate_of_id -> businesses", "SELECT 0"),
        ("foreign crawl_pages.crawl_run_id -> crawl_runs", "SELECT count(DISTINCT crawl_run_id) FROM crawl_page WHERE crawl_run_id NOT IN (SELECT crawl_run_id FROM run)"),
        ("vocabulary businesses.merge_status", "SELECT 0"),
        ("vocabulary contacts.type", "SELECT count(*) FROM ctable WHERE type NOT IN ('email', 'phone')"),
        ("vocabulary contacts.verification_status", "SELECT count(*) FROM ctable WHERE verification_status NOT IN ('pending', 'verified', 'risky', 'invalid', 'unknown')"),
        ("vocabulary crawl_runs.status", "SELECT count(*) FROM run WHERE status NOT IN ('success', 'failed', 'blocked', 'timeout')"),
        ("vocabulary crawl_pages.page_type", "SELECT count(*) FROM crawl_page WHERE page_type NOT IN ('homepage', 'contact', 'about', 'products', 'collection', 'blog', 'privacy', 'other')"),
        ("vocabulary crawl_pages.fetched_via", "SELECT count(*) FROM crawl_page WHERE fetched_via NOT IN ('http', 'browser')"),
        ("range businesses.platform_confidence", "SELECT 0"),
        ("range businesses.match_score", "SELECT 0"),
        ("range contacts.extraction_confidence", "SELECT count(*) FROM ctable WHERE extraction_confidence NOT BETWEEN 0 AND 1"),
        ("not null businesses.canonical_domain", "SELECT count(*) FROM known WHERE coalesce(canonical_domain, '') = ''"),
        ("not null contacts.value", "SELECT count(*) FROM ctable WHERE coalesce(value, '') = ''"),
        ("not null crawl_pages.url", "SELECT count(*) FROM crawl_page WHERE coalesce(url, '') = ''"),
        ("not null page_cache.url", "SELECT count(*) FROM cache_old WHERE coalesce(url, '') = ''"),
    )]
)

_found = f"(SELECT canonical_domain, arg_min(url, page_seq) AS url FROM raw WHERE canonical_domain <> '' GROUP BY 1)"
_retry_order = "next_attempt_at, candidate_id"

FINAL: dict[str, str] = {
    "domain_emails": f"""
SELECT canonical_domain, email, observations, confidence, extraction_method, source_url FROM (
  SELECT canonical_domain, field_value AS email, count(*) OVER p AS observations, confidence, extraction_method, source_url,
         row_number() OVER (PARTITION BY canonical_domain, field_value ORDER BY confidence DESC, page_seq, seq) AS n
  FROM norm WHERE field_name = 'email' WINDOW p AS (PARTITION BY canonical_domain, field_value)) WHERE n = 1""",
    "canonical_domains": f"SELECT page_seq, canonical_domain, {scheme('url')} AS scheme, {scheme('url')} || '://' || canonical_domain || '/' AS seed_url, path, {page_type('path')} AS page_type, {page_priority('path')} AS priority FROM raw",
    "discover_new": f"SELECT {stable_id('canonical_domain')} AS candidate_id, canonical_domain, 'url_import' AS source, 'pending' AS state, CAST(0 AS INTEGER) AS attempts, {scheme('url')} AS scheme FROM {_found} WHERE canonical_domain NOT IN (SELECT canonical_domain FROM known)",
    "url_list_parse": f"""
SELECT source_rank, pos, url FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, pos) AS n FROM (
    SELECT 0 AS source_rank, page_seq AS pos, 'https://' || canonical_domain || '/' AS url FROM raw
    UNION ALL SELECT 1, page_seq, {trim("split_part(url, ',', 1)")} FROM raw)) WHERE n = 1""",
    "import_limited": _at_most(100, "pos", "raw", "page_seq AS pos, url AS raw_url, 'url_import' AS source"),
    "candidate_seeds": f"SELECT {stable_id('canonical_domain')} AS candidate_id, canonical_domain, {scheme('url')} || '://' || canonical_domain || '/' AS seed_url FROM {_found}",
    "candidate_lookup": f"SELECT {stable_id('d.canonical_domain')} AS candidate_id, CASE WHEN k.business_id IS NULL THEN d.canonical_domain END AS canonical_domain, k.business_id IS NULL AS found FROM domains d LEFT JOIN known k USING (canonical_domain)",
    "criteria_dedupe": """
SELECT substr(sha256('{"category": "' || category || '", "keywords": ["' || least(lower(category), 'shop') || '", "' || greatest(lower(category), 'shop') || '"], "limit": 100, "location": "' || location || '", "platform_hint": null, "urls": []}'), 1, 16) AS criteria_hash,
       location, category, count(*) AS requests
FROM (SELECT 'nation-' || c_nationkey AS location, c_mktsegment AS category FROM customer) GROUP BY ALL""",
    "page_links": "SELECT canonical_domain, page_seq, link_seq, href FROM link",
    "select_pages": "SELECT * FROM picked",
    "select_allowed_pages": f"""
SELECT p.* FROM picked p LEFT JOIN (
  SELECT p.canonical_domain, p.url, arg_min(allow, seq) AS allow FROM picked p JOIN robots r ON r.canonical_domain = p.canonical_domain AND starts_with({path('p.url')}, r.path) GROUP BY ALL) a
ON a.canonical_domain = p.canonical_domain AND a.url = p.url WHERE coalesce(allow, TRUE)""",
    "robots_filter": """
SELECT page_seq, p.canonical_domain, url FROM raw p LEFT JOIN (
  SELECT p.page_seq, arg_min(allow, seq) AS allow FROM raw p JOIN robots r ON r.canonical_domain = p.canonical_domain AND starts_with(p.path, r.path) GROUP BY 1) a
USING (page_seq) WHERE coalesce(allow, TRUE)""",
    "thin_pages": f"""
SELECT page_seq, url, CAST(n AS INTEGER) AS visible_length, n < 50 AS is_thin FROM (
  SELECT page_seq, url, list_sum(list_transform(string_split({sub(sub(sub('html', HIDDEN, '<!>'), TEMPLATE, '<!>'), TAG, chr(1))}, chr(1)), lambda s : length({trim(decode('s', ';?'))}))) AS n FROM raw)""",
    "changed_pages": f"""
SELECT s.page_seq, s.url, sha256(html) AS content_hash, {path('s.url')} IN ('', '/') AS is_homepage,
       c.content_hash IS NOT NULL AND c.content_hash = sha256(html) AND {path('s.url')} NOT IN ('', '/') AS from_cache
FROM sig s LEFT JOIN cache_old c USING (url)""",
    "json_ld_fields": f"SELECT {_obs_cols} FROM business WHERE extraction_method = 'json-ld' UNION ALL SELECT {_obs_cols} FROM product",
    "html_meta_fields": f"SELECT {_obs_cols} FROM business WHERE extraction_method <> 'json-ld' UNION ALL SELECT {_obs_cols} FROM generator",
    "business_fields": f"SELECT {_obs_cols} FROM business",
    "product_fields": f"SELECT {_obs_cols} FROM product",
    "contact_observations": f"SELECT {_obs_cols} FROM contact",
    "social_observations": f"SELECT {_obs_cols} FROM social",
    "strict_social_observations": f"SELECT {_obs_cols} FROM strict_social",
    "all_observations": f"SELECT {_obs_cols} FROM obs",
    "document_emails": f"SELECT doc_id, seq, raw_email, {normalize_email('raw_email')} AS email FROM {_distinct_matches(V.TEXT_EMAIL, 'raw_email')}",
    "document_phones": f"SELECT doc_id, seq, raw_phone, {normalize_phone('raw_phone')} AS phone FROM {_distinct_matches(_phone_like, 'raw_phone')}",
    "platform_evidence": f"SELECT {_obs_cols} FROM evidence",
    "platform_by_domain": "SELECT * FROM platform",
    "platform_with_hint": """
SELECT canonical_domain, CASE WHEN hinted THEN 'wordpress' ELSE platform END AS platform, CASE WHEN hinted THEN CAST(0.95 AS DOUBLE) ELSE platform_confidence END AS platform_confidence
FROM (SELECT platform.*, canonical_domain IN (SELECT canonical_domain FROM generator) AS hinted FROM platform)""",
    "winning_evidence": f"SELECT {_obs_cols} FROM platform_rows",
    "best_business_fields": "SELECT * FROM best_field",
    "normalized_contacts": f"SELECT {_obs_cols} FROM norm",
    "normalized_records": "SELECT * FROM header",
    "validate_records": """
SELECT canonical_domain, validation_errors = '' AS is_valid, validation_errors, n_contacts, n_socials, action FROM (
  SELECT *, concat_ws('; ', CASE WHEN coalesce(name, '') = '' THEN 'missing business name' END,
                            CASE WHEN n_contacts = 0 AND n_socials = 0 THEN 'no contacts or social profiles found' END) AS validation_errors
  FROM header JOIN resolved USING (canonical_domain))""",
    "match_pairs": "SELECT * FROM match_pair",
    "best_matches": "SELECT canonical_domain, business_id AS target_business_id, match_score, CASE WHEN match_score = 1 THEN 'auto_merge' ELSE 'flag_possible_duplicate' END AS action FROM match_pair WHERE rank = 1",
    "resolve_entities": "SELECT * FROM resolved",
    "merge_businesses": "SELECT * FROM merged",
    "contacts_upsert": f"""
SELECT contact_id, business_id, type, value, source_url, CAST(0.97 AS DOUBLE) AS extraction_confidence, CAST(0 AS INTEGER) AS verification_attempts, {earlier} AS created_at FROM known_contact
UNION ALL SELECT contact_id, business_id, type, value, source_url, extraction_confidence, 0, {now} FROM contact_row WHERE contact_id NOT IN (SELECT contact_id FROM known_contact)""",
    "socials_upsert": """
SELECT * FROM known_social UNION ALL
SELECT s.* FROM social_row s ANTI JOIN known_social k ON s.business_id = k.business_id AND s.platform = k.platform AND s.url = k.url""",
    "hinted_candidates": f"""
SELECT {stable_id('canonical_domain')} AS candidate_id, canonical_domain, 'directory' AS source,
       CASE WHEN page_seq % 2 = 0 THEN 'Shop ' || page_seq END AS name_hint, CASE WHEN page_seq % 3 = 0 THEN 'given' ELSE {scheme('url')} END AS scheme
FROM ({_one_row_per('canonical_domain', 'page_seq', 'raw')}) WHERE canonical_domain <> '' AND canonical_domain NOT IN (SELECT canonical_domain FROM known)""",
    "claimed_by_policy": f"""
SELECT c.candidate_id, canonical_domain, CASE WHEN open THEN 'pending' ELSE 'crawling' END AS state,
       CASE WHEN NOT open THEN {now} END AS last_attempt_at, NOT open AS claimed
FROM (SELECT {stable_id('canonical_domain')} AS candidate_id, canonical_domain FROM domains WHERE canonical_domain <> '') c
JOIN (SELECT candidate_id, coalesce(arg_max_null(http_status_code, started_at) IN (403, 429), FALSE) AS open FROM run GROUP BY 1) r USING (candidate_id)""",
    "verification_batch": "SELECT contact_id, value AS email FROM leased ORDER BY contact_id LIMIT 50",
    "platform_overview": "SELECT * FROM overview WHERE platform = 'wordpress' AND merge_status <> 'possible_duplicate'",
    "evidence_log": f"""
SELECT {stable_id('canonical_domain')} AS business_id, field_name, field_value, source_url, extraction_method, confidence, {now} AS observed_at FROM (
  SELECT {_obs_cols} FROM norm UNION ALL SELECT {_obs_cols} FROM social UNION ALL SELECT {_obs_cols} FROM platform_rows)""",
    "finished_candidates": f"""
SELECT {stable_id('canonical_domain')} AS candidate_id, canonical_domain, 'success' AS state, CAST(0 AS INTEGER) AS attempts, CASE WHEN action = 'auto_merge' THEN target_business_id ELSE business_id END AS business_id, {now} AS updated_at FROM resolved""",
    "crawl_run_summary": "SELECT * FROM run",
    "crawl_page_log": "SELECT * FROM crawl_page",
    "page_cache_upsert": f"""
SELECT coalesce(n.url, o.url) AS url, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.code, o.status_code) AS status_code, etag, last_modified, coalesce(n.fetched_at, o.fetched_at) AS fetched_at
FROM ({_one_row_per('url', 'fetched_at DESC, page_seq DESC', 'fetched WHERE ok')}) n FULL JOIN cache_old o ON n.url = o.url""",
    "cached_pages_by_domain": """
SELECT DISTINCT f.canonical_domain, f.url, c.content_hash, etag, last_modified FROM fetched f JOIN cache_old c ON c.url = f.url WHERE ok""",
    "domain_policy": f"""
SELECT canonical_domain, CAST(0 AS INTEGER) AS consecutive_failures, http_status_code AS last_status_code, {nothing['TIMESTAMP']} AS last_attempt_at, coalesce(http_status_code IN (403, 429), FALSE) AS circuit_open
FROM domains LEFT JOIN (SELECT * FROM (SELECT candidate_id, http_status_code, row_number() OVER (PARTITION BY candidate_id ORDER BY started_at DESC, crawl_run_id DESC) AS n FROM run) WHERE n = 1) r ON r.candidate_id = {stable_id('canonical_domain')}""",
    "candidate_transitions": "SELECT * FROM trail",
    "candidate_states": "SELECT * FROM state",
    "claimable_candidates": f"""
SELECT candidate_id, CASE WHEN claimed THEN 'crawling' ELSE now_state END AS state, CASE WHEN claimed THEN TIMESTAMP '{LATE_JANUARY}' ELSE last_attempt_at END AS last_attempt_at, claimed FROM (
  SELECT *, now_state IN ('pending', 'retry') OR (now_state = 'crawling' AND last_attempt_at < TIMESTAMP '{LATE_JANUARY}' - INTERVAL 30 MINUTE) AS claimed FROM (
    SELECT *, CASE WHEN candidate_id % 5 < 2 THEN 'crawling' ELSE state END AS now_state FROM state))""",
    "routed_outcomes": f"""
SELECT candidate_id, CASE kind WHEN 0 THEN 'success' WHEN 1 THEN 'abandoned' WHEN 2 THEN 'blocked' WHEN 5 THEN state ELSE CASE WHEN attempts >= 4 THEN 'abandoned' ELSE 'retry' END END AS state,
       CAST(CASE WHEN kind IN (0, 5) THEN attempts ELSE attempts + 1 END AS INTEGER) AS attempts, last_attempt_at,
       CASE WHEN kind IN (0, 5) THEN next_attempt_at WHEN kind IN (3, 4) AND attempts < 4 THEN {now} + INTERVAL ([2, 8, 32, 120, 480][attempts + 1]) MINUTE END AS next_attempt_at,
       CASE kind WHEN 1 THEN 'duplicate_domain' WHEN 2 THEN 'blocked' WHEN 3 THEN 'timeout' WHEN 4 THEN 'no extractable pages' ELSE failure_reason END AS failure_reason
FROM (SELECT *, (candidate_id // 100) % 6 AS kind FROM state)""",
    "retry_due": f"SELECT candidate_id, next_attempt_at FROM state WHERE state = 'retry' AND next_attempt_at <= TIMESTAMP '{LATE_JANUARY}'",
    "retry_batch": _at_most(100, _retry_order, "state WHERE state = 'retry' AND next_attempt_at <= " + now, "candidate_id, next_attempt_at"),
    "verification_due": f"SELECT contact_id, value AS email, verification_attempts, {now} + INTERVAL 15 MINUTE AS next_verification_attempt_at FROM leased",
    "verification_outcome": f"""
SELECT contact_id, value AS email, outcome, new_status AS verification_status, CASE WHEN outcome = 'verified' THEN 'dns-mx-check' END AS verification_provider,
       CASE WHEN outcome = 'verified' THEN {now} END AS verified_at, CAST(verification_attempts + CASE WHEN suppressed THEN 0 ELSE 1 END AS INTEGER) AS verification_attempts,
       CASE WHEN NOT suppressed THEN {now} END AS last_verification_attempt_at,
       CASE outcome WHEN 'exhausted' THEN NULL WHEN 'retried' THEN {now} + INTERVAL ([5, 30, 120, 720, 2880][verification_attempts + 1]) MINUTE ELSE {now} + INTERVAL 15 MINUTE END AS next_verification_attempt_at,
       CASE WHEN outcome IN ('retried', 'exhausted') THEN 'provider unavailable' END AS verification_failure_reason FROM checked""",
    "verification_summary": """
SELECT count(*) FILTER (WHERE outcome = 'verified') AS verified, count(*) FILTER (WHERE outcome = 'skipped_suppressed') AS skipped_suppressed,
       count(*) FILTER (WHERE outcome = 'retried') AS retried, count(*) FILTER (WHERE outcome = 'exhausted') AS exhausted,
       count(*) FILTER (WHERE outcome = 'verified' AND final = 'verified') AS status_verified, count(*) FILTER (WHERE outcome = 'verified' AND final = 'invalid') AS status_invalid,
       count(*) FILTER (WHERE outcome = 'verified' AND final = 'unknown') AS status_unknown FROM checked""",
    "contacts_after_verification": """
SELECT c.contact_id, c.business_id, c.type, c.value, CASE WHEN k.contact_id IS NULL THEN c.verification_status ELSE new_status END AS verification_status,
       CAST(c.verification_attempts + CASE WHEN k.contact_id IS NULL OR suppressed THEN 0 ELSE 1 END AS INTEGER) AS verification_attempts FROM ctable c LEFT JOIN checked k USING (contact_id)""",
    "eligible_contacts": "SELECT business_id, contact_id, value AS email, verification_status FROM stored_email WHERE platform = 'shopify' AND state = 'VK'",
    "export_stamped": f"""
SELECT contact_id, type, value, CASE WHEN contact_id IN (SELECT contact_id FROM (SELECT contact_id, value FROM stored_email ORDER BY contact_id LIMIT 500) WHERE value NOT IN (SELECT email FROM suppressed)) THEN {now} END AS last_exported_at FROM ctable""",
    "business_listing": f"""
SELECT business_id, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS item_id, 'business' AS kind, coalesce(nullif(name, ''), '(no name)') AS label, coalesce(nullif(platform, ''), 'unknown platform') AS detail, canonical_domain AS link FROM merged
UNION ALL SELECT business_id, 1, contact_id, type, value, coalesce(nullif(verification_status, ''), 'unverified'), NULL FROM ctable
UNION ALL SELECT business_id, 2, social_id, platform, url, '', CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url END FROM social_row""",
    "business_overview": "SELECT * FROM overview",
    "filtered_overview": "SELECT * FROM overview WHERE (contains(canonical_domain, 'example.com') OR contains(lower(coalesce(name, '')), 'example.com')) AND emails_verified > 0 AND merge_status <> 'possible_duplicate'",
    "paged_list": "SELECT *, (SELECT count(*) FROM overview) AS total FROM ("
    + _at_most(50, "business_id", "overview", "business_id, canonical_domain, name, platform") + ")",
    "published_tables": f"""
SELECT 'businesses' AS name, own_id AS id, {_left('duplicate_of')} AS owner,
       {_detail('canonical_domain', 'name', 'city', 'platform', 'CAST(platform_confidence AS DECIMAL(3,2))', 'merge_status', now)} AS detail
FROM stored_twice WHERE own_id NOT IN (SELECT id FROM deleted)
UNION ALL SELECT 'candidates', own_id, {_left('own_id')}, {_detail('canonical_domain', q('success'), '0')} FROM stored_twice WHERE canonical_domain <> ''
UNION ALL SELECT 'contacts', contact_id, business_id, {_detail('type', 'value', 'source_url', 'CAST(extraction_confidence AS DECIMAL(3,2))')}
FROM contact_row WHERE business_id NOT IN (SELECT id FROM deleted)
UNION ALL SELECT 'social_profiles', social_id, business_id, {_detail('platform', 'url', 'source_url')} FROM social_row WHERE business_id NOT IN (SELECT id FROM deleted)
UNION ALL SELECT 'evidence', NULL, own, detail FROM (
  SELECT {stable_id('canonical_domain')} AS own, {_detail('field_name', 'field_value', 'source_url', 'extraction_method', 'CAST(confidence AS DECIMAL(3,2))')} AS detail
  FROM (SELECT {_obs_cols} FROM norm UNION ALL SELECT {_obs_cols} FROM social UNION ALL SELECT {_obs_cols} FROM platform_rows), range(2))
WHERE own NOT IN (SELECT id FROM deleted)
UNION ALL SELECT 'validated', NULL, duplicate_of, {_detail('canonical_domain', 'valid', "CASE WHEN duplicate_of IS NULL THEN 'create_new' ELSE 'flag_possible_duplicate' END")} FROM stored_twice
UNION ALL SELECT 'validated', NULL, own_id, {_detail('canonical_domain', 'valid', q('auto_merge'))} FROM stored_twice
UNION ALL SELECT 'page_cache', NULL, NULL, {_detail('url', 'sha256(html)', '200')} FROM ({_one_row_per('url', 'page_seq DESC', 'sig')})
UNION ALL SELECT DISTINCT 'contact_values', CAST(NULL AS BIGINT), business_id, value FROM contact_row WHERE business_id NOT IN (SELECT id FROM deleted)""",
    "resolved_in_two_ingests": f"""
SELECT {stable_id('canonical_domain')} AS business_id, canonical_domain,
       CASE WHEN duplicate_of IS NULL THEN 'active' ELSE 'possible_duplicate' END AS merge_status, duplicate_of AS duplicate_of_id
FROM (SELECT canonical_domain, duplicate_of FROM odd_record UNION ALL
      SELECT canonical_domain, duplicate_of FROM even_record WHERE canonical_domain NOT IN (SELECT canonical_domain FROM odd_record))""",
    "reread_pages": f"SELECT page_seq, url FROM page WHERE page_seq % 5 = 0 OR {path('url')} IN ('', '/')",
    "export_file": """
SELECT contact_id, value AS email FROM stored_email WHERE value NOT IN (SELECT email FROM suppressed)""",
    "export_lines": """
SELECT business_id, contact_id, value AS email, verification_status FROM stored_email
WHERE platform = 'shopify' AND value NOT IN (SELECT email FROM suppressed)""",
    "stream_states": "SELECT * FROM state",
    "stream_due": f"SELECT candidate_id, next_attempt_at FROM state WHERE state = 'retry' AND next_attempt_at <= TIMESTAMP '{LATE_JANUARY}'",
    "robots_from_files": "SELECT canonical_domain AS host, seq, allow, path FROM file_rule",
    "pages_allowed_by_files": f"""
SELECT page_seq, p.canonical_domain, url FROM raw p LEFT JOIN (
  SELECT p.page_seq, arg_min(allow OR r.path = '', seq) AS allow FROM raw p JOIN file_rule r
  ON r.canonical_domain = p.canonical_domain AND (r.path = '*' OR starts_with({_escaped('p.path')}, r.path)) GROUP BY 1) a
USING (page_seq) WHERE coalesce(allow, TRUE)""",
    "crawl_pages_by_day": "SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM crawl_page GROUP BY 1",
    "stream_page_cache": f"""
SELECT url, sha256(html) AS content_hash, CAST(200 AS INTEGER) AS status_code, {earlier} AS fetched_at
FROM ({_one_row_per('url', 'page_seq DESC', 'raw')})""",
    "dashboard": """
SELECT count(*) AS total, count(*) FILTER (WHERE emails_verified > 0) AS with_verified_email, count(*) FILTER (WHERE emails_unverified + emails_pending > 0) AS awaiting_verification,
       count(*) FILTER (WHERE emails_verified + emails_invalid + emails_unknown + emails_pending + emails_risky + emails_unverified + phones = 0) AS no_contacts FROM overview""",
    "platform_facets": "SELECT platform, count(*) AS businesses FROM platform GROUP BY 1",
    "known_domains": "SELECT canonical_domain FROM known",
    "batch_status": "SELECT (SELECT count(*) FROM domains) AS total, count(*) FILTER (WHERE name IS NOT NULL) AS success, count(*) FILTER (WHERE name IS NULL) AS failed, (SELECT count(*) FROM domains) - count(*) AS pending FROM known",
    "batch_results": f"SELECT business_id, canonical_domain, name, platform FROM known JOIN {_found} f USING (canonical_domain) WHERE {scheme('f.url')} = 'https'",
    "quality_report": _quality,
    "surviving_contacts": "SELECT contact_id, business_id, type, value FROM ctable WHERE business_id IN (SELECT business_id FROM known)",
    "stream_discover": "SELECT canonical_domain FROM domains WHERE canonical_domain <> ''",
}

ORACLE: dict[str, str] = {name: assemble(sql) for name, sql in FINAL.items()}
ORACLE["stream_pages"] = assemble(f"SELECT {_obs_cols} FROM obs").replace(SIGNAL_HTML, "html")
