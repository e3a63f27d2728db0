import re
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import contacts, html, ids, timing, urls


@pytest.fixture
def value(spark):
    def run(column, *inputs):
        df = spark.createDataFrame([(x,) for x in inputs], "v string")
        return [r[0] for r in df.select(column(F.col("v"))).collect()]

    return run


def test_domain_spellings(value):
    inputs = ("https://Example.com/", "http://www.example.com", "example.com", "WWW.a.b:80/x", "u:p@h.org/?q#f")
    assert value(urls.canonical_domain, *inputs) == ["example.com", "example.com", "example.com", "a.b:80", "u:p@h.org"]
    assert value(urls.canonical_domain, "/a?u=http://x", "") == ["", ""]


def test_scheme_defaults_to_https(value):
    assert value(urls.scheme, "HTTP://a.b", "a.b", "https://a.b") == ["http", "https", "https"]


def test_links_resolve_inside_the_site(value):
    def resolve(c):
        return urls.resolve_link(F.lit("https"), F.lit("d.com"), c)

    cases = {
        "/a/../b": "https://d.com/b", "a//b/./c": "https://d.com/a/b/c", "../x": "https://d.com/x",
        "//d.com/p?q": "https://d.com/p", "https://d.com/x;p=1": "https://d.com/x", "HTTP://d.com/q/": "https://d.com/q/",
        "/x/;y/z;w": "https://d.com/x/;y/z", " a/ ": "https://d.com/a/", "a/..": None, "/": None, "#x": None, "?q": None,
        "https://e.com/z": None, "mailto:a@b.com": None, "javascript:void(0)": None, "https://sub.d.com/z": None,
    }
    assert dict(zip(cases, value(resolve, *cases))) == cases


def test_page_types_and_priorities(value):
    paths = ("/contact-us/", "/ABOUT", "/products/x", "/category", "/categories/x", "/news", "/terms-of-use", "/x", "/")
    assert value(urls.page_type, *paths) == [
        "contact", "about", "products", "other", "collection", "blog", "privacy", "other", "other"]
    assert value(urls.page_priority, *paths) == [0.95, 0.9, 0.85, 0.1, 0.8, 0.3, 0.1, 0.1, 1.0]


def test_social_platform_is_a_substring_unless_strict(value):
    links = ("https://twitter.com/a", "https://netflix.com/z", "https://m.facebook.com/a", "https://a.com")
    assert value(urls.social_platform, *links) == ["x", "x", "facebook", None]
    assert value(lambda c: urls.social_platform(c, strict=True), *links) == ["x", None, "facebook", None]


def test_discovery_metadata_keeps_given_keys(spark):
    df = spark.createDataFrame([({"scheme": "ftp", "rank": "1"}, "Shop", "http://a.b")], "m map<string,string>, n string, u string")
    made = df.select(urls.discovery_metadata(F.col("m"), F.col("n"), F.col("u"))).first()[0]
    assert made == {"scheme": "ftp", "rank": "1", "name_hint": "Shop"}


def test_safe_link(value):
    assert value(urls.safe_link, "https://a.b", "javascript:x") == ["https://a.b", None]


def test_emails(value):
    cases = {
        "Hello@Example.COM": "hello@example.com", "not-an-email": None, "a..b@c.com": None, ".a@b.com": None,
        "a@b.test": None, "x@-a.com": None, "a@b": None, "a" * 64 + "@b.com": "a" * 64 + "@b.com", "a" * 65 + "@b.com": None,
        "a@" + "b." * 130 + "com": None, "o'neil+x@a-b.co.uk": "o'neil+x@a-b.co.uk",
    }
    assert dict(zip(cases, value(contacts.normalize_email, *cases))) == cases


def test_phones(value):
    cases = {
        "(202) 456-1111": "+12024561111", "123": None, "+1 202 456 1200": "+12024561200", "1-800-FLOWERS": "+18003569377",
        "tel 202.456.1111 ext 5": "+12024561111", "+44 20 7946 0958": "+442079460958", "011 44 20 7946 0958": "+442079460958",
        "555 555 5555": None, "+999 12345678": None, "202-456-11112": None, "": None,
    }
    assert dict(zip(cases, value(contacts.normalize_phone, *cases))) == cases
    assert value(lambda c: contacts.normalize_phone(c, ["202"]), "202 456 1111", "303 456 1111") == ["+12024561111", None]


def test_entities(value):
    assert value(html.decode_entities, "a&#39;b&#x41;&lt;&apos;&amp;lt; &#128512 q&amp", "&#0;") == ["a'bA<'&lt; \U0001F600 q&", "�"]
    assert value(lambda c: html.decode_entities(c, legacy=False), "?a=1&lt=2&amp;b") == ["?a=1&lt=2&b"]


def test_links_ignore_comments_and_scripts(value):
    page = """<!-- <a href="no"> --><script>"<a href='no'>"</script><a class='b' title="x > y" href="/1">q</a><A HREF=/2?a=1&amp;b=2>"""
    assert value(lambda c: html.links(html.tags(html.visible_markup(c), "a")), page) == [["/1", "/2?a=1&b=2"]]


def test_nothing_inside_a_value_is_a_tag(value):
    cases = {
        """<div title="<a href='/x'>">d</div><a href="/y">""": ["/y"], """<a title='<a href="/x">' href="/y">""": ["/y"],
        """<p data-x=">"><a href=/y/ ><abbr href="/x"><area href="/x">""": ["/y/"], """<a href="/y"<a href="/z">""": ["/y"],
        """a < b <a href="/y"> c > d""": ["/y"], """<a href="/never closed""": ["/never closed"], """<a href='a"b' href=/x>""": ['a"b'],
        """<a\nHREF\n=\n"/y"\n>""": ["/y"], "<a href>": [], """</p title="<a href='/x'>"><a href="/y">""": ["/y"],
    }
    assert value(lambda c: html.links(html.tags(c, "a")), *cases) == list(cases.values())


def test_many_tags_in_linear_time(value):
    import time

    start = time.perf_counter()
    got = value(lambda c: F.size(html.links(html.tags(c, "a"))), '<i x="1"><a href="/y">' * 100_000, '<a "=<' * 100_000, "<a x='" * 100_000)
    assert got[0] == 100_000 and time.perf_counter() - start < 60


def test_visible_text_and_length(value):
    page = "<title> T&amp; </title><script>x</script><p> a <b>b</b>\n</p><!-- c --><i data-x='>'>d"
    assert value(lambda c: html.visible_length(html.visible_markup(c)), page) == [len("T&") + 3]
    assert value(lambda c: html.visible_text(html.visible_markup(c)), page)[0].split() == ["T&", "a", "b", "d"]


def test_text_emails_restart_after_a_match(value):
    assert value(html.text_emails, "me@a.com@c.org me2@b.com_z@q.org", "none", "@x.com") == [
        ["me@a.com", "me2@b.com", "_z@q.org"], [], []]


def test_long_broken_texts_stay_linear(value):
    run = "x" * 400_000
    assert value(html.text_emails, run + "@" + run, run + " a@b.com") == [[], ["a@b.com"]]
    assert value(lambda c: html.visible_length(html.visible_markup(c)), "<p " + "a='b' " * 50_000, " " * 400_000) == [0, 0]
    assert value(lambda c: html.links(html.tags(html.visible_markup(c), "a")), "<a x='" + "\"'" * 100_000) == [[]]


def test_backoff_is_clamped(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    attempts = spark.createDataFrame([(n,) for n in (0, 1, 3, 5, 9)], "n int")
    minutes = [(r[0] - datetime(2024, 1, 1)).total_seconds() / 60
               for r in attempts.select(timing.candidate_retry_at(now, F.col("n"))).collect()]
    assert minutes == [2, 2, 32, 480, 480]
    minutes = [(r[0] - datetime(2024, 1, 1)).total_seconds() / 60
               for r in attempts.select(timing.verification_retry_at(now, F.col("n"))).collect()]
    assert minutes == [5, 5, 120, 2880, 2880]


def test_ids_depend_on_the_key_alone(value):
    a, b, again = value(ids.stable_id, "a", "b", "a")
    assert a == again != b and 0 <= a < 2**63


def test_attributes_are_read_in_order_and_whole(value):
    cases = {
        '<a title="see href=foo now" href="/real">': ["/real"], '<a class="x"href="/tight">': ["/tight"], "<a/href='/slash'>": ["/slash"],
        "<a " + 'data-x="v" ' * 70 + 'href="/contact">': ["/contact"], '<template><a href="/t">x</a></template>': ["/t"],
        "<a HREF = /q?x=1 class=y>": ["/q?x=1"], "<a href><a href=''>": [], '<a href="/caf&eacute;&amp;b">': ["/café&b"],
    }
    assert value(lambda c: html.links(html.tags(html.visible_markup(c), "a")), *cases) == list(cases.values())


def test_references_decode_as_the_standard_library_does(value):
    import html as standard

    texts = ["Caf&eacute; &rsquo;&ndash;&copy; &#0000000066; &#x41;&#xD800; &#99999999; &#150;", "&notit; &not x &amp;lt; a&b &bogus; &",
             "&#0; &AMP; &ngE; &hellip;&lt", "&", "", "&&amp;&#38;amp;"]
    assert value(html.decode_entities, *texts) == [standard.unescape(t) for t in texts]
    many = "".join(f"&#{i + 200};x" for i in range(20_000))
    assert value(html.decode_entities, many) == [standard.unescape(many)]


def test_addresses_of_any_script_and_reserved_names(value):
    cases = {"a@b.xn--p1ai": "a@b.\u0440\u0444", "user@m\u00fcnchen.de": "user@m\u00fcnchen.de", "J\u00f6rg@Firma.de": "j\u00f6rg@firma.de",
             "x@foo.onion": None, "x@foo.local": None, "a..b@c.com": None}
    assert value(contacts.normalize_email, *cases) == list(cases.values())


def test_host_names_are_decoded_and_marks_composed(value):
    hosts = ["m\u00fcnchen.de", "b\u00fccher.example.com", "\u4f8b\u3048.jp", "\u0645\u062b\u0627\u0644.com", "stra\u00dfe-am-see.de", "\u03b5\u03bb\u03bb\u03ac\u03b4\u03b1.gr",
             "\ud55c\uad6d\uc5b4-\ub3c4\uba54\uc778.kr", "\u00e4\u00f6\u00fc\u00e4\u00f6\u00fc-x.org", "\u0bb5\u0ba3\u0b95\u0bcd\u0b95\u0bae\u0bcd.com", "a\U0001F642b.com"]
    encode = lambda host: ".".join(f"xn--{x.encode('punycode').decode()}" if not x.isascii() else x for x in host.split("."))
    assert value(contacts.canonical_address, *[f"x@{encode(h)}" for h in hosts]) == [f"x@{h}" for h in hosts]
    marks = ["mu\u0308nchen", "e\u0301te\u0301", "o\u0308\u0304x", "\u0301a", "\u0438\u0306", "plain", "q\u0301"]
    assert value(contacts.compose, *marks) == [unicodedata.normalize("NFC", m) for m in marks]
    forms = ["User@xn--mnchen-3ya.de", "user@M\u00fcnchen.de", "user@mu\u0308nchen.de"]
    assert value(contacts.normalize_email, *forms) == ["user@m\u00fcnchen.de"] * 3
    odd = ["x@xn--.com", "x@xn--a-.com", "x@xn--99999999999999.com", "x@a.xn--0.com"]
    assert value(contacts.canonical_address, *odd) == odd


def test_numbers_that_exist_nowhere(value):
    cases = {
        "222 456 1111": None, "200 456 1111": None, "370 456 1111": None, "800 456 1111": "+18004561111", "212 456 1111": "+12124561111",
        "+1 230 555 1234": None, "237-555-1234": None, "+33 000000000": None, "+33 1 42 68 53 00": "+33142685300", "+33 142 685": None,
        "+1 416 555 0199": "+14165550199", "+49 30 901820": "+4930901820", "+39 06 6982": "+39066982", "+47 22 86 55": None,
        "+354 570 7200": "+3545707200", "+81 3-3224-5000": "+81332245000", "+210 123456789": None, "+48 22 123 45 67": "+48221234567",
        "+48 022 123 45 67": None, "+7 495 123-45-67": "+74951234567", "+7 195 123-45-67": None, "+883 " + "5" * 16: None,
    }
    assert dict(zip(cases, value(contacts.normalize_phone, *cases))) == cases


def test_tables_of_numbers():
    codes = [code for own in V.AREA_CODES.values() for code in own.split()]
    assert len(codes) == len(set(codes)) and all(re.fullmatch("[2-9][0-8][0-9]", code) for code in codes)
    calling = [line.split()[0] for line in V.NATIONAL_NUMBERS.strip().splitlines()]
    assert calling == sorted(calling, key=lambda c: (len(c), c)) and len(calling) == len(set(calling))
    assert not any(a != b and b.startswith(a) for a in calling for b in calling)  # no code begins another


def test_repeated_json_keys_keep_the_last_value(value):
    from leadloom.functions import json_ld

    fields = value(lambda c: json_ld.fields(json_ld.entries(F.array(c))), '{"name":"A","name":"B","email":"x@a.com"}')[0]
    assert [(f.field_name, f.field_value) for f in fields] == [("name", "B"), ("email", "x@a.com")]
