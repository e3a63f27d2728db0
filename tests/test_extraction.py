import json

from leadloom.operators import detection, normalization
from leadloom.operators.extraction import observations
from pyspark.sql import functions as F

ORGANIZATION = {
    "telephone": "+1-202-456-1111", "email": "post@fjordboats.example", "@type": ["LocalBusiness", "Store"],
    "sameAs": ["https://www.linkedin.com/company/fjordboats", 5, "https://www.youtube.com/@fjordboats"],
    "address": {"postalCode": "1776", "addressCountry": "NO", "addressRegion": "Viken", "streetAddress": "Brygga 7", "addressLocality": "Halden"},
    "description": "Wooden boats.", "name": " Fjord Boats ",
}


def ld(data):
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


def rows(df, section):
    return [
        (r.field_name, r.field_value, r.extraction_method, r.confidence)
        for r in df.where(F.col("section") == section).orderBy("page_seq", "seq").collect()
    ]


def test_organization(observe):
    found = observe(("https://fjordboats.example/", f"<head>{ld(ORGANIZATION)}</head>"))
    assert rows(found, "business") == [
        (n, v, "json-ld", 0.92) for n, v in (
            ("name", "Fjord Boats"), ("description", "Wooden boats."), ("street_address", "Brygga 7"), ("city", "Halden"),
            ("state", "Viken"), ("country", "NO"), ("postal_code", "1776"))]
    assert rows(found, "contact") == [("email", "post@fjordboats.example", "json-ld", 0.92), ("phone", "+1-202-456-1111", "json-ld", 0.92)]
    assert rows(found, "social") == [
        ("linkedin", "https://www.linkedin.com/company/fjordboats", "json-ld", 0.92), ("youtube", "https://www.youtube.com/@fjordboats", "json-ld", 0.92)]


def test_json_ld_that_is_no_object_or_malformed_is_skipped(observe):
    page = ld("{bad,,") + ld("[]") + ld('"x"') + ld("") + ld('[{"name": 7}, {"name": "  "}, {"name": null}, 3]') + ld({"@graph": [ORGANIZATION]})
    assert observe(("https://a.b/", page), sections=["business", "contact"]).count() == 0


def test_product_type_may_be_a_list_and_also_names_the_business(observe):
    found = observe(("https://a.b/", ld([{"@type": ["Thing", "Product"], "name": "Widget", "category": "Widgets"}])))
    assert rows(found, "product") == [("product_name", "Widget", "json-ld", 0.92), ("category", "Widgets", "json-ld", 0.92)]
    assert rows(found, "business") == [("name", "Widget", "json-ld", 0.92)]


def test_meta_tags_in_any_attribute_order(observe):
    page = """<head><meta content="OG &amp; Co" property="og:title"><META NAME='description' CONTENT=' Described '>
    <meta name="description" content="second"><meta name=generator content="Shopify"><title> Title
    </title></head>"""
    found = observe(("https://a.b/", page))
    assert rows(found, "business") == [
        ("name", "OG & Co", "og-tag", 0.75), ("description", "Described", "meta-tag", 0.55), ("name", "Title", "title-tag", 0.55)]
    assert rows(found, "generator") == [("generator", "Shopify", "meta-tag", 0.55)]


def test_an_empty_first_description_hides_later_ones(observe):
    page = '<meta name="description" content=" "><meta name="description" content="second">'
    assert rows(observe(("https://a.b/", page)), "business") == []


def test_contacts_count_once_per_page_from_their_first_source(observe):
    page = ld({"email": "hi@a.com"}) + """<a href="MAILTO:hi@a.com">x</a><a href="mailto: two@a.com ?subject=s">y</a>
    <a href="tel: +1 202 456 1111 ">z</a><p>hi@a.com two@a.com three@a.com</p>"""
    assert rows(observe(("https://a.com/", page)), "contact") == [
        ("email", "hi@a.com", "json-ld", 0.92), ("email", "two@a.com", "mailto", 0.97),
        ("email", "three@a.com", "regex", 0.6), ("phone", "+1 202 456 1111", "tel", 0.95)]


def test_socials_prefer_same_as_over_links(observe):
    page = ld({"sameAs": "https://instagram.com/a"}) + """<a href="https://instagram.com/a">i</a>
    <a href="https://twitter.com/a">t</a><a href="https://twitter.com/a">t</a><a href="https://blog.example/">b</a>"""
    assert rows(observe(("https://a.b/", page)), "social") == [
        ("instagram", "https://instagram.com/a", "json-ld", 0.92), ("x", "https://twitter.com/a", "link", 0.85)]


def test_the_same_email_on_two_pages_is_observed_twice(observe):
    page = '<a href="mailto:hi@a.com">x</a>'
    found = observe(("https://a.com/", page), ("https://www.a.com/contact", page))
    assert [(r.canonical_domain, r.source_url) for r in found.where("section = 'contact'").orderBy("page_seq").collect()] == [
        ("a.com", "https://a.com/"), ("a.com", "https://www.a.com/contact")]


def test_pages_without_content_are_left_out(spark):
    schema = "page_seq long, url string, raw_html string, from_cache boolean"
    pages = spark.createDataFrame(
        [(0, "https://a.com/", "<title>x</title>", True), (1, "https://a.com/1", "", False), (2, "https://a.com/2", None, False)], schema)
    assert observations(pages).count() == 0


def test_one_pass_matches_the_separate_passes(spark, observe):
    pages = [("https://a.com/", '<script src="https://cdn.shopify.com/x"></script><link href="wp-content/x">'), ("https://b.com/", "<p>x")]
    together = observe(*pages)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_seq long, url string, raw_html string")
    alone = detection.platform_evidence(df)
    assert sorted(together.where("section = 'platform'").collect()) == sorted(alone.collect()) != []
    assert together.where("section = 'page'").count() == 2


def test_platform_is_the_strongest_signal(spark, observe):
    found = observe(
        ("https://a.com/", "cdn.shopify.com and wp-content/"), ("https://b.com/", '<meta name="generator" content="WordPress 6">'),
        ("https://c.com/", "plain"), ("https://d.com/", "wp-content/plugins/woocommerce/ <meta name='generator' content='WordPress 6'>"))
    domains = found.where("section = 'page'").select("canonical_domain")
    evidence = found.where("section = 'platform'")
    chosen = detection.platform_by_domain(domains, evidence)
    assert {r.canonical_domain: (r.platform, r.platform_confidence) for r in chosen.collect()} == {
        "a.com": ("shopify", 0.97), "b.com": ("wordpress", 0.95), "c.com": ("unknown", 0.0), "d.com": ("woocommerce", 0.95)}
    won = detection.winning_evidence(evidence, chosen)
    assert {(r.canonical_domain, r.extraction_method) for r in won.collect()} == {
        ("a.com", "shopify-cdn-asset"), ("b.com", "wordpress-generator-tag"), ("d.com", "woocommerce-plugin-path"),
        ("d.com", "woocommerce-asset-reference")}


def test_a_generator_hint_decides_alone(observe):
    found = observe(("https://a.com/", '<meta name="generator" content="Shopify"> static.wixstatic.com'))
    hints = detection.generator_hints(found)
    domains, evidence = found.where("section = 'page'"), found.where("section = 'platform'")
    chosen = detection.platform_by_domain(domains, evidence, hints)
    assert [(r.platform, r.platform_confidence) for r in chosen.collect()] == [("shopify", 0.95)]
    assert [r.extraction_method for r in detection.winning_evidence(evidence, chosen, hints).collect()] == ["generator-meta-tag"]


def test_best_field_is_the_most_confident_then_the_first(observe):
    found = observe(
        ("https://a.com/", "<title>Low</title>" + ld({"name": "High"})), ("https://a.com/2", ld({"name": "Later"})))
    assert [(r.field_value, r.confidence) for r in normalization.best_fields(found).collect()] == [("High", 0.92)]


def test_contacts_normalize_or_drop_and_keep_provenance(observe):
    page = '<a href="mailto:Hello@Example.COM">x</a><a href="mailto:bad">y</a><a href="tel:(202) 456-1111">t</a><a href="tel:123">u</a>'
    kept = normalization.normalized_contacts(observe(("https://a.com/", page))).orderBy("seq").collect()
    assert [(r.field_value, r.source_url, r.extraction_method) for r in kept] == [
        ("hello@example.com", "https://a.com/", "mailto"), ("+12024561111", "https://a.com/", "tel")]


def test_extraction_neither_shuffles_nor_calls_python(spark, tmp_path):
    spark.range(3).selectExpr("id AS page_id", "'https://a.com/' AS url", "'<p>' AS html").write.parquet(str(tmp_path / "p"))
    from leadloom import session
    from leadloom.sources.files import read_pages

    before, session.SMALL_INPUT_BYTES = session.SMALL_INPUT_BYTES, 0
    try:
        plan = observations(read_pages(spark, str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    finally:
        session.SMALL_INPUT_BYTES = before
    assert "Exchange" not in plan and "Python" not in plan
