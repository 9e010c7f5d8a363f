"""Addresses, links and retail variants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaylens.operators import addresses as ad
from quaylens.operators.product_links import product_links

HOSTS = ("shop.example.com", "www.shop.example.com")
ROOT = "https://www.shop.example.com"


def test_store_addresses(spark):  # noqa: ANN001
    cases = {
        f"{ROOT}/en/p/AB12#top": f"{ROOT}/en/p/AB12",
        "HTTPS://WWW.Shop.Example.com:443/En?q=1": f"{ROOT}/En?q=1",
        "https://shop.example.com": "https://shop.example.com/",
        "//shop.example.com/a": "https://shop.example.com/a",
        "/a/b": f"{ROOT}/a/b",
        "a": f"{ROOT}/a",
        "http://shop.example.com/a": None,
        "https://shop.example.com:8443/a": None,
        "https://user@shop.example.com/a": None,
        "https://shop.example.com.evil.example/a": None,
        "https://shop.example.com/a%2Fb": None,
        "https://shop.example.com/a\nb": None,
        "javascript:alert(1)": None,
        "  ": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    for r in df.withColumn("got", ad.store_address(F.col("a"), HOSTS)).collect():
        assert r.got == r.b, r.a


def test_sku_hints(spark):  # noqa: ANN001
    cases = [("/en/p/AB12/x", "ab12", True), ("/en/P/ab%31%32", "AB12", True), ("/AB12", "AB12", False), ("/en/x/AB12", "AB12", False), ("/p/AB12", "AB1", False), ("/p/AB1", "AB1", False), ("/p/AB12/%zz", "AB12", False), ("/p/AB12", None, False), ("", "AB12", False)]
    df = spark.createDataFrame(cases, "path string, sku string, ok boolean")
    for r in df.withColumn("got", ad.names_sku(F.concat(F.lit(ROOT), "path"), F.col("sku"))).collect():
        assert r.got == r.ok, (r.path, r.sku)


def followed(answers, address, sku, most):  # noqa: ANN001, ANN201
    """The rule step by step, for addresses in their one form."""
    seen = []
    for hop in range(most + 1):
        if address in seen:
            return "REDIRECT_LOOP", None
        seen.append(address)
        if f"/p/{sku}".lower() not in address.lower():
            return "SKU_HINT_MISMATCH", None
        code, to, code2, to2 = answers.get(address, (None,) * 4)
        if code in ad.HEAD_REFUSED:
            code, to = code2, to2
        if code is None:
            return "RETRYABLE_ERROR", None
        if code in ad.REDIRECTS:
            if not to or not to.startswith("/"):
                return "UNSAFE_REDIRECT", None
            if hop == most:
                return "REDIRECT_LIMIT", None
            address = ROOT + to
        else:
            return ("OK", address) if code == 200 else ("NOT_FOUND" if code in ad.GONE else "RETRYABLE_ERROR" if code in ad.RETRYABLE else "REJECTED", None)
    return None


@pytest.mark.parametrize("most", [0, 1, 3, 9])
def test_links_are_followed(spark, most):  # noqa: ANN001
    to = lambda i: f"/p/SKU1/{i}"
    answers = {ROOT + to(i): (301, to(i + 1), None, None) for i in range(6)}
    answers |= {ROOT + to(6): (200, None, None, None), ROOT + to(10): (302, to(11), None, None), ROOT + to(11): (307, to(10), None, None), ROOT + to(12): (405, None, 308, to(6)), ROOT + to(13): (403, None, 403, None)}
    answers |= {ROOT + to(14): (301, "http://x.example.com/p/SKU1", None, None), ROOT + to(15): (301, "/p/OTHER", None, None), ROOT + to(16): (429, None, None, None), ROOT + to(17): (410, None, None, None), ROOT + to(18): (301, None, None, None)}
    links = [(i, ROOT + to(i), "SKU1", "kept") for i in range(20)] + [(50, None, "SKU1", "kept"), (51, ROOT + to(6), None, "kept"), (6, ROOT + to(6), "SKU1", "kept")]
    got = ad.link_health(spark.createDataFrame(links, "id int, address string, sku string, code string"), spark.createDataFrame([(a, *v) for a, v in answers.items()] * 2, ad.ANSWERS), HOSTS, most)
    assert got.columns == ["id", "address", "sku", "code", "link_status", "final_url"]
    expected = [(i, *(("INVALID_URL", None) if a is None else ("SKU_HINT_MISMATCH", None) if s is None else followed(answers, a, s, min(most, 5)))) for i, a, s, _ in links]
    assert sorted((r.id, r.link_status, r.final_url) for r in got.collect()) == sorted(expected)


def test_first_healthy_address(spark):  # noqa: ANN001
    answers = spark.createDataFrame([(f"{ROOT}/p/SKU1", 404, None, None, None), (f"{ROOT}/p/SKU1/x", 200, None, None, None)], ad.ANSWERS)
    rows = spark.createDataFrame([(1, "SKU1", "/p/SKU1", "/p/SKU1/x"), (2, "SKU1", None, ""), (3, None, "/p/SKU1/x", None)], "id int, sku string, a string, b string")
    got = {r.id: r.resolved_url for r in ad.first_healthy(rows, answers, HOSTS, "id", ["a", "b"]).collect()}
    assert got == {1: f"{ROOT}/p/SKU1/x", 2: None, 3: None}
    assert ad.first_healthy(rows.limit(0), answers.limit(0), HOSTS, "id", ["a"]).count() == 0


LINE = ad.VariantLine("Superlux", "HD-662", ("hd", "662"), ("F", "B"), "www.shop.example.de", ("/de/superlux_hd662", ".htm"))
PAGE = "https://www.shop.example.de/de/superlux_hd662"


@pytest.mark.parametrize(
    ("title", "address", "variant"),
    [
        ("Superlux HD-662", f"{PAGE}.htm", "BASE"),
        ("superlux hd 662 f", f"{PAGE}_F.htm?x=1", "F"),
        ("Superlux HD662B", f"{PAGE}_b.htm", "B"),
        ("Superlux HD-662 F", f"{PAGE}.htm", None),
        ("Superlux HD-662 Evo", f"{PAGE}.htm", None),
        ("Superlux HD-662 B-Stock", f"{PAGE}_b.htm", None),
        ("Superlux HD-662", f"{PAGE}_evo.htm", None),
        ("Superlux HD-662", "http://www.shop.example.de/de/superlux_hd662.htm", None),
        (None, f"{PAGE}.htm", None),
        ("Superlux HD-662", None, None),
    ],
)
def test_variants(spark, title, address, variant):  # noqa: ANN001
    df = spark.createDataFrame([(title, address)], "t string, a string")
    t, a = F.col("t"), F.col("a")
    r = df.select(LINE.variant(t, a).alias("v"), LINE.identity(t, a).alias("i"), LINE.fits("HD-662", t, a).alias("base"), LINE.fits("headphones", t, a).alias("any"), LINE.fits("hd-662 evo", t, a).alias("other")).first()
    assert (r.v, r.i is not None, r.base, r.other) == (variant, variant is not None, variant == "BASE", False)
    ours = address is not None and address.startswith(PAGE) and "evo" not in address
    assert r.any == (variant is not None if ours else True)


def test_variants_asked():
    asked = {"superlux hd-662": "BASE", "HD 662 F": "F", "hd662b cable": "B", "hd-662 evo": "UNSUPPORTED", "hd-662 mk 2": "UNSUPPORTED", "hd-6620": None, "": None, "hd_662_f": "F"}
    assert {q: LINE.asked(q) for q in asked} == asked


def test_links_to_products(spark):  # noqa: ANN001
    html = """<a class=x href="/p/red-widget?c=1&amp;d=2"><b>Red</b> widget</a><a href='/p/red-widget?c=1&amp;d=2'>again</a><a href="/p/blue">x</a><a href="p/widget">near</a>
    <a href="/about">red widget</a><a href="/p/red-widget.png">i</a><a href="https://else.example.com/p/red-widget">o</a><a href="mailto:red-widget@x">m</a>
    <script>{"productUrl": "p/widget-5", "x": "https:\\/\\/shop.example.com\\/p\\/widget-6", "y": "\\u002Fp\\u002Fred-7"}</script><i data='{&quot;url&quot;:&quot;/p/widget-8&quot;}'>"""
    pages = spark.createDataFrame([(1, "https://shop.example.com/find/all?q=1", html, 5), (2, "https://shop.example.com/", None, 5), (3, "not an address", html, 5)], "page_id int, url string, html string, place int")
    got = [(r.place, r.link, r.label, r.score) for r in product_links(pages, "Red widget", "/p/").orderBy("page_id", "place").collect()]
    base = "https://shop.example.com"
    assert got[0] == (1, f"{base}/p/red-widget?c=1&d=2", "Red widget", 1.0)
    assert {(link, score) for _, link, _, score in got[1:]} == {(f"{base}/find/p/widget", 0.5), (f"{base}/p/widget-5", 0.5), (f"{base}/p/widget-6", 0.5), (f"{base}/p/red-7", 0.5), (f"{base}/p/widget-8", 0.5)}
    assert [p for p, *_ in got] == list(range(1, 7))
    assert product_links(pages, "", "/p/", 2).count() == 2
    assert product_links(pages.limit(0), "red", "/p/").count() == 0


def test_answers_are_never_sent_whole_to_each_task(spark):  # noqa: ANN001
    links = spark.range(20).selectExpr("id", "case when id % 4 > 0 then concat('https://shop.example.com/p/SKU', id) end AS address", "concat('SKU', id) AS sku")
    answers = links.selectExpr("address", "200 AS head_status", "cast(null AS string) AS head_location", "cast(null AS int) AS get_status", "cast(null AS string) AS get_location")
    out = ad.link_health(links, answers, ("shop.example.com",))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.link_status: r["count"] for r in out.groupBy("link_status").count().collect()}
    assert got == {"INVALID_URL": 5, "OK": 15}
