"""Scalar functions and small operators on fixtures written for them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quaylens.functions import money, text, urls
from quaylens.operators import audit, catalog, coverage, gates, groups, matching, offers, pages, reliability
from quaylens.schema import OFFER_DDL
from quaylens.sources import payloads


def values(spark, function, inputs):  # noqa: ANN001, ANN201
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r.o for r in df.withColumn("o", function(F.col("v"))).orderBy("i").collect()]


def test_parse_money(spark):  # noqa: ANN001
    given = ["1,234.50", "1.234,50", "SAR 99", "1,234", "1.234", "12,5", "12.5", "-3", "n/a", "", None, "free", "1,2,3", "4 500,00"]
    assert values(spark, money.parse_money, given) == [1234.5, 1234.5, 99.0, 1234.0, 1234.0, 12.5, 12.5, None, None, None, None, None, None, 4500.0]


def test_strict_price(spark):  # noqa: ANN001
    assert [None if v is None else float(v) for v in values(spark, money.strict_price, ["12.30", "0", "12.345", "12,30", "SAR 5", None])] == [12.3, 0.0, None, None, None, None]


def test_conditions(spark):  # noqa: ANN001
    given = ["https://schema.org/UsedCondition", "DamagedCondition", "https://shop.example/new", "brand new", "never new", "Open-Box", "renewed", "like new", "newer", "", None]
    assert values(spark, text.normalize_condition, given) == ["used", "unknown", "unknown", "new", "unknown", "open_box", "refurbished", "used", "unknown", "unknown", "unknown"]


def test_availability(spark):  # noqa: ANN001
    assert values(spark, text.normalize_availability, ["In-Stock", "not available", "OutOfStock", "pre_order", "available now", "maybe", None]) == ["in_stock", "out_of_stock", "out_of_stock", "preorder", "in_stock", "unknown", "unknown"]


def test_canonical_url(spark):  # noqa: ANN001
    given = ["https://WWW.Shop.com/a//?utm_x=1&b=2&Ref=3#f", "https://shop.com", "http://shop.com/", "https://u:p@shop.com/", "nonsense", None]
    assert values(spark, urls.canonical_url, given) == ["https://shop.com/a?b=2", "https://shop.com/", None, None, None, None]


def test_normalize_text(spark):  # noqa: ANN001
    assert values(spark, text.normalize_text, ["ＡＢ－c", "آيفون", "  x__y ", None]) == ["ab c", "ايفون", "x y", ""]


def test_capacity_and_screen(spark):  # noqa: ANN001
    assert values(spark, text.capacity_gb, ["phone 256 GB", "1tb", "64gb or 128gb", "none", None]) == [256, 1024, None, None, None]
    assert values(spark, text.screen_size, ['15,6"', "15.0 inches", "17 in", "big"]) == ["15.6inch", "15inch", "17inch", "big"]


def offer(**given):  # noqa: ANN003, ANN201
    base = dict.fromkeys(x.split()[0] for x in OFFER_DDL.split(","))
    base |= {"offer_id": "o", "condition": "new", "availability": "in_stock", "can_ship_to_saudi": True, "product_price": 100.0, "shipping": 0.0, "import_cost": 5.0, "tax": 15.0, "mandatory_fees": 0.0, "exact_match": True, "match_confidence": 1.0, "currency": "SAR"}
    return base | given


@pytest.mark.parametrize(
    ("given", "total", "bucket"),
    [
        ({}, 120.0, "confirmed"),
        ({"discount": 200.0}, 0.0, "confirmed"),
        ({"tax": None}, None, "incomplete"),
        ({"shipping": float("nan")}, None, "incomplete"),
        ({"currency": "USD"}, None, "incomplete"),
        ({"can_ship_to_saudi": None}, 120.0, "incomplete"),
        ({"can_ship_to_saudi": False}, 120.0, "ineligible"),
        ({"condition": None}, 120.0, "ineligible"),
        ({"match_confidence": 0.89}, 120.0, "probable"),
        ({"price_confidence": "estimated"}, 120.0, "estimated"),
    ],
)
def test_certainty(spark, given, total, bucket):  # noqa: ANN001
    row = offers.enrich(spark.createDataFrame([offer(**given)], OFFER_DDL)).first()
    assert (row.total_sar, row.bucket) == (total, bucket)


def test_cohorts_are_anchored(spark):  # noqa: ANN001
    rng = random.Random(4)
    levels = sorted({rng.randrange(1, 65) / 100 for _ in range(40)}, reverse=True)
    df = spark.createDataFrame([offer(offer_id=str(i), exact_match=False, match_confidence=c) for i, c in enumerate(levels)], OFFER_DDL)
    got = {r.match_confidence: r.cohort for r in offers.cohorts(df).where("tier = 1").collect()}
    expected, top, n = {}, None, -1
    for c in levels:
        if top is None or c <= top - 0.12:
            top, n = c, n + 1
        expected[c] = n
    assert got == expected


def test_upsert_keeps_the_stored_row_among_equals(spark):  # noqa: ANN001
    ddl = "k int, offer_id string, observed_at string"
    current = spark.createDataFrame([(1, "a", "2020"), (2, "b", "2020"), (3, "c", None)], ddl)
    incoming = spark.createDataFrame([(1, "x", "2021"), (2, "y", "2020"), (3, "z", "2019"), (4, "w", None)], ddl)
    assert sorted(r.offer_id for r in catalog.upsert(current, incoming, ["k"]).collect()) == ["b", "w", "x", "z"]


def test_averages_equal_a_fold(spark):  # noqa: ANN001
    rng = random.Random(8)
    rows = [(f"s{i % 2}", i, f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", rng.choice([None, -1.0, rng.random() * 100]), rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, event_id int, observed_at string, latency_ms double, transport_ok boolean").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    got = {r.source_id: r for r in reliability.folded(df).collect()}
    for source in ("s0", "s1"):
        average, failures = None, 0
        for _, _, _, latency, ok in sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[1])):
            if latency is not None and latency >= 0:
                average = latency if average is None else average * 0.72 + latency * 0.28
            failures = 0 if ok else failures + 1
        assert abs(got[source].latency_ewma - average) < 1e-9 and got[source].consecutive_failures == failures


@pytest.mark.parametrize(
    ("fails", "success", "price", "held", "state"),
    [(0, 1.0, 1.0, False, "HEALTHY"), (0, None, None, None, "HEALTHY"), (1, 1.0, 1.0, False, "DEGRADED"), (3, 1.0, 1.0, False, "CIRCUIT_OPEN"), (0, 0.49, 1.0, False, "CIRCUIT_OPEN"), (0, 1.0, 0.89, False, "CIRCUIT_OPEN"), (0, 1.0, 0.98, False, "DEGRADED"), (0, 1.0, 1.0, True, "QUARANTINED")],
)
def test_health(spark, fails, success, price, held, state):  # noqa: ANN001
    row = reliability.health(spark.createDataFrame([(fails, success, price, held)], "consecutive_failures int, success_rate double, price_validity double, quarantined boolean")).first()
    assert row.state == state and row.ingest == (state in ("HEALTHY", "DEGRADED"))


def test_certification(spark):  # noqa: ANN001
    full = {"reachable": True, "strategy_score": 70.0, "critical_field_coverage": 0.99, "price_validity": 1.0, "currency_verified": True, "market_verified": True, "search_passed": True, "pagination_passed": True, "variant_accuracy": 0.995, "semantic_critical_issues": 0, "repeatability_passed": True}
    ddl = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in full.items())
    for change, state in [({}, "CERTIFIED"), ({"variant_accuracy": 0.994}, "CANDIDATE"), ({"semantic_critical_issues": None}, "CERTIFIED"), ({"strategy_score": 69.99}, "PROBED"), ({"reachable": None}, "DISCOVERED"), ({"market_verified": None}, "CANDIDATE")]:
        row = audit.certify(spark.createDataFrame([full | change], ddl)).first()
        assert (row.state, row.passed) == (state, state == "CERTIFIED")


def test_sample_sizes_and_scores(spark):  # noqa: ANN001
    rows = [(0, True, 5), (5, True, 10), (9, False, 10), (10, True, None), (10, False, 20), (20, False, 50), (50, False, 100), (50, True, None)]
    df = spark.createDataFrame(rows, "n int, same boolean, expected int")
    assert df.where(~audit.next_sample_size(F.col("n"), F.col("same")).eqNullSafe(F.col("expected"))).count() == 0
    names = list(audit.SCORE_WEIGHTS)
    one = spark.createDataFrame([(1.0, 0.5, 2.0, -1.0, None, float("nan"), 1.0)], ", ".join(f"{n} double" for n in names))
    assert one.select(audit.extraction_score()).first()[0] == 59.0  # 25 + 9 + 15 + 0 + 0 + 0 + 10


def test_products_of_pages():
    block = '<script type="application/ld+json">{"@graph": [{"@type": "Offer", "@id": "#o", "price": 5, "priceCurrency": "SAR"}, {"@type": "Product", "name": "x", "sku": "1", "offers": {"@id": "#o"}}, {"@type": "Product", "name": "range", "offers": {"@type": "AggregateOffer", "price": 1}}]}</script>'
    assert [(p["name"], p["price"], p["strategy"]) for p in pages.products_of(block)] == [("x", "5", "jsonld")]
    meta = '<meta property="og:title" content="m"><meta property="product:price:amount" content="7">'
    assert [(p["name"], p["price"], p["strategy"]) for p in pages.products_of(meta)] == [("m", "7", "meta")]
    assert pages.products_of('<script type="application/ld+json">{broken</script>') == []


def test_payload_of_another_form_has_no_items(spark):  # noqa: ANN001
    df = spark.createDataFrame([("s", '{"hits": 3}'), ("s", "no json"), ("s", None)], "source_id string, payload string")
    assert payloads.parse(df, payloads.FORMATS["hits"]).count() == 0


def test_cheapest_shipping(spark):  # noqa: ANN001
    p = '{"itemSummaries": [{"itemId": "1", "title": "t", "price": {"value": "9.5", "currency": "USD"}, "condition": "Used", "shippingOptions": [{"cost": "7"}, {"cost": "3"}]}]}'
    row = payloads.parse(spark.createDataFrame([("e", p)], "source_id string, payload string"), payloads.FORMATS["item_summaries"]).first()
    assert (row.price, row.shipping, row.condition, row.currency) == (9.5, 3.0, "used", "USD")


def test_intent():
    i = matching.parse_intent("New Red Widget 128 GB", ("widget",), ("red",))
    assert (i.category, i.storage, i.color, i.condition, i.tokens) == ("widget", "128gb", "red", "new", ("red", "128gb"))
    assert matching.relaxed(i) == ["red widget", "widget"]


def grouped(rows, category="C"):  # noqa: ANN001, ANN201
    """The group of each offer (id, model number, name, storage, colour)."""
    held = []
    for o, m, n, s, c in rows:
        telling = bool(n) and (category not in groups.NUMBERED or any(x.isdigit() for x in n)) and (category != "phone" or bool(s and c))
        held.append({"id": o, "category": category, "name": n, "telling": telling, "number": m, "attributes": {k: v for k, v in (("storage", s), ("color", c)) if v}, "n": 1})
    held.sort(key=lambda r: (r["number"] == "", "|".join((r["name"], r["attributes"].get("storage", ""), r["attributes"].get("color", ""), r["number"])), r["id"]))
    return {r["id"]: g for r, (g, _) in zip(held, groups.grouped(held), strict=True)}


def test_groups_never_bridge_model_numbers():
    got = grouped([("1", "a", "n", "s", "c"), ("2", "b", "n", "s", "c"), ("3", "", "n", "s", "d"), ("4", "a", "m", "s", "c"), ("5", "", "", "s", "c"), ("6", "", "", "s", "c2"), ("7", "a", "k", "s", "e")])
    assert got["1"] == got["4"] != got["2"]
    assert got["7"] not in (got["1"], got["2"])  # an equal number doesn't outweigh another colour
    assert len({got["3"], got["5"], got["6"], got["1"], got["2"]}) == 5  # another colour, or an unknown name, is no proof


def test_groups_of_phones_and_numbered_models():
    phones = grouped([("1", "a", "x 5", "64gb", "red"), ("2", "a", "x 6", "64gb", "red"), ("3", "", "x 7", "", "red"), ("4", "", "x 7", "", "red2")], "phone")
    assert len(set(phones.values())) == 4
    laptops = grouped([("1", "", "slim", "64gb", "red"), ("2", "m", "slim", "64gb", "red")], "laptop")
    assert laptops["1"] != laptops["2"]
    assert len(set(grouped([("1", "", "slim 5", "64gb", "red"), ("2", "m", "slim 5", "64gb", "red")], "laptop").values())) == 1


def scored(spark, query, **given):  # noqa: ANN001, ANN003, ANN201
    row = {"title": "", "brand": "", "category": None, "condition": "new", "storage": None, "product_price": 10.0} | given
    df = spark.createDataFrame([row], "title string, brand string, category string, condition string, storage string, product_price double")
    r = matching.reasons(df, matching.parse_intent(query)).first()
    return r.query_score, r.exact, r.reasons


@pytest.mark.parametrize(
    ("query", "given", "score", "exact", "reasons"),
    [
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB", "category": "phone"}, 1.0, True, ""),
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB", "category": "phone", "condition": "unknown"}, 1.0, True, ""),
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB", "category": "phone", "condition": "used"}, 0.85, False, "query_mismatch"),
        ("used galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB", "category": "phone", "condition": "used"}, 1.0, True, ""),
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB renewed", "category": "phone"}, 0.85, False, "query_mismatch"),
        ("galaxy s24 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB", "category": "phone"}, 0.16, False, "model_conflict,query_mismatch"),
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 512GB", "category": "phone"}, 0.55, False, "capacity_conflict,query_mismatch"),
        ("galaxy s24 ultra 256gb", {"title": "Samsung Galaxy S24 Ultra 256GB (AT&T)", "category": "phone"}, 0.2, False, "query_mismatch"),
        ("galaxy s24 ultra 256gb at&t", {"title": "Samsung Galaxy S24 Ultra 256GB (AT&T)", "category": "phone"}, 1.0, True, ""),
        ("galaxy s24 ultra 256gb", {"title": "Case for Galaxy S24 Ultra 256GB", "category": "accessory"}, 0.02, False, "query_mismatch"),
        ("dyson v15 vacuum cleaner", {"title": "Dyson V15 vacuum cleaner replacement filters", "category": "vacuum"}, 0.05, False, "query_mismatch"),
        ("hp laptop", {"title": "HP Everyday Laptop", "brand": "HP", "category": "laptop"}, 0.69, False, ""),
        ("hp laptop 16gb ram", {"title": "HP ProBook 16GB DDR5 RAM", "brand": "HP", "category": "laptop"}, 1.0, True, ""),
        ("hp laptop 16gb ram", {"title": "HP ProBook 8GB DDR5 RAM 16GB", "brand": "HP", "category": "laptop"}, 0.2, False, "query_mismatch"),
        ("hp laptop 16gb ram", {"title": "HP ProBook RAM upgrade 16gb kit", "brand": "HP", "category": "laptop"}, 0.69, False, ""),
    ],
)
def test_scores(spark, query, given, score, exact, reasons):  # noqa: ANN001
    assert scored(spark, query, **given) == (score, exact, reasons)


def test_intents_by_category_words():
    i = matching.parse_intent("used HP laptop 16gb ram 512 GB")
    assert (i.category, i.storage, i.ram, i.condition) == ("laptop", "512gb", 16, "used")
    assert matching.parse_intent("iPhone 15 Pro Max 256gb").model == "iphone 15 pro max"
    assert matching.category_of("leather cover") == "accessory" and matching.category_of("granite") is None


def test_queries_in_normal_form(spark):  # noqa: ANN001
    normal = text.query_normalizer({"جوال": "phone", "ايفون": "iphone"}, {"téléphone portable": "phone", "téléphone": "phone"})
    given = ["ابغي جوال ايفون ١٥ 256", "Galaxy S24+ 512", "Téléphone portable", "please find PlayStation 5 2nd 825 GB", "ＨＰ－Laptop", None]
    assert values(spark, normal, given) == ["phone iphone 15 256gb", "galaxy s24 plus 512gb", "phone", "ps5 2 825gb", "hp laptop", ""]


def test_tokens_of_any_script(spark):  # noqa: ANN001
    assert values(spark, text.plain_text, ["Déjà-Vu, 漢字!", "آيفون ١٥"]) == ["déjà vu 漢字", "آيفون ١٥"]


def test_fuzzy_ratio(spark):  # noqa: ANN001
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(text.fuzzy_ratio(F.col("a"), F.col("b"))).collect()] == [75.0, 100.0, 0.0, 100.0]


@pytest.mark.parametrize(
    ("name", "url", "excluded"),
    [("Decathlon", None, True), ("DECATHLON KSA", None, True), ("Decathlonia", None, False), ("x", "https://shop.decathlon.co.uk/a", True), ("x", "https://mydecathlon.com/", False), (None, None, False)],
)
def test_excluded_merchant(spark, name, url, excluded):  # noqa: ANN001
    df = spark.createDataFrame([(name, url)], "n string, u string")
    assert df.select(gates.excluded_merchant(F.lit(None).cast("string"), F.col("n"), F.col("u"))).first()[0] is excluded


@pytest.mark.parametrize(
    ("status", "message", "expected"),
    [(429, "x", "HTTP_429_RATE_LIMITED"), (None, "status: 410 gone", "HTTP_410_RESOURCE_GONE"), (None, "product 404 pack", "UNKNOWN"), (599, None, "HTTP_5XX_SOURCE_FAILURE"), (None, "deadline exceeded", "HTTP_TIMEOUT"), (None, "sku mismatch", "PRODUCT_IDENTITY_MISMATCH"), (None, None, "UNKNOWN"), (302, "redirect changed", "HTTP_REDIRECT_CHANGED")],
)
def test_failure_class(spark, status, message, expected):  # noqa: ANN001
    df = spark.createDataFrame([(status, message)], "s int, m string")
    assert df.select(coverage.failure_class(F.col("s"), F.col("m"))).first()[0] == expected


def test_sitemaps(spark):  # noqa: ANN001
    good = "<urlset xmlns='x'><url><loc>https://a.com/1?x=1&amp;y=2#f</loc></url><url><loc> https://A.com/1?x=1&amp;y=2</loc></url><url><loc>http://a.com/2</loc></url><url><loc>https://u@a.com/3</loc></url><url><loc>https://b.com/4</loc></url><url></url></urlset>"
    rows = [("a.com", good), ("a.com", "<!DOCTYPE x>" + good), ("a.com", "<sitemapindex/>"), ("a.com", None), ("bad host", good)]
    got = coverage.sitemap_urls(spark.createDataFrame(rows, "merchant_host string, xml string")).collect()
    assert [r.reason for r in got] == ["SITEMAP_URLSET_PARSED", "INVALID_OR_UNTRUSTED_SITEMAP", "SITEMAP_INDEX_REQUIRES_CHILDREN", "NOT_A_URL_SITEMAP", "INVALID_OR_UNTRUSTED_SITEMAP"]
    assert got[0].urls == ["https://a.com/1?x=1&y=2", "https://A.com/1?x=1&y=2"] and all(not r.complete and r.urls == [] for r in got[1:])


def test_deep_structured_data():
    block = '{"@type": "Product", "name": "x", "offers": {"price": 5}}'
    for _ in range(60):
        block = '{"a": [' + block + "]}"
    assert [p["name"] for p in pages.products_of(f'<script type="application/ld+json">{block}</script>')] == ["x"]
    assert pages.products_of('<script type="application/ld+json">' + "[" * 100_000 + "</script>") == []
