"""Intents of queries, what else to ask, and the scorer's rules by kind of product."""

from __future__ import annotations

import pytest

from quaylens.operators import matching

DDL = "title string, brand string, category string, condition string, storage string, product_price double, source_url string, kind string, model_number string"


def scored(spark, query, **given):  # noqa: ANN001, ANN003, ANN201
    row = {"title": "", "brand": "", "category": None, "condition": "new", "storage": None, "product_price": 10.0, "source_url": None, "kind": "own", "model_number": None} | given
    out = matching.assess(spark.createDataFrame([row], DDL), matching.parse_intent(query))
    assert out.columns == [*DDL.replace(" string", "").replace(" double", "").split(", "), "query_score", "all_hits", "exact"]
    r = out.first()
    assert r.kind == "own"
    return r.query_score, r.exact


@pytest.mark.parametrize(
    ("query", "brand", "category", "kind", "mode", "asked"),
    [
        ("hp", "hp", None, None, "brand", "hp"),
        ("Nike sports shoes", "nike", "shoes", None, "specific", "nike shoes"),
        ("nike black sports shoes", "nike", "shoes", None, "specific", "nike black sports shoes"),
        ("used HP laptops", "hp", "laptop", None, "specific", "hp laptops"),
        ("laptop", None, "laptop", None, "category", "laptop"),
        ("sunscreen", None, None, None, "general", "sunscreen"),
        ("play station 5 slim", None, None, "console", "specific", "ps5 slim"),
        ("dyson v15", "dyson", "vacuum", None, "specific", "dyson v15"),
        ("", None, None, None, "general", ""),
    ],
)
def test_intents(query, brand, category, kind, mode, asked):  # noqa: ANN001
    i = matching.parse_intent(query)
    assert (i.brand, i.category, i.kind, i.mode, i.provider_query) == (brand, category, kind, mode, asked)


@pytest.mark.parametrize(
    ("query", "wider"),
    [
        ("hp", ["hp laptop", "hp printer", "hp desktop", "hp monitor"]),
        ("used galaxy s24 ultra 256gb", ["galaxy s24 ultra used", "galaxy s24 ultra", "phone used"]),
        ("hp laptop 512gb", ["hp laptop", "hp", "laptop"]),
        ("sunscreen", []),
        ("", []),
    ],
)
def test_fallback_queries(query, wider):  # noqa: ANN001
    assert matching.fallback_queries(matching.parse_intent(query)) == wider


@pytest.mark.parametrize(
    ("query", "given", "score", "exact"),
    [
        # the use of shoes, by the sold title alone
        ("nike sports shoes", {"title": "Nike Pegasus running shoes", "category": "shoes"}, 1.0, True),
        ("nike sports shoes", {"title": "Nike Court shoes", "category": "shoes"}, 0.67, False),
        ("nike sports shoes", {"title": "Nike Court shoes", "category": "shoes", "source_url": "https://x.example.com/sports/nike"}, 0.67, False),
        # perfumes for men
        ("dior perfume men", {"title": "Dior Sauvage pour Homme perfume", "category": "perfume"}, 1.0, True),
        ("dior perfume men", {"title": "Dior J'adore perfume for women and men", "category": "perfume"}, 0.67, False),
        # a whole watch, its case included
        ("apple watch series 9", {"title": "Apple Watch Series 9 GPS 45mm Midnight Aluminum Case with Sport Band", "category": "watch"}, 1.0, True),
        ("apple watch series 9", {"title": "Apple Watch Series 9", "category": "watch"}, 0.69, False),
        ("apple watch series 9", {"title": "Strap for Apple Watch Series 9", "category": "watch"}, 0.01, False),
        # loudspeakers and headphones
        ("jbl headphones", {"title": "JBL bluetooth speaker", "category": "audio"}, 0.2, False),
        ("jbl speaker", {"title": "JBL headphones with speaker", "category": "audio"}, 0.69, False),
        ("jbl speaker", {"title": "JBL Boombox speaker", "category": "audio"}, 1.0, True),
        # a vacuum cleaner's model must be in the title
        ("dyson v15", {"title": "Dyson cordless", "category": "vacuum", "source_url": "https://x.example.com/dyson-v15"}, 0.69, False),
        ("dyson v15", {"title": "Dyson V15 Detect vacuum cleaner", "category": "vacuum"}, 1.0, True),
        ("dyson v15", {"title": "Holder compatible with Dyson V15", "category": "vacuum"}, 0.05, False),
        # words of the address count for the rest
        ("acme zephyr kettle", {"title": "Acme kettle", "category": "appliance", "source_url": "https://x.example.com/p/acme-zephyr%20x"}, 1.0, True),
        # a handset with extras is no accessory
        ("iphone 15 128gb", {"title": "Apple iPhone 15 128GB with charger and case", "category": "phone"}, 1.0, True),
        ("iphone 15 128gb", {"title": "Case for iPhone 15 128GB", "category": "phone"}, 0.12, False),
        # a query of only a brand
        ("hp", {"title": "HP ProBook", "brand": "HP", "category": "laptop"}, 1.0, True),
        ("hp", {"title": "HP lamp", "brand": "HP", "category": "home"}, 0.3, False),
        # consoles by what is sold
        ("ps5 slim", {"title": "PlayStation 5 Slim console", "category": "console"}, 1.0, True),
        ("ps5 slim", {"title": "PS5 Slim cover", "category": "accessory"}, 0.02, False),
        ("ps5 slim", {"title": "Sony PS5 Slim Digital with Additional DualSense Controller", "category": "x"}, 1.0, True),
        # whole products and their parts
        ("office chair", {"title": "Office chair headrest attachment", "category": "furniture"}, 0.05, False),
        ("office chair", {"title": "Mesh folding chair", "category": "furniture"}, 0.03, False),
        ("coffee beans", {"title": "Coffee mug for beans lovers", "category": "coffee"}, 0.05, False),
        ("canon camera", {"title": "Canon EOS R10 mirrorless camera lens kit", "category": "camera"}, 1.0, True),
        ("canon camera", {"title": "Canon camera lens", "category": "camera"}, 0.05, False),
        ("apple watch", {"title": "Apple Watch for beginners", "category": "watch"}, 0.05, False),
        # nothing to read
        ("office chair", {"title": None, "brand": None, "condition": None}, 0.0, False),
    ],
)
def test_rules(spark, query, given, score, exact):  # noqa: ANN001
    got = scored(spark, query, **given)
    assert got == (score, exact)


def test_empty_table_and_ties(spark):  # noqa: ANN001
    rows = spark.createDataFrame([], DDL)
    assert matching.assess(rows, matching.parse_intent("ps5 slim")).count() == 0
    twice = spark.createDataFrame([("Office chair", "a", "furniture", "new", None, 1.0, "not an address", None, None)] * 2, DDL)
    assert [r.query_score for r in matching.assess(twice, matching.parse_intent("office chair")).collect()] == [1.0, 1.0]


def test_offers_of_one_text_are_read_once(spark):  # noqa: ANN001
    rows = spark.range(60).selectExpr(
        "cast(id AS string) AS offer_id", "case when id % 5 = 4 then null else concat('red widget ', id % 3) end AS title", "case when id % 5 = 3 then null else 'red' end AS brand",
        "'widget' AS category", "case when id % 2 = 0 then 'new' else 'used' end AS condition", "concat('https://s', id, '.example.com/p/', id % 4, '?v=', id) AS source_url",
        "cast(id AS double) AS product_price", "'live' AS data_kind", "cast(id AS timestamp) AS observed_at", "id % 7 AS product_id",
    )
    intent = matching.parse_intent("new red widget", ("widget",), ("red",))
    each = matching.assess(rows, intent).where(matching.admitted(intent))
    admitted = matching.admit(rows, intent)
    assert admitted.columns == each.columns and sorted(map(repr, admitted.collect())) == sorted(map(repr, each.collect()))
    fits = matching.reasons(rows, intent).where("reasons = ''")
    acquired = matching.retain_acquired(rows, intent)
    assert acquired.columns == fits.columns and sorted(map(repr, acquired.collect())) == sorted(map(repr, fits.collect()))
    # a filter on the result stays above the reading
    plan = acquired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate explode")
