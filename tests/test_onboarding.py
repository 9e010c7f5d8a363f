"""Products verified and sources taken on, against the rules row by row."""

from __future__ import annotations

import random

import pytest

from quaylens.operators import coverage as cov
from quaylens.operators import gates as gt
from quaylens.operators import onboarding as ob

PRODUCT = "source string, source_product_id string, title string, price double, currency string, product_url string, sku string, capacity string, size string, concentration string, edition string, condition string, price_label string, price_text string, variant_key string, n int"


def product(source, i, **more):  # noqa: ANN001, ANN003, ANN201
    return {"source": source, "source_product_id": f"p{i}", "title": "t", "price": 1.0, "currency": "SAR", "product_url": "u", "sku": f"s{i}", "capacity": None, "size": None, "concentration": None, "edition": None, "condition": "", "price_label": None, "price_text": None, "variant_key": "own", "n": 1} | more


def plainly(rows):  # noqa: ANN001, ANN201
    """valid, semantic issues, variant issues, accuracy of one source's products."""
    valid = semantic = wrong = 0
    seen = set()
    for r in rows:
        full = all(r[c] not in (None, "") for c in ob.PRODUCT_FIELDS)
        told = f"{r['price_label'] or ''} {r['price_text'] or ''}".lower()
        other = "month" in told or "trade" in told
        valid += full and r["price"] > 0 and not other
        semantic += other
        key = "|".join(str(r[c]).lower() for c in ob.VARIANT_FIELDS if r[c])
        if not key:
            wrong += 1
            continue
        wrong += (key in seen) + (r["price"] is None)
        seen.add(key)
    return valid, semantic, wrong, max(0.0, (len(rows) - wrong) / len(rows))


def test_products_against_the_rule(spark):  # noqa: ANN001
    dice = random.Random(4)
    rows = [
        product(dice.choice("aaab"), i, price=dice.choice([None, 0.0, 2.0, 2.0, 2.0]), sku=dice.choice([None, "", "x", f"s{i}"]), edition=dice.choice([None, "X"]), product_url=dice.choice(["u", "u", ""]), price_label=dice.choice([None, "per month", "now"]), price_text=dice.choice([None, "Trade-in", "9"]))
        for i in range(300)
    ]
    got = {r.source: (r.valid, r.semantic_issues, r.variant_issues, r.variant_accuracy, r.products) for r in ob.verify_products(spark.createDataFrame(rows, PRODUCT), "source").collect()}
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert got[s] == (*plainly(mine), len(mine))


def test_issues(spark):  # noqa: ANN001
    rows = [product("a", 1), product("a", 2, title=""), product("a", 3, price=-1.0), product("a", 4, price=None), product("a", 5, sku=None, price_text="monthly"), product("a", 6, sku="S1")]
    df = spark.createDataFrame(rows, PRODUCT)
    assert sorted((r.source_product_id, r.issue) for r in ob.product_issues(df, "source").collect()) == [("p2", "field-coverage"), ("p3", "invalid-price"), ("p4", "field-coverage"), ("p4", "invalid-price"), ("p4", "missing-price"), ("p5", "missing-identity"), ("p5", "semantic-price")]
    assert [tuple(r) for r in ob.repeated_variants(df, "source").collect()] == [("a", "s1", 2)]


SOURCE = "source string, strategy_score double, javascript string, search string, search_endpoints array<string>, variants string, pagination string, reachable boolean, currency_verified boolean, market_verified boolean, search_passed boolean, repeatability_passed boolean, pagination_passed boolean, critical_field_coverage double, price_validity double, variant_accuracy double, semantic_critical_issues bigint, place int"
GOOD = {"strategy_score": 90.0, "javascript": None, "search": "discovered", "search_endpoints": ["/s"], "variants": "listed", "pagination": "page", "reachable": True, "currency_verified": True, "market_verified": True, "search_passed": True, "repeatability_passed": True, "pagination_passed": True, "critical_field_coverage": None, "price_validity": None, "variant_accuracy": None, "semantic_critical_issues": None, "place": 7}


@pytest.mark.parametrize(
    ("given", "reasons", "stage"),
    [
        ({}, [], "READY_FOR_REGISTRY"),
        ({"strategy_score": None}, ["no-strong-fast-strategy"], "DEEP_PROBE_REQUIRED"),
        ({"javascript": "required", "search_endpoints": [], "variants": "interactive", "pagination": ""}, ["javascript-required", "network-endpoint-unknown", "variant-interaction-required", "pagination-unknown"], "DEEP_PROBE_REQUIRED"),
        ({"pagination_passed": None}, [], "VERIFICATION_FAILED"),
        ({"price_validity": 0.5}, [], "VERIFICATION_FAILED"),
        ({"source": "no products"}, [], "VERIFICATION_FAILED"),
        ({"source": "no offers"}, [], "CANARY_FAILED"),
        ({"source": "not through"}, [], "E2E_FAILED"),
        ({"source": None}, [], "VERIFICATION_FAILED"),
    ],
)
def test_stages(spark, given, reasons, stage):  # noqa: ANN001
    names = ("good", "no offers", "not through")
    sources = spark.createDataFrame([{"source": "good"} | GOOD | given], SOURCE)
    products = spark.createDataFrame([product(s, i) for s in names for i in range(3)], PRODUCT)
    offers = spark.createDataFrame([(s, f"o{i}", "t", 1.0, "SAR", "u") for s in names if s != "no offers" for i in range(3)], "source string, offer_id string, title string, product_price double, currency string, source_url string")
    stages = spark.createDataFrame([(s, e, s != "not through") for s in names for e in cov.E2E_STAGES], "source string, stage string, passed boolean")
    r = ob.onboard(sources, products, offers, stages, "source", ["offer_id"]).first()
    assert (r.probe_reasons, r.stage, r.production_eligible, r.place) == (reasons, stage, stage == "READY_FOR_REGISTRY", 7)
    assert ob.onboard(sources.limit(0), products, offers, stages, "source", ["offer_id"]).count() == 0


def test_registry_entries(spark):  # noqa: ANN001
    df = spark.createDataFrame([("s", "n", "SA", "SA", "SAR", None, 3, "", "a")], "source_id string, name string, country string, market string, currency string, platform string, profile_version int, primary_strategy string, adapter string")
    r = ob.registry_entries(df).first()
    assert (r.platform, r.priority, r.health_status, r.enabled, r.missing) == ("unknown", 100, "HEALTHY", False, ["primary_strategy"])


def test_a_first_ingest_counts_every_offer(spark):  # noqa: ANN001
    rows = spark.range(450).selectExpr("concat('m', id % 2) AS merchant", "case when id = 449 then null else id <> 448 end AS recorded")
    got = {r.merchant: (r.attempted, r.saved, r.failed, r.passed) for r in gt.limited_ingest(rows, "merchant").collect()}
    assert got == {"m0": (225, 224, 1, False), "m1": (225, 224, 1, False)}
