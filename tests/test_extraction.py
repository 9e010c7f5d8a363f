"""Pages in, candidates of every way out."""

from __future__ import annotations

import json

import pytest

from quaylens.operators import extraction as ex


def script(value, kind="application/json", name=""):  # noqa: ANN001, ANN201
    return f'<script type="{kind}" id="{name}">{json.dumps(value)}</script>'


def ld(*values):  # noqa: ANN002, ANN201
    return "".join(script(v, "application/ld+json") for v in values)


def product(sku="S1", price="10.50", **more):  # noqa: ANN001, ANN003, ANN201
    return {"@type": "Product", "name": "Red Widget", "sku": sku, "brand": {"name": "Acme"}, "offers": {"@type": "Offer", "price": price, "priceCurrency": "SAR", "availability": "https://schema.org/InStock"}} | more


PAGES = {
    "ld": (ld(product()), None, "jsonld", "10.50"),
    "graph": (ld({"@graph": [product(offers={"@id": "#o"}), {"@id": "#o", "@type": "Offer", "price": 7, "priceCurrency": "SAR"}]}), None, "jsonld", "7"),
    "expected of two": (ld(product("S1"), product("S2", "20")), "S2", "jsonld", "20"),
    "embedded": (script({"a": [{"title": "W", "price": 5, "currency": "SAR", "sku": "k"}]}), None, "embedded_json", "5"),
    "next": (script({"props": {"p": {"name": "W", "price": 6.5}}}, name="__NEXT_DATA__"), None, "hydrated_state", "6.5"),
    "state": ('<script>window.__INITIAL_STATE__ = {"p": {"name": "W", "price": "8"}}; run();</script>', None, "hydrated_state", "8"),
    "shop": (script({"title": "T", "vendor": "V", "variants": [{"sku": "a", "price": 1999, "available": True}, {"sku": "b", "price": 2999}]}, name="ProductJson-1"), "b", "storefront_data", "29.99"),
    "adapter": (script({"x": {"artikel": "W", "preis": "9.90"}}), None, "domain_adapter", "9.90"),
    "meta": ('<title>T</title><meta property="og:title" content="W"><meta property="product:price:amount" content="12"><meta property="product:price:currency" content="SAR">', None, "meta", "12"),
    "visible": ('<h1>Red Widget</h1><div><span class="price">1,299.00</span> SAR</div>', None, "visible_dom", "1299.00"),
}
REFUSALS = {
    "two": (ld(product("S1"), product("S2")), None, "jsonld", "several products"),
    "neither": (ld(product("S1"), product("S2")), "S3", "jsonld", "no product is the expected one"),
    "another": (ld(product("S1")), "S3", "jsonld", "another product than expected"),
    "aggregate": (ld(product(offers={"@type": "AggregateOffer", "lowPrice": 1})), None, "jsonld", "an aggregate isn't for sale"),
    "offers": (ld(product(offers=[{"price": 1}, {"price": 2}])), None, "jsonld", "several offers"),
    "stranger": (ld(product(offers={"price": 1, "sku": "X"})), None, "jsonld", "the offer is another product's"),
    "no price": (ld(product(offers={"@type": "Offer"})), None, "jsonld", "no price"),
    "two embedded": (script([{"title": "A", "price": 1}, {"title": "B", "price": 2}]), None, "embedded_json", "several products"),
    "two variants": (script({"title": "T", "variants": [{"sku": "a", "price": 1}, {"sku": "b", "price": 2}]}, name="ProductJson"), None, "storefront_data", "several variants"),
    "two prices": ('<h1>Red Widget</h1><b class="price">10 SAR</b><b class="price">12 SAR</b>', None, "visible_dom", "several prices"),
}


@pytest.fixture(scope="module")
def found(spark):  # noqa: ANN001, ANN201
    rows = [(k, html, sku, "shop.example" if k == "adapter" else None) for k, (html, sku, *_) in (PAGES | {f"no {k}": v for k, v in REFUSALS.items()}).items()]
    odd = [("null", None, None, None), ("empty", "", None, None), ("plain", "<p>nothing for 10 SAR", None, None), ("broken", '<script type="application/ld+json">{"a": ', None, None), ("dear", '<h1>W W</h1><i class="price">5</i>', None, None), ("long", "<p>x" * 20_000, None, None)]
    df = spark.createDataFrame(rows + odd, "page_id string, html string, expected_sku string, host string").repartition(3)
    adapters = spark.createDataFrame([("shop.example", {"name": "artikel", "price": "preis,cost"})], "host string, names map<string,string>")
    out = ex.page_candidates(df, adapters)
    return out, out.collect()


@pytest.mark.parametrize("name", PAGES)
def test_each_way_finds_its_product(found, name):  # noqa: ANN001
    *_, strategy, price = PAGES[name]
    (r,) = [r for r in found[1] if r.page_id == name and r.refused is None]
    assert (r.strategy, r.price) == (strategy, price) and r.confidence > 0 and r.name


@pytest.mark.parametrize("name", REFUSALS)
def test_what_is_refused(found, name):  # noqa: ANN001
    *_, strategy, why = REFUSALS[name]
    assert [(r.strategy, r.refused, r.price, r.confidence) for r in found[1] if r.page_id == f"no {name}"] == [(strategy, why, None, None)]


def test_pages_without_a_product(found):  # noqa: ANN001
    assert not {r.page_id for r in found[1]} & {"null", "empty", "plain", "broken", "dear", "long"}


def test_one_tier_owns_a_page(spark):  # noqa: ANN001
    both = ld(product()) + '<meta property="product:price:amount" content="12"><h1>Red Widget</h1><b class="price">3 SAR</b>'
    df = spark.createDataFrame([("a", both), ("b", both.replace(ld(product()), ""))], "page_id string, html string")
    every = ex.page_candidates(df)
    assert every.count() == 5
    assert {(r.page_id, r.strategy) for r in ex.owner(every).collect()} == {("a", "jsonld"), ("b", "meta")}
