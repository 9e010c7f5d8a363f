"""Nodes of payloads at any depth."""

from __future__ import annotations

import json

from quaylens.sources import nested


def card(product="p", offer="1", price=5, **more):  # noqa: ANN001, ANN003, ANN201
    own = {"productId": product, "offerId": offer, "shopName": "Shop", "productName": "Name", "sellingPrice": price, "stock": {"stockLevelStatus": "inStock"}} | more
    return {"uid": nested.CARD, "componentDTO": {"additionalAttributes": own, "productCardComponents": [{"componentDTO": {"priceDTO": {"finalPrice": 0}}}, {"componentDTO": {"priceDTO": {"finalPrice": 7.5}}}]}}


def deep(node, n):  # noqa: ANN001, ANN201
    for i in range(n):
        node = [node] if i % 2 else {"x": 1, "y": node}
    return node


def payloads(spark, *values):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(str(i), v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "source_id string, payload string")


def test_cards_at_every_depth(spark):  # noqa: ANN001
    df = payloads(spark, {"rows": [deep(card(f"p{n}"), n) for n in (0, 1, 3, 6, 7, 20)]}, card("top"), None, "no json", {"rows": []}, 5)
    got = {(r.source_id, r.listing_id) for r in nested.product_cards(df).collect()}
    assert got == {("0", f"p{n}|1|Shop|5.00") for n in (0, 1, 3, 6, 7, 20)} | {("1", "top|1|Shop|5.00")}


def test_what_a_card_says(spark):  # noqa: ANN001
    within = card("outer", inner=card("inner"))
    rows = [card("a", price=None), card("b", price="1,299.00", markedPrice=1500), card("c", stock={"stockLevelStatus": "outOfStock"}), card("d", stock={"value": 0}), card("e", stock={}), card(""), card("f", productName=" "), within, card("g", offer="1"), card("g", offer="1", productName="Later"), card("g", offer="2")]
    got = {r.listing_id: r for r in nested.product_cards(payloads(spark, rows)).collect()}
    assert sorted(got) == ["a|1|Shop|7.50", "b|1|Shop|1299.00", "c|1|Shop|5.00", "d|1|Shop|5.00", "e|1|Shop|5.00", "g|1|Shop|5.00", "g|2|Shop|5.00", "outer|1|Shop|5.00"]
    assert got["b|1|Shop|1299.00"].list_price == 1500.0 and got["g|1|Shop|5.00"].title == "Name"
    assert [got[f"{p}|1|Shop|5.00"].availability for p in "cde"] == ["out_of_stock", "out_of_stock", "unknown"]


def test_values_by_name(spark):  # noqa: ANN001
    df = payloads(spark, {"Price": 5, "a": [{"price": "6"}, {"b": {"c": [[{"PRICE": 7, "other": 1}]]}}], "price": {"price": 9}})
    got = sorted((r.key, r.value or "") for r in nested.values_named(df, ["price"]).collect())
    assert [k for k, _ in got] == ["PRICE", "Price", "price", "price"] and {"5", "6", "7"} <= {v for _, v in got}


def test_what_a_payload_repeats_leaves_it_once():
    rows = [card("a"), {"x": [card("a"), {"y": card("b", stock={"value": True}, productUrl=["u"])}]}, {"uid": nested.CARD, "componentDTO": {"additionalAttributes": None, "z": card("within")}}]
    found = list(nested.card_fields(json.dumps({"z": rows, "a": card("last")})))
    assert [f[0] for f in found] == ["a", "b", None, "last"] and found[1][6] == '["u"]' and found[1][8] == "1"
    assert found[0][9] == ("0", "7.5") and list(nested.card_fields('{"a": NaN}')) == list(nested.card_fields(None)) == []
