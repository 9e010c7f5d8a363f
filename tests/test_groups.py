"""Comparable groups against the rule over plain offers, one after another."""

from __future__ import annotations

import random

import pytest

from quaylens.operators import groups

DDL = "offer_id string, merchant string, title string, brand string, category string, condition string, model_number string, storage string, color string, ram string, region string, form string, edition string, extra_specs map<string,string>, availability string, can_ship_to_saudi boolean, delivery_days int, product_price double, shipping double, import_cost double, tax double, mandatory_fees double, discount double, currency string, exact_match boolean, match_confidence double, price_confidence string"
CORE = ("storage", "color", "edition", "form", "bundle")
NUMBERED = ("laptop", "printer", "desktop", "monitor", "tv", "tablet", "camera", "watch")


def offer(n, **fields):  # noqa: ANN001, ANN003, ANN201
    base = {"offer_id": f"o{n:05d}", "merchant": "A", "title": "Thing 1", "brand": "Acme", "category": "phone", "condition": "new", "availability": "in_stock", "product_price": 1000.0, "currency": "SAR", "exact_match": True, "match_confidence": 1.0}
    return base | fields


def table(spark, rows):  # noqa: ANN001, ANN201
    names = [c.split()[0] for c in DDL.split(", ") if " " in c]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], DDL).repartition(3)


def sizes(spark, *rows):  # noqa: ANN001, ANN201
    return sorted(r.offers for r in groups.comparable(table(spark, [offer(i, **r) for i, r in enumerate(rows)])).collect())


PHONE = {"brand": "Apple", "title": "Apple iPhone 17 256GB Black", "storage": "256GB", "color": "Black"}
HP = {"category": "laptop", "brand": "HP", "title": "HP Notebook 15 Laptop", "model_number": "D80WREA", "ram": "16GB", "storage": "512GB"}


def test_one_product_in_other_words(spark):  # noqa: ANN001
    assert sizes(spark, PHONE | {"model_number": "MG674AH/A"}, PHONE | {"title": "iPhone 17 Smartphone Black 256 GB", "storage": "256 GB", "merchant": "B"}) == [2]
    assert sizes(spark, HP, HP | {"title": "HP 15 Laptop Intel Core 7", "ram": "16 GB", "storage": "512 GB"}) == [2]
    # an equal number doesn't outweigh another capacity
    assert sizes(spark, HP, HP | {"title": "HP 15 Laptop Intel Core 7"}, HP | {"ram": "8GB"}) == [1, 2]
    assert sizes(spark, HP, HP | {"storage": "64gb", "color": "red"}, HP | {"storage": "128gb", "color": "blue"}) == [1, 1, 1]


@pytest.mark.parametrize("other", [{"condition": "used"}, {"storage": "512GB"}, {"region": "USA"}, {"region": None}, {"color": "White"}, {"extra_specs": {"screenSize": "6.9 INCH"}}, {"extra_specs": {"screenSize": "6.3 cm"}}, {"model_number": "MG674LL/A"}])
def test_what_keeps_phones_apart(spark, other):  # noqa: ANN001
    first = PHONE | {"region": "Middle East", "model_number": "MG674AHA", "extra_specs": {"screenSize": '6.3"'}}
    assert sizes(spark, first, first | {"extra_specs": {"screenSize": "6.3 INCH"}, "model_number": "MG674AH/A"}) == [2]
    assert sizes(spark, first, first | other) == [1, 1]


def test_sizes_keep_shirts_apart_and_names_without_digits_prove_nothing(spark):  # noqa: ANN001
    shirt = {"title": "Forest Shirt", "category": "clothing"}
    assert sizes(spark, shirt, shirt) == [2]
    assert sizes(spark, shirt | {"extra_specs": {"Size": "M"}}, shirt | {"extra_specs": {"Size": "L"}}) == [1, 1]
    assert sizes(spark, *[{"category": "laptop", "title": "HP Pavilion Laptop"}] * 3) == [1, 1, 1]
    assert sizes(spark, *[{"title": "Apple iPhone 17"}] * 2) == [1, 1]


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 2, 0), (2, 1, 0)])
def test_an_offer_without_a_number_is_no_bridge(spark, order):  # noqa: ANN001
    rows = [PHONE | {"model_number": "MG674AH/A"}, PHONE, PHONE | {"model_number": "MG674LL/A"}]
    assert sizes(spark, *[rows[i] for i in order]) == [1, 1, 1]
    # several such offers are a group each
    assert sizes(spark, *[rows[i] for i in order], PHONE | {"merchant": "D"}) == [1, 1, 1, 1]


def test_values_of_one_kind_are_compared(spark):  # noqa: ANN001
    costs = {"shipping": 50.0, "import_cost": 0.0, "tax": 0.0, "mandatory_fees": 0.0, "discount": 0.0, "can_ship_to_saudi": True}
    laptop = {"category": "laptop", "title": "HP ProBook 440 G8 Laptop"}
    rows = [offer(0, **laptop, **costs), offer(1, **laptop, product_price=800.0, merchant="B", delivery_days=3)]
    (g,) = groups.comparable(table(spark, rows)).collect()
    assert (g.price_basis, g.best_value, g.savings_to_next, g.merchants, g.fastest_days, g.best_offer) == ("comparable_total", 1050.0, None, 2, 3, "o00000")
    (g,) = groups.comparable(table(spark, [*rows, offer(2, **laptop, **costs | {"shipping": 80.0})])).collect()
    assert (g.best_value, g.savings_to_next) == (1050.0, 30.0)
    (g,) = groups.comparable(table(spark, [offer(0, **laptop, product_price=900.0), offer(1, **laptop, product_price=1000.0)])).collect()
    assert (g.price_basis, g.best_value, g.savings_to_next) == ("advertised_price", 900.0, 100.0)


def may_meet(a, b):  # noqa: ANN001, ANN201
    if any(a[k] != b[k] for k in ("brand", "category", "condition")) or (a["number"] and b["number"] and a["number"] != b["number"]):
        return False
    same, x, y = bool(a["number"]) and a["number"] == b["number"], dict(a["attributes"]), dict(b["attributes"])
    for k in {*x, *y}:
        u, v = x.get(k, ""), y.get(k, "")
        if same and k == "form" or u == v:
            continue
        if (u and v) or (k in CORE and not same) or (a["category"] == "phone" and k == "region"):
            return False
    if same:
        return a["category"] != "phone" or a["name"] == b["name"]
    if not a["name"] or a["name"] != b["name"] or (a["category"] in NUMBERED and not any(c.isdigit() for c in a["name"])):
        return False
    return a["category"] != "phone" or bool(x.get("storage") and x.get("color"))


def one_after_another(rows):  # noqa: ANN001, ANN201
    """The rule over offers. Offers of one variant key go by identity, by the best of each."""
    first: dict = {}
    for r in rows:
        first[r.id] = min(first.get(r.id, r.offer_id), r.offer_id)
    out: list[list] = []
    for r in sorted(rows, key=lambda r: (r.identity.number == "", r.key, first[r.id], r.offer_id)):
        who = r.identity.asDict(recursive=True) | {"attributes": [(e["key"], e["value"]) for e in r.identity.attributes]}
        found = [g for g in out if all(may_meet(m, who) for m, _ in g)]
        if len(found) == 1:
            found[0].append((who, r.offer_id))
        else:
            out.append([(who, r.offer_id)])
    return sorted(sorted(i for _, i in g) for g in out)


@pytest.mark.parametrize("seed", range(3))
def test_random_attributes(spark, seed):  # noqa: ANN001
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = [
        offer(i, title=pick("Thing 1", "Thing 2", "Thing", "iPhone 17 x"), category=pick("phone", "laptop", "toy"), brand=pick("Acme", "Bolt"), model_number=pick(None, None, "M-1", "m1", "M2", ""), storage=pick(None, "64 GB", "64gb", "128gb"), color=pick(None, "red", "blue"), ram=pick(None, None, "8gb", "16gb"), region=pick(None, None, None, "EU"), form=pick(None, None, "slim"), extra_specs=pick(None, {}, {"Material": "wood"}, {"pack_size": "2", "unknown": "x"}), product_price=1000.0 + i)
        for i in range(250)
    ]
    df = table(spark, rows)
    keyed = groups.identity(df).withColumn("key", groups.variant_key()).selectExpr("offer_id", "identity", "key", "to_json(identity) AS id").collect()
    got: dict = {}
    for r in groups.members(df).collect():
        got.setdefault(r.group, []).append(r.offer_id)
    assert sorted(map(sorted, got.values())) == one_after_another(keyed)


def test_a_large_block_is_many_components(spark):  # noqa: ANN001
    rows = [offer(i, category="laptop", title=f"Book {i % 400}", model_number=f"N{i}" if i % 2 else None) for i in range(1200)]
    got = groups.comparable(table(spark, rows))
    assert sum(r.offers for r in got.collect()) == 1200
    keyed = groups.identity(table(spark, rows))
    edges = keyed.selectExpr("xxhash64(identity) AS id", "xxhash64(identity.name) AS key").distinct()
    assert groups.components(edges, groups.work_folder(spark, "t")).select("component").distinct().count() == 200


def test_components_of_a_long_chain(spark):  # noqa: ANN001
    edges = [(i, k) for i in range(300) for k in (i, i + 1)] + [(1000, 5000), (1001, 5000), (2000, 7000)]
    df = spark.createDataFrame(edges, "id long, key long")
    got = {r.id: r.component for r in groups.components(df, groups.work_folder(spark, "chain")).collect()}
    assert {got[i] for i in range(300)} == {0} and got[1001] == 1000 and 2000 not in got


def test_offers_of_one_id_that_fit_nothing_are_one_group(spark):  # noqa: ANN001
    laptop = {"category": "laptop", "title": "HP Pavilion Laptop", "offer_id": "same"}
    rows = [offer(0, **laptop, delivery_days=5), offer(1, **laptop | {"merchant": None, "product_price": 900.0}), offer(2, **laptop, delivery_days=2), offer(3, **laptop | {"merchant": "B", "offer_id": None}), offer(4, **laptop | {"offer_id": None})]
    got = sorted(groups.comparable(table(spark, rows)).collect(), key=lambda g: -g.offers)
    assert [(g.offers, g.merchants, g.best_offer, g.best_value, g.savings_to_next, g.fastest_days) for g in got] == [(3, 1, "same", 900.0, 100.0, 2), (2, 2, None, 1000.0, None, None)]
    assert got[0].group.endswith("/same") and got[1].group.count("/") == 1


def test_the_first_offer_is_looked_up_only_where_keys_are_equal(spark):  # noqa: ANN001
    def best(*rows):  # noqa: ANN002, ANN202
        e = groups.enrich(groups.identity(table(spark, [offer(i, **r) for i, r in enumerate(rows)]))).selectExpr("*", "xxhash64(identity) AS id", "0L AS check")
        said = e.selectExpr("id AS said", "check AS said_check", "id", "check").distinct()
        few = e.groupBy("id", "check").agg(groups.F.any_value("identity").alias("identity")).withColumn("key", groups.variant_key())
        return sorted((r.best is not None) and r.best.offer_id for r in groups.with_best(few, said, e.withColumnsRenamed({"id": "said", "check": "said_check"})).collect())

    assert best({"title": "Thing 1"}, {"title": "Thing 2"}) == [False, False]
    assert best({"form": "slim"}, {"form": "wide"}, {"form": "slim", "product_price": 5.0}) == ["o00001", "o00002"]


def test_no_offers(spark):  # noqa: ANN001
    assert groups.comparable(table(spark, [])).count() == 0
