"""Passes in pages, and the cascade of a variant selector."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaylens.operators import coverage, matching, selector, sweeps


def test_pages_give_what_one_join_gives_and_wrap(spark, tmp_path):  # noqa: ANN001
    c = spark.createDataFrame([(f"k{i:02d}", i % 3, f"f{i}", i % 10 == 0) for i in range(23)], "key string, revision int, fingerprint string, stale boolean")
    i = spark.createDataFrame([(f"k{n:02d}", n % 3 if n % 4 else 9, f"f{n}" if n % 5 else "old") for n in range(0, 30, 1) if n % 7], "key string, revision int, fingerprint string")
    cursor, size, pages, found = sweeps.Cursor(spark, str(tmp_path / "cursor")), 5, 0, []
    while True:
        actions, last, upper = sweeps.reconcile_page(c, i, "key", cursor, size, F.col("stale"))
        again, *_ = sweeps.reconcile_page(c, i, "key", sweeps.Cursor(spark, str(tmp_path / "cursor")), size, F.col("stale"))
        assert sorted(map(tuple, actions.collect())) == sorted(map(tuple, again.collect()))  # a page that wasn't finished comes again
        found += [tuple(r) for r in actions.collect()]
        pages += 1
        # what is written meanwhile beyond the end is the next pass's
        if pages == 1:
            c = c.unionByName(spark.createDataFrame([("k99", 1, "f", False)], c.schema))
        if sweeps.advance(cursor, last, upper, "string"):
            break
    assert pages == 5 and len(found) == 23
    held = {r.key: r for r in i.collect()}
    for r in c.where("key <> 'k99'").collect():
        there = held.get(r.key)
        action = ("remove" if there else "skip") if r.stale else "keep" if there and (there.revision, there.fingerprint) == (r.revision, r.fingerprint) else "repair"
        assert (r.key, action) in found
    assert sweeps.reconcile_page(c, i, "key", cursor, 99)[0].count() == 24
    none = sweeps.reconcile_page(c.where("false"), i, "key", sweeps.Cursor(spark, str(tmp_path / "new")), 5)
    assert none[0].count() == 0 and none[1] is None


def test_outbox_in_order_of_id(spark, tmp_path):  # noqa: ANN001
    out = spark.createDataFrame([(i, f"k{i % 4}", i % 3) for i in range(12)], "id long, key string, revision int").orderBy(F.rand(1))
    now = spark.createDataFrame([("k0", 0), ("k1", 1), ("k2", 2)], "key string, revision int")
    cursor, ids = sweeps.Cursor(spark, str(tmp_path / "c")), []
    ended = False
    while not ended:
        page, last, upper = sweeps.outbox_page(out, now, "key", cursor, 5)
        ids.append([r.id for r in page.orderBy("id").collect()])
        assert {r.id: r.status for r in page.collect()} == {i: "orphan" if i % 4 == 3 else "published" if i % 3 == i % 4 else "superseded" for i in ids[-1]}
        ended = sweeps.advance(cursor, last, upper, "long")
    assert ids == [list(range(5)), list(range(5, 10)), [10, 11]]


DDL = "product string, place int, value double, exact boolean, model string, edition string, storage string, condition string, color string, sku string, requested_model string, requested_storage string, requested_color string"


def entry(place, value, model="m", storage="64", condition="new", color="red", exact=False, asked=(None, None, None), sku=None):  # noqa: ANN001, ANN201
    return ("p", place, value, exact, model, "", storage, condition, color, sku, *asked)


CASES = {
    "what is asked for": ([entry(0, 9.0), entry(1, 5.0, storage="128", asked=(None, "128", None))], ("m", "128", "new", "red")),
    "nearest that is there": ([entry(0, 9.0, color="blue"), entry(1, 5.0, storage="128", color="red")], ("m", "128", "new", "red")),
    "the exact new one": ([entry(0, 1.0, condition="used", exact=True), entry(1, 5.0, storage="128", exact=True)], ("m", "128", "new", "red")),
    "the first": ([entry(0, 7.0, storage="256"), entry(1, 5.0, storage="128")], ("m", "256", "new", "red")),
    "the cheapest": ([entry(0, 9.0, model="a"), entry(1, 5.0, model="b", storage="128"), entry(2, 4.0, model="b", storage="256"), entry(3, None, model="b", storage="32")], ("b", "256", "new", "red")),
    "nothing known": ([entry(0, 9.0, storage=None, color=" ")], ("m", None, "new", None)),
    "equal prices": ([entry(0, 9.0, model="a"), entry(1, 5.0, model="b", storage="y"), entry(2, 5.0, model="b", storage="x")], ("b", "x", "new", "red")),
}


@pytest.mark.parametrize("name", CASES)
def test_the_cascade(spark, name):  # noqa: ANN001
    rows, expected = CASES[name]
    asked = {"nearest that is there": (None, "128", "blue"), "what is asked for": (None, "128", None), "the cheapest": ("b", None, None), "equal prices": ("b", None, None)}.get(name, (None, None, None))
    df = spark.createDataFrame([(*r[:10], *asked) for r in rows], DDL)
    chosen, options = selector.cascade(df, ["product"])
    (r,) = chosen.collect()
    assert (r.picked_model, r.picked_storage, r.picked_condition, r.picked_color) == expected
    said = {(o.dimension, o.option): (o.groups, o.min_price) for o in options.collect()}
    assert ("model", expected[0]) in said and not any(o is None for _, o in said)


MARKETS = [(("KSA", "SAR", "x.sa"), []), (("uae", "aed", "X.AE"), []), ((None, None, None), ["market-missing", "currency-missing"]), (("KSA", "AED", "a.com"), ["currency-market-mismatch"]), (("UAE", "AED", "a.sa"), ["host-market-mismatch"]), (("SA", "SAR", "a.sa"), ["host-market-mismatch"]), (("FR", "EUR", "a.fr"), [])]


def test_market_issues(spark):  # noqa: ANN001
    df = spark.createDataFrame([(*row, i) for i, (row, _) in enumerate(MARKETS)], "m string, c string, h string, i int")
    got = {r.i: r.x for r in df.select("i", coverage.market_issues(F.col("m"), F.col("c"), F.col("h")).alias("x")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(MARKETS)}


def test_only_a_whole_sitemap_says_that_something_is_absent(spark):  # noqa: ANN001
    indexed = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None), ("big", "1"), ("big", "2"), ("big", "3"), ("big", "4"), ("none", "1")], "source_id string, url string")
    observed = spark.createDataFrame([("a", "1"), ("a", "1"), ("big", "1")], "source_id string, url string")
    found = coverage.absent_from_sitemap(indexed, observed, "url", complete=True, most=3)
    assert [tuple(r) for r in found.collect()] == [("a", "2", "reverify")]
    assert coverage.absent_from_sitemap(indexed, observed, "url", complete=False).count() == 0


@pytest.mark.parametrize(("text", "found"), [("front load washing machine 8kg", "appliance"), ("hp 15 laptop sleeve", "accessory"), ("dyson airwrap", "beauty"), ("matte lipstick", "beauty"), ("cotton t shirt", "clothing"), ("cat litter 10l", "pet"), ("engine oil 5w30", "automotive"), ("duvet cover", "accessory"), ("desk lamp", "furniture"), ("led lamp", "home"), ("replacement battery for thinkpad", "accessory"), ("granite", None)])
def test_categories(text, found):  # noqa: ANN001
    assert matching.category_of(text) == found
