"""What offers around a console sell."""

from __future__ import annotations

import pytest

from quaylens.operators.described import COLUMNS, asked_kind, describe, of_asked_kind

DDL = "offer_id int, title string, model_number string, storage string, source_url string, kind string, _text string"
#: title, model number, address, kind, whether a bundle
CASES = [
    ("Sony PlayStation 5 Slim Disc with Extra Dualsense White Controller + Black Myth: Wukong -International Version", None, None, "console", True),
    ("Sony PS5 Slim Digital with Additional DualSense Controller", None, None, "console", True),
    ("Sony PS5 Pro Disc with DualSense Controller", None, None, "console", True),
    ("PS5 Slim Disc Drive with Extra DualSense Controller", None, None, "accessory", False),
    ("PS5 Slim Disc Cover with Controller", None, None, "accessory", False),
    ("Protective case for PS5 Slim Disc with controller", None, None, "accessory", False),
    ("PS5 Slim Disc game with controller", None, None, "accessory", False),
    ("PS5 Slim Console Hub with Controller", None, None, "accessory", False),
    ("PS5 Slim Disc SSD with controller", None, None, "accessory", False),
    ("PS5 Slim Disc with controller stand", None, None, "accessory", False),
    ("PS5 Console White + DualSense Controller", None, None, "console", True),
    ("PS5 Console Cover + Controller", None, None, "accessory", False),
    ("PS5 Console Hub Bundle with Charger", None, None, "accessory", True),
    ("PS5 Console with Disc Drive", None, None, "console", True),
    ("NVMe SSD heatsink for PS5", "CFI-2016", None, "accessory", False),
    ("Sony PS5 Slim 825 GB Bundle DualSense Controller", "CFI-2016", None, "console", True),
    ("Sony PS5 Slim 825 GB Bundle DualSense Controller", None, None, "accessory", True),
    ("Sony PS5 Slim", None, None, "console", False),
    ("PS5 Digital Edition 1 TB", None, None, "console", False),
    ("Spider Man 2 PS5", None, None, "game", False),
    ("PS5 console stories, video game", None, None, "game", False),
    ("Racing 1TB PS4", None, "https://shop.example.com/playstation-games/7", "game", False),
    ("Nintendo Switch 2 console", None, None, "console", False),
    ("غطاء ps5", None, None, "accessory", False),
    ("Cordless drill 18 V", None, None, "product", False),
    ("", None, None, "product", False),
    (None, None, None, "product", False),
]


def frame(spark, cases):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, c[0], c[1], None, c[2], "own", "clash") for i, c in enumerate(cases)], DDL)


def test_kinds(spark):  # noqa: ANN001
    got = {r.offer_id: r for r in describe(frame(spark, CASES)).collect()}
    assert [(c[0], got[i].kind, got[i].is_bundle) for i, c in enumerate(CASES)] == [(c[0], c[3], c[4]) for c in CASES]


def test_edition_size_and_form(spark):  # noqa: ANN001
    rows = [(0, "PlayStation 5 Slim Digital 825 GB", None, None, None), (1, "PS5 Pro Disc", None, "2 TB", None), (2, "Xbox Series X 1TB console", None, None, None), (3, None, None, None, None)]
    got = describe(spark.createDataFrame(rows, "offer_id int, title string, model_number string, storage string, source_url string")).orderBy("offer_id").collect()
    assert [(r.platform, r.edition, r["size"], r.form) for r in got] == [("ps5", "digital", "825gb", "Slim"), ("ps5", "disc", "2tb", "Pro"), ("xbox series x", None, "1tb", ""), (None, None, None, "")]


def test_very_long_repeated_and_no_rows(spark):  # noqa: ANN001
    long = "PS5 console " + "very " * 40_000 + "big"
    out = describe(frame(spark, [(long, None, None), (long, None, None)]))
    assert [r.kind for r in out.collect()] == ["console", "console"] and set(COLUMNS) <= set(out.columns)
    assert describe(frame(spark, CASES).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("query", "kind"),
    [("ps5", "console"), ("ps5 slim digital 1tb", "console"), ("ps5 dualsense bundle", "console"), ("ps5 controller", "accessory"), ("ps5 console with controller", "console"), ("ps5 ssd", "accessory"), ("ps5 spider man", "game"), ("ps4 games", "game"), ("red widget", None)],
)
def test_asked_kinds(query, kind):  # noqa: ANN001
    assert asked_kind(query) == kind


def test_offers_of_the_asked_kind(spark):  # noqa: ANN001
    rows = frame(spark, CASES)
    kept = {r.title for r in of_asked_kind(rows, "ps5").collect()}
    assert kept == {c[0] for c in CASES if c[3] == "console" and "Nintendo" not in c[0]}
    assert of_asked_kind(rows, "red widget").count() == len(CASES)


def test_what_a_pattern_needs_stands_in_all_that_it_matches(spark):  # noqa: ANN001
    import itertools
    import re._parser as parser

    from quaylens.operators import described as ds

    def said(items):  # noqa: ANN001, ANN202
        """Texts that a pattern matches: every branch, options and repeats at their fewest, a class by its first member."""
        out = [""]
        for op, arg in items:
            name, more = str(op), [""]
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "BRANCH":
                more = [t for b in arg[1] for t in said(b)]
            elif name == "SUBPATTERN":
                more = said(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more = said(arg[2]) if arg[0] else [""]
            elif name == "IN":
                first = arg[0]
                more = [chr(first[1])] if str(first[0]) == "LITERAL" else [" " if "SPACE" in str(first[1]) else "1" if "DIGIT" in str(first[1]) else "a"]
            out = [a + b for a, b in itertools.product(out, more)]
        return out

    for pattern, words in ds.NEEDS.items():
        assert all(any(w in t for w in words) for t in said(parser.parse(pattern))), pattern
    # and a title's projections aren't one method
    plan = describe(frame(spark, CASES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bundle\\b),") <= 1 and "exists(" in plan
