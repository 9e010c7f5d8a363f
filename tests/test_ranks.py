"""Places within large groups, limits that reach the tasks, and the longest common subsequence."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quaylens import plans
from quaylens.functions.text import common_length, fuzzy_ratio
from quaylens.operators import audit
from quaylens.operators.ranks import ranked


def plan_of(df):  # noqa: ANN001, ANN201
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_those_of_a_window(spark):  # noqa: ANN001
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = ranked(df, ["g"], [F.desc("v"), F.asc("id")]).collect()
    assert len(got) == 3000 and got[0].asDict().keys() == {"g", "v", "id", "place"}
    for g in ("hot", "cold", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == [r[2] for r in order]
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(order) + 1))


def test_a_hot_group_lies_in_several_ranges(spark):  # noqa: ANN001
    laid = spark.range(20_000).withColumn("g", F.lit(1)).repartitionByRange(4, "g", "id").withColumn("p", F.spark_partition_id())
    assert laid.select("p").distinct().count() == 4


def test_limits_reach_the_tasks(spark, data):  # noqa: ANN001
    for name in ("q_page_plan", "q_catalog_windows", "q_slowest_calls", "q_discovery_sections"):
        assert "WindowGroupLimit" in plan_of(plans.QUERIES[name](spark, data)), name
    assert "Window" not in plan_of(plans.QUERIES["q_lanes"](spark, data)).split("Exchange")[0]


def test_a_matrix_is_one_aggregation(spark):  # noqa: ANN001
    rows = spark.createDataFrame([("a", 1, True, 5.7, 1), ("a", 2, False, None, 2), ("b", 1, None, 9.2, 3)], "s string, r int, transport_ok boolean, latency_ms double, event_id int")
    out = audit.matrix(rows, [["s", "r"], ["s"], []])
    assert "Expand" in plan_of(out) and plan_of(out).count("Exchange hashpartitioning") == 1
    got = {(r.s, r.r): (r.calls, r.passed, r.total_ms, r.slowest_ms) for r in out.collect()}
    assert got == {("a", 1): (1, 1, 5, 5), ("a", 2): (1, 0, None, None), ("b", 1): (1, 0, 9, 9), ("a", None): (2, 1, 5, 5), ("b", None): (1, 0, 9, 9), (None, None): (3, 1, 14, 9)}
    assert sorted(r.event_id for r in audit.slowest(rows, ["s"], 1).collect()) == [1, 3]


def plain(a, b):  # noqa: ANN001, ANN201
    row = [0] * (len(b) + 1)
    for x in a:
        held = 0
        for j, y in enumerate(b):
            held, row[j + 1] = row[j + 1], (held + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_common_length_is_that_of_the_plain_recurrence(spark):  # noqa: ANN001
    rng = random.Random(3)
    texts = ["", "a", "kitten", "sitting", *["".join(rng.choice("abcdé漢") for _ in range(rng.randrange(90))) for _ in range(60)]]
    assert all(common_length(a, b) == plain(a, b) for a in texts for b in texts[::3])
    pairs = spark.createDataFrame([("kitten", "sitting"), (None, ""), ("a", None), ("ab", "ba")], "a string, b string")
    assert [r[0] for r in pairs.select(fuzzy_ratio("a", "b")).collect()] == [800 / 13, 100.0, 0.0, 50.0]
