"""What a query does once and not many times, seen in its plan."""

from __future__ import annotations

from quaylens import plans


def plan(spark, data, name):  # noqa: ANN001, ANN201
    return plans.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def above_join(text):  # noqa: ANN001, ANN201
    return text.split("Join Inner", 1)[0]


def test_pages_are_parsed_once(spark, data):  # noqa: ANN001
    assert plan(spark, data, "q_page_candidates").count("PageCandidates(") == 1


def test_listings_are_made_plain_before_they_meet(spark, data):  # noqa: ANN001
    above = above_join(plan(spark, data, "q_same_offer"))
    assert "site_a" in above and "regexp" not in above.lower() and "lower(" not in above


def test_words_are_compared_once_a_pair(spark, data):  # noqa: ANN001
    above = above_join(plan(spark, data, "q_conflicts"))
    assert above.count("array_intersect") == 1 and "array_distinct" not in above


def test_a_summary_gathers_no_fields(spark, data):  # noqa: ANN001
    assert "collect_set" not in plan(spark, data, "q_conflict_summary")


def test_an_address_is_taken_apart_once(spark, data):  # noqa: ANN001
    text = plan(spark, data, "q_identity_key")
    assert text.count("(?i)^(utm_") == 1 and text.count("^www") == 1


def test_a_profile_is_dealt_out_once(spark, data):  # noqa: ANN001
    text = plans.QUERIES["q_canonical_profile"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(product_id") == 1 == text.count("Exchange hashpartitioning")


def test_variants_are_compared_without_hashes(spark, data):  # noqa: ANN001
    assert "sha2" not in plan(spark, data, "q_variant_parity")


def test_groups_are_named_last(spark, data):  # noqa: ANN001
    assert plan(spark, data, "q_comparable_groups").count("hex(") == 2


def test_plain_prices_and_states_need_no_search(spark):  # noqa: ANN001
    from pyspark.sql import functions as F

    from quaylens.functions.money import parse_money
    from quaylens.functions.text import normalize_availability

    rows = spark.createDataFrame([("12",), ("12.5",), ("1.234",), ("In Stock",), (None,)], "v string")
    got = rows.select(parse_money(F.col("v")).alias("m"), normalize_availability(F.col("v")).alias("s"))
    assert [tuple(r) for r in got.collect()] == [(12.0, "unknown"), (12.5, "unknown"), (1234.0, "unknown"), (None, "in_stock"), (None, "unknown")]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert r"^\d+(\.\d{1,2})?$" in text and "= in stock" in text


def test_cards_are_made_and_read_once(spark, data):  # noqa: ANN001
    text = plan(spark, data, "q_source_nested_cards")
    assert text.count("master-product-card") == 1 == text.count("MapInArrow") and "variant" not in text.lower()


def test_groups_are_read_from_their_table(spark, data):  # noqa: ANN001
    # counting and then writing them doesn't go over the offers again
    text = plan(spark, data, "q_comparable_groups")
    assert "l_orderkey" not in text and text.count("Join Inner") == 1


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):  # noqa: ANN001
    import time

    from quaylens.sources.storage import written

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").count("shuffle_")
    before = files()
    table = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), f"{tmp_path}/t")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and len(table.collect()) == 7
