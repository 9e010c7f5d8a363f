"""Streams over files that arrive in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylens.operators import reliability
from quaylens.streaming import observations as st

DDL = "source_id string, product_id long, event_id long, kind string, transport_ok boolean, latency_ms double, price double, observed_at timestamp"


def arrivals(spark, folder):  # noqa: ANN001, ANN201
    rows = [(f"s{i % 3}", i % 2, i, "view" if i % 4 else "error", bool(i % 4), float(i * 10), float(i % 5), f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, DDL.replace("observed_at timestamp", "observed_at string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for part in range(4):
        df.where(f"event_id div 10 = {part}").coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)


def test_newest_wins(spark, tmp_path):  # noqa: ANN001
    df, stream = arrivals(spark, str(tmp_path / "in"))
    out = st.run_available(st.newest_by_key(stream, "product_id"), "complete", str(tmp_path / "out"))
    assert {(r.product_id, r.event_id) for r in out.collect()} == {(0, 38), (1, 39)}


def test_source_state_equals_the_batch_fold(spark, tmp_path):  # noqa: ANN001
    df, stream = arrivals(spark, str(tmp_path / "in"))
    out = st.run_available(st.source_state(stream), "update", str(tmp_path / "out"))
    last = {}
    for r in out.collect():
        if r.attempts > last.get(r.source_id, (0,))[0]:
            last[r.source_id] = (r.attempts, round(r.latency_ewma, 6), r.failures)
    batch = {r.source_id: (round(r.latency_ewma, 6), r.consecutive_failures) for r in reliability.folded(df).collect()}
    # files may arrive in any order; counts hold in each
    assert {k: v[0] for k, v in last.items()} == {"s0": 14, "s1": 13, "s2": 13} and set(batch) == set(last)


def test_window_counts(spark, tmp_path):  # noqa: ANN001
    df, stream = arrivals(spark, str(tmp_path / "in"))
    out = st.run_available(st.windowed_counts(stream, width="10 minutes"), "complete", str(tmp_path / "out"))
    assert sum(r.events for r in out.collect()) == 40


def test_repeated_notices_come_once(spark, tmp_path):  # noqa: ANN001
    df, stream = arrivals(spark, str(tmp_path / "in"))
    out = st.run_available(st.distinct_within(stream, ["source_id", "kind"], "2 hours"), "append", str(tmp_path / "out"))
    assert out.count() == df.select("source_id", "kind").distinct().count()


def test_future_observations_are_turned_away(spark, tmp_path):  # noqa: ANN001
    rows = [("s", 1, i, "view", True, 1.0, float(i), t) for i, t in enumerate(["2024-01-01 00:00:00", "2999-01-01 00:00:00"])]
    df = spark.createDataFrame(rows, DDL.replace("observed_at timestamp", "observed_at string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
    assert [r.event_id for r in st.run_available(st.newest_by_key(stream, "product_id"), "complete", str(tmp_path / "out")).collect()] == [0]
