"""Newest wins over many batches: outcomes, conflicts, and state that doesn't grow."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from quaylens.operators import reliability
from quaylens.streaming import latest
from quaylens.streaming import observations as st
from quaylens.streaming import quotes as sq

DDL = "product_id long, event_id long, observed_at timestamp, price double"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):  # noqa: ANN001, ANN201
    before = {k: spark.conf.get(k, None) for k in sq.STORE}
    for k, v in sq.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arriving(spark, folder, parts):  # noqa: ANN001, ANN201
    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], DDL).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_outcomes_are_those_of_the_batch(spark, tmp_path, store):  # noqa: ANN001
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, T0 + timedelta(minutes=i // 20 * 10 + rng.randrange(4) * 5), float(rng.randrange(2)) if rng.random() < 0.9 else None) for i in range(120)]
    stream = arriving(spark, str(tmp_path / "in"), [rows[i : i + 30] for i in range(0, 120, 30)])
    got = st.run_available(latest.newest_with_outcomes(stream, "product_id", "10 hours"), "append", str(tmp_path / "out")).collect()
    batch = reliability.revisions(spark.createDataFrame(rows, DDL), "product_id").collect()
    assert sorted((r.event_id, r.outcome, r.revision) for r in got) == sorted((r.event_id, r.outcome, r.revision) for r in batch)
    assert {r.outcome for r in got} == {"accepted", "rejected_older", "duplicate", "equal_time_conflict"}


def test_state_stays_bounded(spark, tmp_path, store):  # noqa: ANN001
    """Each batch brings new keys, three hours later; of each, state is kept for an hour."""
    parts = [[(100 * b + i, 100 * b + i, T0 + timedelta(hours=3 * b), 1.0) for i in range(50)] for b in range(8)]
    stream = arriving(spark, str(tmp_path / "in"), parts)
    out = latest.newest_with_outcomes(stream, "product_id", "10 minutes", 3600)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).where("outcome = 'accepted'").count() == 400
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(held) >= 8 and max(held[3:]) <= max(held[:3])


def test_a_key_that_was_forgotten_starts_anew(spark, tmp_path, store):  # noqa: ANN001
    parts = [[(1, 1, T0, 1.0)], [(2, 2, T0 + timedelta(days=5), 1.0)], [(2, 3, T0 + timedelta(days=5, hours=1), 1.0)], [(1, 4, T0 + timedelta(days=5, hours=2), 1.0), (None, 5, T0 + timedelta(days=5, hours=2), 1.0)]]
    got = st.run_available(latest.newest_with_outcomes(arriving(spark, str(tmp_path / "in"), parts), "product_id"), "append", str(tmp_path / "out")).collect()
    assert {(r.event_id, r.outcome, r.revision) for r in got} == {(1, "accepted", 1), (2, "accepted", 1), (3, "accepted", 2), (4, "accepted", 1)}
