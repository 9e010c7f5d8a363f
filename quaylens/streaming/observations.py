"""Observations as streams: newest wins, counts by window, repeated notices once, source state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.operators.reliability import COOLDOWN_AFTER, COOLDOWN_MOST, COOLDOWN_SECONDS, FRESH_SHARE
from quaylens.sources.storage import shared_root


def not_ahead(stream: DataFrame, seconds: int = 60) -> DataFrame:
    """Observations whose time is at most a minute ahead of the clock."""
    return stream.where(F.col("observed_at") <= F.current_timestamp() + F.expr(f"interval {seconds} seconds"))


def newest_by_key(stream: DataFrame, key: str) -> DataFrame:
    """The newest observation of each key so far, one row of state a key. Observations from the future are turned away."""
    return not_ahead(stream).groupBy(key).agg(F.max(F.struct("observed_at", "event_id", "price")).alias("x")).select(key, "x.observed_at", "x.event_id", "x.price")


def distinct_within(stream: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Of notices that repeat within the watermark's delay the first; state older than the watermark goes."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "kind").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "kind", "events")


def source_state(stream: DataFrame) -> DataFrame:
    """source_id, attempts, latency_ewma, failures, cooldown_seconds after every batch: a fold that keeps a few numbers per source."""
    out = "source_id string, attempts long, latency_ewma double, failures long, cooldown_seconds double"
    kept = "attempts long, latency_ewma double, failures long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        attempts, ewma, failures = state.get if state.exists else (0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["observed_at", "event_id"])
        for latency, ok in zip(rows["latency_ms"], rows["transport_ok"], strict=True):
            attempts += 1
            if latency == latency and latency >= 0:
                ewma = float(latency) if ewma is None or ewma != ewma else ewma * (1 - FRESH_SHARE) + latency * FRESH_SHARE
            failures = 0 if ok else failures + 1
        state.update((attempts, ewma, failures))
        wait = min(COOLDOWN_MOST, COOLDOWN_SECONDS * 2.0 ** (failures - COOLDOWN_AFTER)) if failures >= COOLDOWN_AFTER else 0.0
        yield pd.DataFrame({"source_id": [key[0]], "attempts": [attempts], "latency_ewma": [ewma], "failures": [failures], "cooldown_seconds": [float(wait)]})

    return stream.groupBy("source_id").applyInPandasWithState(step, out, kept, "update", "NoTimeout")


def run_available(result: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, into files of the shared folder, and reads them back.

    In append mode the files are the stream's own sink; in complete and update mode every batch is written to a folder of
    its own, and the result is the last one (complete) or all of them (update).
    """
    spark = result.sparkSession
    base = f"{root or shared_root(spark)}/stream-{uuid.uuid4().hex}"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{base}/rows")
    batches: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/{batch}")  # a batch that runs again replaces its rows
        if batch not in batches:
            batches.append(batch)

    writer.foreachBatch(keep).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], result.schema)
    wanted = batches[-1:] if mode == "complete" else batches
    return spark.read.schema(result.schema).parquet(*[f"{base}/rows/{b}" for b in wanted])
