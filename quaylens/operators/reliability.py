"""Operators on streams of source calls: smoothed rates, latencies, cooldowns, price histories, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the smoothing: prior successes and failures of transport and of yield, the share of a new latency, the cooldown.
TRANSPORT_PRIOR, YIELD_PRIOR, FRESH_SHARE = (8, 2), (3, 3), 0.28
COOLDOWN_AFTER, COOLDOWN_SECONDS, COOLDOWN_MOST = 3, 120, 1800


def rates(calls: DataFrame) -> DataFrame:
    """attempts, transport, yield, reliability, confidence and adjustment of each source. calls: source_id, transport_ok, offers."""
    ok = F.col("transport_ok")
    out = calls.groupBy("source_id").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("good"), F.count_if(ok & (F.col("offers") > 0)).alias("productive"), F.count_if(ok & (F.coalesce("offers", F.lit(0)) <= 0)).alias("empty"))
    transport = (F.col("good") + TRANSPORT_PRIOR[0]) / (F.col("attempts") + sum(TRANSPORT_PRIOR))
    productive = (F.col("productive") + YIELD_PRIOR[0]) / (F.col("productive") + F.col("empty") + sum(YIELD_PRIOR))
    out = out.withColumn("transport", transport).withColumn("yield", productive)
    out = out.withColumn("reliability", F.col("transport") * 0.78 + F.col("yield") * 0.22).withColumn("confidence", F.least(F.lit(1.0), F.col("attempts") / 12))
    return out.withColumn("adjustment", F.floor((F.col("reliability") - 0.7) * 36 * F.col("confidence") + 0.5).cast("int"))


def folded(calls: DataFrame) -> DataFrame:
    """latency_ewma, consecutive_failures and cooldown_seconds of each source after its last call.

    The average is a sum: a latency that n later ones follow has the weight s * (1 - s)^n (the first one (1 - s)^n). Its
    place is counted within its hour, and the hours' counts are added up, so that no task needs a source's calls together.
    Failures in a row are those after the last success.
    """
    hour = F.date_trunc("hour", F.col("observed_at").cast("timestamp"))
    known = calls.where("latency_ms >= 0").select("source_id", hour.alias("hour"), "observed_at", "event_id", "latency_ms")
    counts = known.groupBy("source_id", "hour").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_id").orderBy(F.desc("hour"))
    later = counts.withColumn("later", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("source_id")))
    within = F.row_number().over(Window.partitionBy("source_id", "hour").orderBy(F.desc("observed_at"), F.desc("event_id"))) - 1
    placed = known.withColumn("after", within).join(later.select("source_id", "hour", "later", "total"), ["source_id", "hour"]).withColumn("after", F.col("after") + F.col("later"))
    weight = F.pow(F.lit(1 - FRESH_SHARE), F.col("after")) * F.when(F.col("after") == F.col("total") - 1, 1.0).otherwise(FRESH_SHARE)
    average = placed.groupBy("source_id").agg(F.sum(weight * F.col("latency_ms")).alias("latency_ewma"))

    at = F.struct("observed_at", "event_id")
    last = calls.groupBy("source_id").agg(F.max(F.when(F.col("transport_ok"), at)).alias("last_ok"))
    failed = calls.where("not transport_ok").join(last, "source_id").where(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    row = failed.groupBy("source_id").agg(F.count("*").alias("consecutive_failures"))
    out = last.select("source_id").join(average, "source_id", "left").join(row, "source_id", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)).cast("int"))
    wait = F.when(F.col("consecutive_failures") >= COOLDOWN_AFTER, F.least(F.lit(float(COOLDOWN_MOST)), COOLDOWN_SECONDS * F.pow(F.lit(2.0), F.col("consecutive_failures") - COOLDOWN_AFTER))).otherwise(0.0)
    return out.withColumn("cooldown_seconds", wait)


def health(metrics: DataFrame) -> DataFrame:
    """Adds state and ingest to consecutive_failures, success_rate, price_validity and quarantined; what is missing counts as fine."""
    fails = F.coalesce("consecutive_failures", F.lit(0))
    success, price = (F.coalesce(c, F.lit(1.0)) for c in ("success_rate", "price_validity"))
    state = (
        F.when(F.coalesce("quarantined", F.lit(False)), "QUARANTINED")
        .when((fails >= 3) | (success < 0.5) | (price < 0.9), "CIRCUIT_OPEN")
        .when((fails > 0) | (success < 0.9) | (price < 0.99), "DEGRADED")
        .otherwise("HEALTHY")
    )
    return metrics.withColumn("state", state).withColumn("ingest", F.col("state").isin("HEALTHY", "DEGRADED"))


def routing(calls: DataFrame) -> DataFrame:
    """Sources in the order in which to ask them: reliability, yield, speed and evidence multiplied."""
    both = rates(calls).join(folded(calls), "source_id")
    speed = 1 / (1 + F.greatest(F.lit(0.0), F.coalesce("latency_ewma", F.lit(1800.0))) / 1800)
    score = F.col("reliability") * (0.45 + F.col("yield") * 0.55) * speed * (0.35 + F.col("confidence") * 0.65)
    out = both.withColumn("routing_score", F.floor(score * 1e6 + 0.5) / 1e6)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("routing_score"), "source_id")))  # a row for each source


def price_islands(observations: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one price: from when to when, and how many observations."""
    w = Window.partitionBy(*by).orderBy("observed_at", "event_id")
    changed = (~F.col("price").eqNullSafe(F.lag("price").over(w))) | (F.row_number().over(w) == 1)
    runs = observations.withColumn("island", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "island").agg(F.first("price").alias("price"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("observations"))


def price_stats(observations: DataFrame, by: list[str]) -> DataFrame:
    """Lowest, highest, first and latest price, the last other price before it, and where it is heading."""
    islands = price_islands(observations, by)
    w = Window.partitionBy(*by).orderBy("island")
    rows = islands.withColumn("previous", F.lag("price").over(w))
    out = rows.groupBy(*by).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("price", "island").alias("first_price"), F.max_by("price", "island").alias("latest"), F.max_by("previous", "island").alias("previous"), (F.count("*") - 1).alias("changes"))
    delta = F.col("latest") - F.col("previous")
    return out.withColumn("delta", delta).withColumn("direction", F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"))


def failure_matrix(calls: DataFrame) -> DataFrame:
    return calls.groupBy("source_id", "kind").agg(F.count("*").alias("events"))


def revisions(observations: DataFrame, key: str) -> DataFrame:
    """What becomes of each observation as it arrives in order of event_id: accepted, duplicate, equal_time_conflict or rejected_older; accepted ones count up."""
    w = Window.partitionBy(key).orderBy("event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("observed_at").over(before)
    held = F.max(F.struct("observed_at", (-F.col("event_id")).alias("n"), "price")).over(before)
    outcome = F.when(newest.isNull() | (F.col("observed_at") > newest), "accepted").when(F.col("observed_at") < newest, "rejected_older").when(held["price"].eqNullSafe(F.col("price")), "duplicate").otherwise("equal_time_conflict")
    out = observations.withColumn("outcome", outcome)
    return out.withColumn("revision", F.sum((F.col("outcome") == "accepted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
