"""Operators that audit sources: rules per offer, accounting, certification, extraction scores, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of an extraction strategy's score.
SCORE_WEIGHTS = {"correctness": 0.25, "completeness": 0.18, "stability": 0.15, "speed": 0.12, "repeatability": 0.1, "maintainability": 0.1, "resource_cost": 0.1}
# What a source must reach to be certified.
CERTIFIED_SCORE, CERTIFIED_SHARE, CERTIFIED_VARIANTS = 70, 0.99, 0.995


def violations() -> Column:
    """Why an offer can't be published."""
    rules = {
        "missing_title": F.col("title").isNull() | (F.length(F.trim("title")) < 3),
        "missing_price": F.col("product_price").isNull() | ~(F.col("product_price") > 0),
        "foreign_currency": F.col("currency") != "SAR",
        "bad_url": ~F.col("source_url").rlike("^https://[^/@]+/"),
        "unknown_condition": ~F.col("condition").isin("new", "used", "refurbished", "open_box"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def warnings() -> Column:
    return F.array_compact(F.array(F.when(F.col("shipping").isNull(), "shipping_unknown"), F.when(F.col("availability") == "unknown", "availability_unknown"), F.when(F.col("delivery_days").isNull(), "delivery_unknown")))


def account(offers: DataFrame, by: str, identity: list[str]) -> DataFrame:
    """raw = accepted + rejected + duplicates, for each source."""
    w = Window.partitionBy(by, *identity).orderBy("offer_id")
    rows = offers.withColumn("_bad", F.size(violations()) > 0).withColumn("_again", F.row_number().over(w) > 1)
    return rows.groupBy(by).agg(F.count("*").alias("raw"), F.count_if(F.col("_bad")).alias("rejected"), F.count_if(~F.col("_bad") & F.col("_again")).alias("duplicates"), F.count_if(~F.col("_bad") & ~F.col("_again")).alias("accepted"))


def certify(evidence: DataFrame) -> DataFrame:
    """Adds failed (the checks that a source doesn't stand), passed and state to eleven pieces of evidence; a missing piece fails.

    evidence: reachable, strategy_score, critical_field_coverage, price_validity, currency_verified, market_verified,
    search_passed, pagination_passed, variant_accuracy, semantic_critical_issues (missing: none), repeatability_passed.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    least = lambda c, n: F.coalesce(F.col(c), F.lit(0.0)) >= n
    checks = {
        "reachable": yes("reachable"),
        "extraction_candidate": least("strategy_score", CERTIFIED_SCORE),
        "critical_fields": least("critical_field_coverage", CERTIFIED_SHARE),
        "price_validity": least("price_validity", CERTIFIED_SHARE),
        "currency_verified": yes("currency_verified"),
        "market_verified": yes("market_verified"),
        "search_passed": yes("search_passed"),
        "pagination_passed": yes("pagination_passed"),
        "variant_accuracy": least("variant_accuracy", CERTIFIED_VARIANTS),
        "semantic_issues": F.coalesce(F.col("semantic_critical_issues"), F.lit(0)) == 0,
        "repeatability_passed": yes("repeatability_passed"),
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    out = evidence.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)
    probed = ~F.arrays_overlap("failed", F.array(F.lit("reachable"), F.lit("extraction_candidate")))
    state = F.when(F.col("passed"), "CERTIFIED").when(probed, "CANDIDATE").when(~F.array_contains("failed", "reachable"), "PROBED").otherwise("DISCOVERED")
    return out.withColumn("state", state)


def extraction_score() -> Column:
    """Seven shares, weighted, out of 100 with two decimals; a missing or impossible share counts as none."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))))
    return F.floor(sum((clamp(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0)) * 10000 + 0.5) / 100


def next_sample_size(tested: Column, consistent: Column) -> Column:
    """How many to test next; null when enough have been."""
    more = F.when(tested < 5, 5).when(consistent & (tested >= 10), F.lit(None)).when(tested < 10, 10).when(tested < 20, 20).when(tested < 50, 50)
    settled = consistent & (tested >= 10)
    return F.when(settled, F.lit(None).cast("int")).otherwise(F.coalesce(more, F.when(consistent, F.lit(None)).otherwise(100)).cast("int"))


def repeatability(runs: DataFrame, by: str, value: str) -> DataFrame:
    spread = (F.max(value) - F.min(value)) / F.avg(value)
    return runs.groupBy(by).agg(F.count("*").alias("runs"), spread.alias("spread")).withColumn("repeatable", F.col("spread") <= 0.15)


def matrix(calls: DataFrame, sets: list[list[str]]) -> DataFrame:
    """calls, passed, total_ms, slowest_ms for each cell of each set of columns (the empty set: over all), in one aggregation; columns that a set lacks are null.

    Each task adds up its rows for each set before anything is shuffled.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    ms = F.floor("latency_ms").cast("long")
    grouped = calls.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.count("*").alias("calls"), F.count_if("transport_ok").alias("passed"), F.sum(ms).alias("total_ms"), F.max(ms).alias("slowest_ms")).select(*columns, "calls", "passed", "total_ms", "slowest_ms")


def slowest(calls: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The slowest calls of each group with their place; each task keeps its own `most` before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("latency_ms").desc_nulls_last(), "event_id")
    return calls.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
