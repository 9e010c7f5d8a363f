"""Operators on offers: certainty, rank, newest observation, diversity, groups, facets, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.money import comparable_total
from quaylens.schema import BUCKETS, SPEC_FIELDS


def bucket(total: Column) -> Column:
    """How far an offer can be trusted. An unknown condition isn't new; an unknown destination isn't shippable."""
    return (
        F.when(F.col("can_ship_to_saudi").eqNullSafe(False) | F.col("availability").eqNullSafe("out_of_stock") | ~F.col("condition").eqNullSafe("new"), "ineligible")
        .when((F.col("match_confidence") < 0.9) | ~F.col("exact_match").eqNullSafe(True), "probable")
        .when(total.isNull() | ~F.col("can_ship_to_saudi").eqNullSafe(True) | ~F.col("availability").eqNullSafe("in_stock"), "incomplete")
        .when(F.col("price_confidence").eqNullSafe("estimated"), "estimated")
        .otherwise("confirmed")
    )


def enrich(offers: DataFrame) -> DataFrame:
    """Blanks foreign prices, and adds total_sar and bucket."""
    foreign = ~F.upper(F.trim(F.coalesce("currency", F.lit("")))).isin("", "SAR")
    out = offers.withColumn("original_price", F.when(foreign, F.col("product_price"))).withColumn("product_price", F.when(~foreign, F.col("product_price")))
    return out.withColumn("total_sar", comparable_total()).withColumn("bucket", bucket(F.col("total_sar")))


def rank_order(mode: str = "lowest") -> list[Column]:
    """The order of enriched offers: certainty, the mode's own key, total, price, confidence; unknown values last."""
    place = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(i)) for i, b in enumerate(BUCKETS)])
    own = {"lowest": [], "fastest": [F.col("delivery_days").asc_nulls_last()], "local": [F.coalesce("is_local", F.lit(False)).desc()]}[mode]
    return [place.asc(), *own, F.col("total_sar").asc_nulls_last(), F.col("product_price").asc_nulls_last(), F.coalesce("match_confidence", F.lit(0.0)).desc(), F.col("offer_id").asc()]


def rank(offers: DataFrame, mode: str = "lowest", by: list[str] | None = None) -> DataFrame:
    """Adds `rank` to the enriched offers of each group of columns `by`."""
    return enrich(offers).withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*rank_order(mode))))


def newest(offers: DataFrame, identity: list[str], position: list[str]) -> DataFrame:
    """One offer of each identity: the newest observation, a live one among equals, then the first. first_position is where the identity first stood."""
    w = Window.partitionBy(*identity)
    live = F.col("observed_at").isNotNull() & (F.col("data_kind") == "live")
    order = [F.col("observed_at").desc_nulls_last(), F.coalesce(live, F.lit(False)).desc(), *[F.col(p).asc() for p in position]]
    out = offers.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("first_position", F.min(position[0]).over(w))
    return out.where("_rn = 1").drop("_rn")


def tier() -> Column:
    c = F.coalesce("match_confidence", F.lit(0.0))
    return F.when(F.col("exact_match"), 3).when(c >= 0.65, 2).when(c > 0, 1).otherwise(0)


def cohorts(offers: DataFrame, gap: float = 0.12) -> DataFrame:
    """tier, match_confidence, cohort: within a tier a cohort reaches from its highest confidence to less than `gap` below.

    The fold runs over a tier's distinct confidences, which `diverse` rounds to two decimals: at most 101.
    """
    levels = offers.select(tier().alias("tier"), F.coalesce("match_confidence", F.lit(0.0)).alias("match_confidence")).distinct()
    listed = levels.groupBy("tier").agg(F.reverse(F.array_sort(F.collect_list("match_confidence"))).alias("l"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("n"), F.array().cast("array<struct<c:double,n:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        new = acc["top"].isNull() | (c <= acc["top"] - gap)
        n = acc["n"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, c).otherwise(acc["top"]).alias("top"), n.alias("n"), F.array_append(acc["out"], F.struct(c.alias("c"), n.alias("n"))).alias("out"))

    folded = listed.select("tier", F.explode(F.aggregate("l", start, step)["out"]).alias("x"))
    return folded.select("tier", F.col("x.c").alias("match_confidence"), F.col("x.n").alias("cohort"))


def diverse(offers: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first `limit` offers of each group in order of tier and cohort, merchants taking turns within a cohort; adds `place`.

    A merchant's own offers go by price where all of a cohort's have one currency, by confidence otherwise. Merchants take
    turns in the order in which they first come up: by confidence, then offer_id.
    """
    confidence = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan("match_confidence"), F.col("match_confidence")), F.lit(0.0)))) * 100 + 0.5) / 100
    base = offers.withColumn("match_confidence", confidence).withColumn("tier", tier())
    base = base.join(F.broadcast(cohorts(base)), ["tier", "match_confidence"])  # at most 4 x 101 rows, by the rounding
    own = Window.partitionBy(*by, "tier", "cohort", "merchant")
    one_currency = (F.min("currency").over(own) == F.max("currency").over(own)) & (F.count("currency").over(own) == F.count("*").over(own)) & F.min("currency").over(own).rlike("^[A-Z]{3}$")
    price = F.when(F.col("product_price") > 0, F.col("product_price"))
    base = base.withColumn("_key", F.when(one_currency, F.coalesce(price, F.lit(float("inf")))).otherwise(F.lit(0.0)))
    base = base.withColumn("_turn", F.row_number().over(own.orderBy("_key", F.desc("match_confidence"), "offer_id")))
    base = base.withColumn("_first", F.max(F.struct("match_confidence")).over(own)).withColumn("_first_id", F.min(F.struct(-F.col("match_confidence"), "offer_id")).over(own))
    order = Window.partitionBy(*by).orderBy(F.desc("tier"), "cohort", "_turn", "_first_id", "offer_id")
    return base.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_key", "_turn", "_first", "_first_id")


def summarize(offers: DataFrame, by: list[str]) -> DataFrame:
    e = enrich(offers)
    return e.groupBy(*by).agg(F.count("*").alias("offers"), F.countDistinct("merchant").alias("sources"), F.count_if(F.col("bucket") == "confirmed").alias("confirmed"), F.min(F.when(F.col("bucket") == "confirmed", F.col("total_sar"))).alias("best_confirmed"))


def facets(offers: DataFrame, key: str) -> DataFrame:
    return enrich(offers).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("facet")).agg(F.count("*").alias("offers"), F.countDistinct("merchant").alias("merchants"), F.min("product_price").alias("min_price"))


def relevance_band(offers: DataFrame, by: list[str]) -> DataFrame:
    """How many steps of 0.07 an exact offer's confidence lies below the best of its availability class."""
    closed = F.col("availability").eqNullSafe("out_of_stock") | F.col("can_ship_to_saudi").eqNullSafe(False)
    out = offers.withColumn("availability_class", F.when(closed, "unavailable").otherwise("available"))
    best = out.groupBy(*by, "availability_class").agg(F.coalesce(F.max(F.when(F.col("exact_match"), F.col("match_confidence"))), F.lit(0.0)).alias("_top"))
    out = out.join(best, [*by, "availability_class"])  # a row for each group; the offers stay where they are if that is small
    below = F.greatest(F.lit(0.0), F.col("_top") - F.coalesce("match_confidence", F.lit(0.0)))
    return out.withColumn("band", F.floor((below + 1e-10) / 0.07).cast("int")).drop("_top")


def profile(offers: DataFrame, by: list[str], fields: tuple[str, ...] = SPEC_FIELDS) -> DataFrame:
    """For each group and field the value that most merchants state (then most observations, the longest, the first by name), and whether others disagree."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f).alias("value")) for f in fields]))
    # equal statements of a merchant are counted first, so that the text work runs once for each
    # all steps are within a group, so its rows are dealt out once
    said = offers.select(*by, "merchant", *fields).repartition(*by).groupBy(*by, "merchant", *fields).agg(F.count("*").alias("_n"))
    rows = said.select(*by, "merchant", "_n", pairs.alias("p")).select(*by, "merchant", "_n", "p.field", "p.value").where("value is not null and value <> ''")
    rows = rows.withColumn("normal", F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", "")).where("normal <> ''")
    voices = rows.groupBy(*by, "field", "normal", "merchant").agg(F.sum("_n").alias("_n"), F.max(F.struct(F.length("value").alias("n"), "value")).alias("_v"))
    votes = voices.groupBy(*by, "field", "normal").agg(F.count("merchant").alias("sources"), F.sum("_n").alias("observations"), F.max("_v")["value"].alias("value"))
    w = Window.partitionBy(*by, "field")
    order = w.orderBy(F.desc("sources"), F.desc("observations"), F.desc(F.length("value")), "normal")
    return votes.withColumn("_rn", F.row_number().over(order)).withColumn("alternatives", F.count("*").over(w) - 1).where("_rn = 1").select(*by, "field", "value", "sources", "observations", (F.col("alternatives") > 0).alias("conflict"), "alternatives")


def families(offers: DataFrame) -> DataFrame:
    """Offers of one brand, name, storage and condition are a family whatever their colour."""
    key = F.concat_ws("|", F.lower("brand"), F.lower("category"), F.coalesce(F.lower("storage"), F.lit("")), "condition")
    e = enrich(offers).withColumn("family", key)
    return e.groupBy("family").agg(F.count("*").alias("offers"), F.countDistinct("merchant").alias("merchants"), F.countDistinct("color").alias("variants"), F.min_by("color", F.struct(F.coalesce("product_price", F.lit(float("inf"))), "color")).alias("default_variant"))


def intelligence(offers: DataFrame, by: list[str]) -> DataFrame:
    """How each offer's value stands to the lowest of its group, with badges and warnings."""
    e = enrich(offers).withColumn("value", F.coalesce("total_sar", "product_price"))
    w = Window.partitionBy(*by)
    base = F.min("value").over(w)
    delta = F.col("value") - base
    e = e.withColumn("baseline", base).withColumn("delta", delta).withColumn("delta_percent", F.when(base > 0, F.floor(delta / base * 1000 + 0.5) / 10))
    fastest = F.min("delivery_days").over(w)
    badges = F.array_compact(F.array(F.when(F.col("value") == base, "lowest"), F.when(F.col("delivery_days") == fastest, "fastest"), F.when(F.col("is_local"), "local")))
    warnings = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("shipping", "import_cost", "tax", "mandatory_fees")], F.when(~F.col("condition").eqNullSafe("new"), "condition")))
    return e.withColumn("badges", F.array_join(badges, ",")).withColumn("warnings", F.array_join(warnings, ","))


def variant_dimensions(offers: DataFrame) -> DataFrame:
    """offer_id, dimension, label: what tells an offer's variants apart, one row for each dimension that is known."""
    sources = {"model": "model_number", "storage": "storage", "color": "color", "condition": "condition", "sku": "sku"}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.trim(c).alias("label")) for k, c in sources.items()]))
    return offers.select("offer_id", rows.alias("d")).select("offer_id", "d.*").where("label is not null and label <> ''")


def presentation(groups: DataFrame, wanted_condition: str = "new") -> DataFrame:
    """Adds section and lane to groups of offers: groups of the principal kind in the wanted condition by category, all others as alternatives or accessories. groups: category, role, condition, match_confidence."""
    direct = (F.col("role") == "product") & (F.col("match_confidence") >= 0.35) & F.col("condition").eqNullSafe(wanted_condition)
    lane = F.when(direct, "primary").otherwise("secondary")
    section = F.when(direct, F.col("category")).when(F.col("role") == "accessory", "accessory").otherwise("alternative")
    return groups.withColumn("lane", lane).withColumn("section", section)
