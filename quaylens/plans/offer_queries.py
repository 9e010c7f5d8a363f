"""Queries over offers, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.functions import text as tx
from quaylens.functions.money import comparable_total, half_up, parse_money, strict_price, to_riyal
from quaylens.operators import coverage as cov
from quaylens.operators import offers as op
from quaylens.operators.ranks import ranked
from quaylens.plans.registry import query
from quaylens.sources.views import OFFERS_SQL, offers, table

_TOTAL = """CASE WHEN currency = 'SAR' AND product_price IS NOT NULL AND shipping IS NOT NULL AND import_cost IS NOT NULL AND tax IS NOT NULL AND mandatory_fees IS NOT NULL
  THEN greatest(0e0, product_price + shipping + import_cost + tax + mandatory_fees - coalesce(discount, 0e0)) END"""
_BUCKET = """CASE WHEN can_ship_to_saudi IS NOT DISTINCT FROM false OR availability = 'out_of_stock' OR condition <> 'new' THEN 'ineligible'
  WHEN match_confidence < 0.9e0 OR NOT exact_match THEN 'probable'
  WHEN total_sar IS NULL OR can_ship_to_saudi IS DISTINCT FROM true OR availability <> 'in_stock' THEN 'incomplete'
  WHEN price_confidence = 'estimated' THEN 'estimated' ELSE 'confirmed' END"""
ENRICHED = f"""{OFFERS_SQL}, totals AS (SELECT * REPLACE (CASE WHEN currency = 'SAR' THEN product_price END AS product_price), {_TOTAL} AS total_sar FROM offers),
enriched AS (SELECT *, {_BUCKET} AS bucket FROM totals)"""
_PLACE = "CASE bucket WHEN 'confirmed' THEN 0 WHEN 'estimated' THEN 1 WHEN 'probable' THEN 2 WHEN 'incomplete' THEN 3 ELSE 4 END"


def _ranked_sql(own: str) -> str:
    return f"""{ENRICHED} SELECT product_id, offer_id, bucket, total_sar, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_PLACE}, {own} total_sar ASC NULLS LAST, product_price ASC NULLS LAST, match_confidence DESC, offer_id) AS rank FROM enriched) WHERE rank <= 3"""


@query("q_comparable_total", f"{OFFERS_SQL} SELECT offer_id, {_TOTAL} AS total FROM offers")
def comparable_totals(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", comparable_total().alias("total"))


@query("q_classify_bucket", f"{ENRICHED} SELECT bucket, market, count(*) AS offers, count(total_sar) AS with_total FROM enriched GROUP BY bucket, market")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return op.enrich(offers(spark, d)).groupBy("bucket", "market").agg(F.count("*").alias("offers"), F.count("total_sar").alias("with_total"))


def _ranked(mode: str):  # noqa: ANN202
    return lambda spark, d: op.rank(offers(spark, d), mode, ["product_id"]).where("rank <= 3").select("product_id", "offer_id", "bucket", "total_sar", "rank")


query("q_rank_lowest", _ranked_sql(""))(_ranked("lowest"))
query("q_rank_fastest", _ranked_sql("delivery_days ASC NULLS LAST,"))(_ranked("fastest"))
query("q_rank_local", _ranked_sql("is_local DESC,"))(_ranked("local"))


@query(
    "q_dedupe_newest",
    f"""{OFFERS_SQL} SELECT product_id, merchant, condition, offer_id, observed_at, first_position FROM (SELECT *, min(offer_id) OVER (PARTITION BY product_id, merchant, condition) AS first_position,
      row_number() OVER (PARTITION BY product_id, merchant, condition ORDER BY observed_at DESC NULLS LAST, (data_kind = 'live') DESC, offer_id) AS rn FROM offers) WHERE rn = 1""",
)
def dedupe_newest(spark: SparkSession, d: str) -> DataFrame:
    return op.newest(offers(spark, d), ["product_id", "merchant", "condition"], ["offer_id"]).select("product_id", "merchant", "condition", "offer_id", "observed_at", "first_position")


@query(
    "q_merge_newest_by_url",
    f"{OFFERS_SQL} SELECT source_url, max(observed_at) AS observed_at, arg_max(offer_id, struct_pack(a := observed_at, b := offer_id)) AS offer_id FROM offers GROUP BY source_url",
)
def merge_newest(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("source_url").agg(F.max("observed_at").alias("observed_at"), F.max_by("offer_id", F.struct("observed_at", "offer_id")).alias("offer_id"))


@query(
    "q_summary",
    f"{ENRICHED} SELECT category, count(*) AS offers, count(DISTINCT merchant) AS sources, count(*) FILTER (bucket = 'confirmed') AS confirmed, min(total_sar) FILTER (bucket = 'confirmed') AS best_confirmed FROM enriched GROUP BY category",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    return op.summarize(offers(spark, d), ["category"])


@query("q_facets", f"{ENRICHED} SELECT color AS facet, count(*) AS offers, count(DISTINCT merchant) AS merchants, min(product_price) AS min_price FROM enriched WHERE color IS NOT NULL GROUP BY color")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return op.facets(offers(spark, d), "color")


@query(
    "q_relevance_band",
    f"""{OFFERS_SQL}, c AS (SELECT *, CASE WHEN availability = 'out_of_stock' OR can_ship_to_saudi IS NOT DISTINCT FROM false THEN 'unavailable' ELSE 'available' END AS availability_class FROM offers),
    t AS (SELECT *, coalesce(max(CASE WHEN exact_match THEN match_confidence END) OVER (PARTITION BY category, availability_class), 0e0) AS top FROM c)
    SELECT offer_id, availability_class, CAST(floor((greatest(0e0, top - match_confidence) + 1e-10) / 0.07e0) AS INT) AS band FROM t""",
)
def relevance_band(spark: SparkSession, d: str) -> DataFrame:
    return op.relevance_band(offers(spark, d), ["category"]).select("offer_id", "availability_class", "band")


@query(
    "q_diverse_selection",
    f"""{OFFERS_SQL.replace("WITH offers", "WITH RECURSIVE offers")}, t AS (SELECT *, CASE WHEN exact_match THEN 3 WHEN match_confidence >= 0.65e0 THEN 2 WHEN match_confidence > 0 THEN 1 ELSE 0 END AS tier FROM offers),
    lv AS (SELECT tier, match_confidence AS c, row_number() OVER (PARTITION BY tier ORDER BY match_confidence DESC) AS i FROM (SELECT DISTINCT tier, match_confidence FROM t)),
    co(tier, i, c, top, cohort) AS (SELECT tier, i, c, c, 0 FROM lv WHERE i = 1
      UNION ALL SELECT lv.tier, lv.i, lv.c, CASE WHEN lv.c <= co.top - 0.12e0 THEN lv.c ELSE co.top END, co.cohort + CASE WHEN lv.c <= co.top - 0.12e0 THEN 1 ELSE 0 END FROM co JOIN lv ON lv.tier = co.tier AND lv.i = co.i + 1),
    b AS (SELECT t.*, co.cohort FROM t JOIN co ON co.tier = t.tier AND co.c = t.match_confidence),
    k AS (SELECT *, min(currency) OVER m = max(currency) OVER m AS one, min(struct_pack(x := -match_confidence, y := offer_id)) OVER m AS first_id FROM b WINDOW m AS (PARTITION BY category, tier, cohort, merchant)),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, tier, cohort, merchant ORDER BY CASE WHEN one THEN CASE WHEN product_price > 0 THEN product_price ELSE 'infinity'::DOUBLE END ELSE 0e0 END, match_confidence DESC, offer_id) AS turn FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tier DESC, cohort, turn, first_id, offer_id) AS place FROM r)
    SELECT category, offer_id, tier, cohort, place FROM p WHERE place <= 120""",
)
def diverse(spark: SparkSession, d: str) -> DataFrame:
    return op.diverse(offers(spark, d), ["category"], 120).select("category", "offer_id", "tier", "cohort", "place")


@query(
    "q_canonical_profile",
    f"""{OFFERS_SQL}, u AS (SELECT product_id, merchant, unnest([struct_pack(field := 'brand', value := trim(brand)), struct_pack(field := 'color', value := trim(color)), struct_pack(field := 'storage', value := trim(storage)), struct_pack(field := 'model_number', value := trim(model_number))]) AS p FROM offers),
    n AS (SELECT product_id, merchant, p.field AS field, p.value AS value, regexp_replace(lower(p.value), '[^a-z0-9]+', '', 'g') AS normal FROM u WHERE p.value IS NOT NULL AND p.value <> ''),
    v AS (SELECT product_id, field, normal, count(DISTINCT merchant) AS sources, count(*) AS observations, arg_max(value, struct_pack(n := length(value), v := value)) AS value FROM n WHERE normal <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY product_id, field ORDER BY sources DESC, observations DESC, length(value) DESC, normal) AS rn, count(*) OVER (PARTITION BY product_id, field) - 1 AS alternatives FROM v)
    SELECT product_id, field, value, sources, observations, alternatives > 0 AS conflict, alternatives FROM r WHERE rn = 1""",
)
def canonical_profile(spark: SparkSession, d: str) -> DataFrame:
    return op.profile(offers(spark, d), ["product_id"])


@query(
    "q_variant_families",
    f"""{ENRICHED} SELECT concat_ws('|', lower(brand), lower(category), coalesce(lower(storage), ''), condition) AS family, count(*) AS offers, count(DISTINCT merchant) AS merchants, count(DISTINCT color) AS variants,
    arg_min(color, struct_pack(a := coalesce(product_price, 'infinity'::DOUBLE), b := color)) AS default_variant FROM enriched GROUP BY family""",
)
def variant_families(spark: SparkSession, d: str) -> DataFrame:
    return op.families(offers(spark, d))


@query(
    "q_offer_intelligence",
    f"""{ENRICHED}, v AS (SELECT *, coalesce(total_sar, product_price) AS value FROM enriched), b AS (SELECT *, min(value) OVER (PARTITION BY product_id) AS baseline, min(delivery_days) OVER (PARTITION BY product_id) AS fastest FROM v)
    SELECT offer_id, value, baseline, value - baseline AS delta, CASE WHEN baseline > 0 THEN floor((value - baseline) / baseline * 1000 + 0.5) / 10 END AS delta_percent,
      concat_ws(',', CASE WHEN value = baseline THEN 'lowest' END, CASE WHEN delivery_days = fastest THEN 'fastest' END, CASE WHEN is_local THEN 'local' END) AS badges,
      concat_ws(',', CASE WHEN shipping IS NULL THEN 'shipping' END, CASE WHEN import_cost IS NULL THEN 'import_cost' END, CASE WHEN tax IS NULL THEN 'tax' END, CASE WHEN mandatory_fees IS NULL THEN 'mandatory_fees' END, CASE WHEN condition <> 'new' THEN 'condition' END) AS warnings FROM b""",
)
def offer_intelligence(spark: SparkSession, d: str) -> DataFrame:
    return op.intelligence(offers(spark, d), ["product_id"]).select("offer_id", "value", "baseline", "delta", "delta_percent", "badges", "warnings")


_RATES = "(VALUES ('SAR', 1e0), ('USD', 3.75e0), ('AED', 1.02e0)) AS rates(currency, rate)"


@query("q_fx_to_sar", f"{OFFERS_SQL} SELECT offer_id, o.currency, rate AS fx_rate, floor(product_price * rate * 100 + 0.5) / 100 AS price_sar FROM offers o LEFT JOIN {_RATES} ON rates.currency = o.currency")
def fx(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("USD", 3.75), ("AED", 1.02)], "currency string, rate double")
    return to_riyal(offers(spark, d), rates).select("offer_id", "currency", "fx_rate", "price_sar")


@query(
    "q_parse_money",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN concat('SAR ', CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)) WHEN 2 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',50 ') WHEN 3 THEN concat('1.', lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0'), ',25')
      WHEN 4 THEN 'n/a' WHEN 5 THEN concat('2,', lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0')) WHEN 6 THEN concat('-', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) ELSE concat('1,2', lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 2, '0'), '.5 USD') END AS raw, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS q, CAST(CAST(l_extendedprice AS BIGINT) AS DOUBLE) AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, raw, CASE l_linenumber WHEN 1 THEN e WHEN 2 THEN q + 0.5e0 WHEN 3 THEN 1000e0 + q + 0.25e0 WHEN 5 THEN 2000e0 + q WHEN 7 THEN 1200e0 + q + 0.5e0 END AS amount, CASE WHEN l_linenumber % 3 = 0 THEN q + 0.5e0 WHEN l_linenumber % 3 = 1 THEN e END AS strict FROM t""",
)
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    n = F.col("l_linenumber")
    e = F.bround("l_extendedprice").cast("long").cast("string")
    raw = F.when(n == 1, F.concat(F.lit("SAR "), e)).when(n == 2, F.concat(q, F.lit(",50 "))).when(n == 3, F.concat(F.lit("1."), F.lpad(q, 3, "0"), F.lit(",25")))
    raw = raw.when(n == 4, "n/a").when(n == 5, F.concat(F.lit("2,"), F.lpad(q, 3, "0"))).when(n == 6, F.concat(F.lit("-"), q)).otherwise(F.concat(F.lit("1,2"), F.lpad(q, 2, "0"), F.lit(".5 USD")))
    plain = F.when(n % 3 == 0, F.concat(q, F.lit(".50"))).when(n % 3 == 1, e).otherwise(F.concat(q, F.lit(",50")))
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), plain.alias("plain"))
    return out.withColumn("amount", parse_money(F.col("raw"))).withColumn("strict", strict_price(F.col("plain")).cast("double")).drop("plain")


@query(
    "q_conditions",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'https://schema.org/NewCondition' WHEN 1 THEN 'Brand-New' WHEN 2 THEN 'not new' WHEN 3 THEN 'like new' WHEN 4 THEN 'Renewed' WHEN 5 THEN 'open_box' WHEN 6 THEN 'https://shop.example/new' ELSE o_orderstatus END AS raw, CASE o_orderstatus WHEN 'F' THEN 'Sold Out' WHEN 'O' THEN 'in-stock' ELSE 'Pre Order' END AS stock FROM orders)
    SELECT raw, CASE raw WHEN 'https://schema.org/NewCondition' THEN 'new' WHEN 'Brand-New' THEN 'new' WHEN 'like new' THEN 'used' WHEN 'Renewed' THEN 'refurbished' WHEN 'open_box' THEN 'open_box' ELSE 'unknown' END AS condition,
      CASE stock WHEN 'Sold Out' THEN 'out_of_stock' WHEN 'in-stock' THEN 'in_stock' ELSE 'preorder' END AS availability, count(*) AS n FROM t GROUP BY ALL""",
)
def conditions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    texts = ["https://schema.org/NewCondition", "Brand-New", "not new", "like new", "Renewed", "open_box", "https://shop.example/new"]
    raw = F.coalesce(*[F.when(k == i, F.lit(t)) for i, t in enumerate(texts)], F.col("o_orderstatus"))
    stock = F.when(F.col("o_orderstatus") == "F", "Sold Out").when(F.col("o_orderstatus") == "O", "in-stock").otherwise("Pre Order")
    out = table(spark, d, "orders").select(raw.alias("raw"), stock.alias("stock"))
    return out.groupBy("raw", tx.normalize_condition(F.col("raw")).alias("condition"), tx.normalize_availability(F.col("stock")).alias("availability")).agg(F.count("*").alias("n"))


@query(
    "q_identity_key",
    f"""{OFFERS_SQL}, k AS (SELECT offer_id, concat('["https://', regexp_extract(source_url, '^https://www\\.([^/]+)', 1), '/p/', product_id, '?v=', regexp_extract(source_url, 'v=([0-9]+)', 1), '","', condition, '","', merchant_country, '","', coalesce(sku, ''), '","', coalesce(upper(model_number), ''), '"]') AS offer_key FROM offers)
    SELECT offer_id, offer_key, sha256(offer_key) AS document_id FROM k""",
)
def identity_key(spark: SparkSession, d: str) -> DataFrame:
    from quaylens.functions.urls import canonical_url

    fields = [canonical_url(F.col("source_url")), F.lower(F.trim(F.coalesce("condition", F.lit("new")))), F.upper(F.trim("merchant_country")), F.trim(F.coalesce("sku", F.lit(""))), F.upper(F.trim(F.coalesce("model_number", F.lit(""))))]
    keyed = offers(spark, d).select("offer_id", F.to_json(F.array(*fields)).alias("offer_key"))
    return keyed.withColumn("document_id", F.sha2("offer_key", 256))


@query(
    "q_variant_key",
    f"{OFFERS_SQL} SELECT concat_ws('|', lower(brand), category, coalesce(lower(replace(storage, ' ', '')), ''), color, condition, concat('sku:', coalesce(lower(replace(model_number, '-', '')), 'unknown'))) AS variant_key, count(*) AS offers FROM offers GROUP BY variant_key",
)
def variant_key(spark: SparkSession, d: str) -> DataFrame:
    storage = tx.joined_units(tx.plain_text(F.coalesce("storage", F.lit(""))))
    model = F.regexp_replace(F.lower("model_number"), "[^a-z0-9]+", "")
    key = F.concat_ws("|", F.lower("brand"), "category", storage, "color", "condition", F.concat(F.lit("sku:"), F.coalesce(model, F.lit("unknown"))))
    return offers(spark, d).groupBy(key.alias("variant_key")).agg(F.count("*").alias("offers"))


_LANE = """CASE WHEN title LIKE '%bolt%' OR title LIKE '%gear%' THEN 'accessory' WHEN match_confidence >= 0.92e0 AND exact_match THEN 'direct' WHEN match_confidence >= 0.35e0 THEN 'alternative' ELSE 'other' END"""


@query("q_lanes", f"{ENRICHED} SELECT offer_id, lane, place FROM (SELECT *, {_LANE} AS lane, row_number() OVER (PARTITION BY market, {_LANE} ORDER BY {_PLACE}, total_sar ASC NULLS LAST, product_price ASC NULLS LAST, match_confidence DESC, offer_id) AS place FROM enriched)")
def lanes(spark: SparkSession, d: str) -> DataFrame:
    sold = F.col("title").contains("bolt") | F.col("title").contains("gear")
    lane = F.when(sold, "accessory").when((F.col("match_confidence") >= 0.92) & F.col("exact_match"), "direct").when(F.col("match_confidence") >= 0.35, "alternative").otherwise("other")
    out = op.enrich(offers(spark, d)).withColumn("lane", lane)
    needed = ["market", "lane", "offer_id", "bucket", "total_sar", "product_price", "match_confidence"]
    return ranked(out.select(*needed), ["market", "lane"], op.rank_order()).select("offer_id", "lane", "place")


@query(
    "q_discovery_sections",
    f"{ENRICHED} SELECT category, count(*) AS offers, string_agg(offer_id, ',' ORDER BY place) FILTER (place <= 5) AS first_offers FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_PLACE}, total_sar ASC NULLS LAST, product_price ASC NULLS LAST, match_confidence DESC, offer_id) AS place FROM enriched) GROUP BY category",
)
def discovery_sections(spark: SparkSession, d: str) -> DataFrame:
    counts = offers(spark, d).groupBy("category").agg(F.count("*").alias("offers"))
    first = op.rank(offers(spark, d), "lowest", ["category"]).where("rank <= 5")  # Spark keeps five rows a task and category before it shuffles
    first = first.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", "offer_id"))).alias("l"))
    return counts.join(first, "category").select("category", "offers", F.array_join(F.transform("l", lambda x: x["offer_id"]), ",").alias("first_offers"))


@query(
    "q_variant_selector",
    f"{ENRICHED}, c AS (SELECT category, color, min(product_price) AS p FROM enriched GROUP BY ALL), chosen AS (SELECT category, color FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY p ASC NULLS LAST, color) = 1) SELECT e.category, e.color, storage, count(*) AS offers, count(DISTINCT merchant) AS merchants, min(product_price) AS min_price FROM enriched e JOIN chosen ON e.category = chosen.category AND e.color = chosen.color WHERE storage IS NOT NULL GROUP BY ALL",
)
def variant_selector(spark: SparkSession, d: str) -> DataFrame:
    """For each category its colour with the lowest price, and what each storage of that colour costs."""
    e = op.enrich(offers(spark, d))
    colours = e.groupBy("category", "color").agg(F.min("product_price").alias("p"))
    chosen = colours.groupBy("category").agg(F.min_by("color", F.struct(F.coalesce("p", F.lit(float("inf"))), "color")).alias("color"))
    return e.join(chosen, ["category", "color"]).where("storage is not null").groupBy("category", "color", "storage").agg(F.count("*").alias("offers"), F.countDistinct("merchant").alias("merchants"), F.min("product_price").alias("min_price"))


@query("q_result_window", f"{ENRICHED} SELECT product_id, count(*) > 20 AS truncated, least(count(*), 20) AS shown, count(*) AS total FROM enriched GROUP BY product_id")
def result_window(spark: SparkSession, d: str) -> DataFrame:
    total = F.count("*")
    return offers(spark, d).groupBy("product_id").agg((total > 20).alias("truncated"), F.least(total, F.lit(20)).alias("shown"), total.alias("total"))


@query("q_page_plan", f"{OFFERS_SQL}, r AS (SELECT category, offer_id, row_number() OVER (PARTITION BY category ORDER BY match_confidence DESC, offer_id) - 1 AS i FROM offers) SELECT category, offer_id, CASE WHEN i < 80 THEN 0 WHEN i < 500 THEN 1 ELSE 2 END AS depth FROM r WHERE i < 1000")
def page_plan(spark: SparkSession, d: str) -> DataFrame:
    return cov.windowed(offers(spark, d), ["category"], [F.desc("match_confidence"), F.asc("offer_id")], ((0, 80), (80, 420), (500, 500))).select("category", "offer_id", "depth")


@query("q_keyset_page", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01 00:00:00', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    before = F.expr("struct(o_orderdate, o_orderkey) < struct(cast('1998-01-01 00:00:00' as timestamp_ntz), 1000L)")
    rows = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return rows.where(before).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "q_product_document",
    f"""{ENRICHED} SELECT offer_id, ((title IS NULL)::INT + (brand IS NULL)::INT + (sku IS NULL)::INT + (model_number IS NULL)::INT + (product_price IS NULL)::INT + (shipping IS NULL)::INT + (delivery_days IS NULL)::INT + (storage IS NULL)::INT) AS missing,
    (8 - ((title IS NULL)::INT + (brand IS NULL)::INT + (sku IS NULL)::INT + (model_number IS NULL)::INT + (product_price IS NULL)::INT + (shipping IS NULL)::INT + (delivery_days IS NULL)::INT + (storage IS NULL)::INT)) / 8e0 AS completeness FROM enriched""",
)
def product_document(spark: SparkSession, d: str) -> DataFrame:
    fields = ["title", "brand", "sku", "model_number", "product_price", "shipping", "delivery_days", "storage"]
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    return op.enrich(offers(spark, d)).select("offer_id", missing.alias("missing"), ((8 - missing) / F.lit(8.0)).alias("completeness"))


@query("q_rounding", f"{OFFERS_SQL} SELECT offer_id, floor(product_price * 100 + 0.5) / 100 AS cents, floor(match_confidence * 10 + 0.5) / 10 AS tenths FROM offers")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", half_up(F.col("product_price"), 2).alias("cents"), half_up(F.col("match_confidence"), 1).alias("tenths"))


def rank_entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the three best offers of each part."""
    return op.rank(offers(spark, d), "lowest", ["product_id"]).where("rank <= 3").select("product_id", "rank", "offer_id", "merchant", "bucket", "total_sar", "product_price")
