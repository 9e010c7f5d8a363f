"""Queries about embedded states, links to follow, waves, labels, profiles and resolved offers, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.operators import catalog as cat
from quaylens.operators import coverage as cov
from quaylens.operators import evidence as ev
from quaylens.operators import matching as mt
from quaylens.operators import offers as op
from quaylens.operators import pages as pg
from quaylens.plans.evidence_queries import _AGED, _trust_sql
from quaylens.plans.gate_queries import _case
from quaylens.plans.registry import query
from quaylens.schema import OFFERS_NOW
from quaylens.sources.views import OFFERS_SQL, candidates, offers, table


@query("q_embedded_offers", "SELECT p_partkey AS page_id, p_name AS title, floor(p_retailprice) AS price, 'SAR' AS currency, concat('https://x/', p_partkey) AS url FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'ring', 'bolt', 'gear'])")
def embedded_offers(spark: SparkSession, d: str) -> DataFrame:
    node = "named_struct('name', p_name, 'price', cast(cast(floor(p_retailprice) as int) as string), 'priceCurrency', 'SAR', 'url', concat('https://x/', p_partkey))"
    state = f"to_json(named_struct('page', named_struct('list', array({node}, {node}), 'other', array(named_struct('name', p_name, 'price', '0', 'currency', 'SAR', 'url', 'u')))))"
    html = f"concat('<p></p><script id=\"s\" type=\"application/json\">', {state}, '</script><script type=\"application/json\">[broken</script>')"
    return pg.embedded_offers(table(spark, d, "part").selectExpr("p_partkey AS page_id", f"{html} AS html"), ["red", "blue", "ring", "bolt", "gear"])


@query(
    "q_recovery_links",
    r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"#]+)"', 1))) AS href FROM pages WHERE page_id % 3 <> 0), f AS (SELECT page_id, root, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN concat(root, href) ELSE concat(root, '/', href) END AS link FROM l),
    s AS (SELECT page_id, link, (contains(lower(link), 'about'))::INT + (contains(lower(link), 'contact'))::INT AS score FROM f WHERE starts_with(link, 'https://') AND regexp_replace(lower(regexp_extract(link, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(root, '^[a-z]+://([^/?#]+)', 1)), '^www\.', ''))
    SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) AS place FROM s QUALIFY place <= 2""",
)
def recovery_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pg.recovery_links(pg.links(pages), pages.where("page_id % 3 = 0"), ["about", "contact"]).select("page_id", "link", "score", "place")


@query("q_variant_state", "WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT l_partkey AS page_id, CAST(l_suppkey AS VARCHAR) AS variant_id, CASE WHEN l_suppkey % 2 = 0 THEN p_name ELSE concat(p_name, ' · v', l_suppkey) END AS title, (floor(p_retailprice) + l_suppkey) * 1e0 AS price, CASE l_suppkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM k JOIN part ON p_partkey = l_partkey")
def variant_state(spark: SparkSession, d: str) -> DataFrame:
    variant = "named_struct('id', cast(l_suppkey as string), 'title', case when l_suppkey % 2 = 0 then 'Default Title' else concat('v', l_suppkey) end, 'price', cast(floor(p_retailprice) + l_suppkey as bigint) * 100, 'available', case l_suppkey % 3 when 1 then true when 2 then false end)"
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per_page = sold.groupBy("l_partkey").agg(F.first("p_name").alias("p_name"), F.collect_list(F.expr(variant)).alias("variants"))
    html = "concat('<script id=\"ProductJson-1\" type=\"application/json\">', to_json(named_struct('id', cast(l_partkey as string), 'title', p_name, 'variants', variants)), '</script>')"
    return pg.variant_state(per_page.selectExpr("l_partkey AS page_id", f"{html} AS html")).select("page_id", "variant_id", "title", "price", "availability")


@query("q_acquisition_waves", "WITH r AS (SELECT n_regionkey AS query_id, s_suppkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT query_id, s_suppkey, CASE WHEN place <= 16 THEN 0 WHEN place <= 28 THEN 1 ELSE 2 END AS wave FROM r")
def acquisition_waves(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return cov.acquisition_waves(stores.select(F.col("n_regionkey").alias("query_id"), "s_suppkey", place.alias("place"))).select("query_id", "s_suppkey", "wave")


@query("q_counted_label", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN n = 1 THEN 'عرض واحد' WHEN n = 2 THEN 'عرضان' WHEN n % 100 BETWEEN 3 AND 10 THEN concat(n, ' عروض') WHEN n % 100 BETWEEN 11 AND 99 THEN concat(n, ' عرضًا') ELSE concat(n, ' عرض') END AS label FROM c")
def counted_label(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.select("o_custkey", cov.counted_label(F.col("n"), "عرض واحد", "عرضان", "عروض", "عرضًا", "عرض").alias("label"))


@query("q_profile_versions", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS strategy, CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 11 = 0 OR p_partkey % 3 <> 0 THEN p_size ELSE p_size + 1 END AS version FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0)")
def profile_versions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    stored = part.where("p_partkey % 7 <> 0").select("p_partkey", F.col("p_name").alias("strategy"), F.col("p_size").alias("version"))
    found = part.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("strategy"))
    return cov.profile_versions(stored, found, "p_partkey", ["strategy"])


@query("q_ranking_metrics", "WITH g AS (SELECT l_partkey AS product_id, (l_linenumber + l_suppkey) % 4 AS grade, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem), f AS (SELECT product_id, min(struct_pack(p := place, v := price)) FILTER (grade = 3 AND place <= 10) AS f, min(price) FILTER (grade = 3) AS low FROM g GROUP BY product_id) SELECT product_id, coalesce(1e0 / f.p, 0e0) AS reciprocal_rank, f.v - low AS regret FROM f")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"))
    g = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), ((F.col("l_linenumber") + F.col("l_suppkey")) % 4).alias("grade"), F.col("l_extendedprice").alias("price"), place.alias("place"))
    return cov.ranking_metrics(g, "product_id")


@query("q_extraction_candidates", "WITH s AS (SELECT CASE (l_linenumber + l_suppkey) % 7 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'embedded_json' WHEN 2 THEN 'hydrated_state' WHEN 3 THEN 'storefront_data' WHEN 4 THEN 'domain_adapter' WHEN 5 THEN 'meta' ELSE 'guess' END AS strategy FROM lineitem) SELECT strategy, CASE strategy WHEN 'jsonld' THEN 0.99e0 WHEN 'embedded_json' THEN 0.94e0 WHEN 'hydrated_state' THEN 0.9e0 WHEN 'storefront_data' THEN 0.92e0 WHEN 'domain_adapter' THEN 0.96e0 ELSE 0.72e0 END AS confidence, count(*) AS n FROM s WHERE strategy <> 'guess' GROUP BY ALL")
def extraction_candidates(spark: SparkSession, d: str) -> DataFrame:
    ways = _case("(l_linenumber + l_suppkey)", [*ev.STRATEGY_CONFIDENCE, "guess"])
    return ev.extraction_candidates(table(spark, d, "lineitem").selectExpr(f"{ways} AS strategy")).groupBy("strategy", "confidence").agg(F.count("*").alias("n"))


@query(
    "q_resolve_offer",
    f"""{_AGED}, t AS (SELECT *, {_trust_sql('price')} AS tp, {_trust_sql('name')} AS tn, {_trust_sql('brand')} AS tb FROM aged), p AS (SELECT product_id, candidate_id, strategy, price, currency, availability FROM t WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY tp DESC, candidate_id) = 1),
    n AS (SELECT product_id, name FROM t WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY tn DESC, candidate_id DESC) = 1), b AS (SELECT product_id, brand FROM t WHERE brand IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY tb DESC, candidate_id DESC) = 1)
    SELECT p.product_id, strategy, name, brand, CASE WHEN currency = 'SAR' THEN floor(price * 100 + 0.5) / 100 ELSE floor(price * 3.75e0 * 100 + 0.5) / 100 END AS price_sar, availability FROM p LEFT JOIN n ON n.product_id = p.product_id LEFT JOIN b ON b.product_id = p.product_id""",
)
def resolve_offer(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("USD", 3.75)], "currency string, rate double")
    return ev.resolve(candidates(spark, d), rates, OFFERS_NOW).select("product_id", "strategy", "name", "brand", "price_sar", "availability")


@query("q_variant_dimensions", f"{OFFERS_SQL}, u AS (SELECT offer_id, unnest([struct_pack(k := 'model', v := model_number), struct_pack(k := 'storage', v := storage), struct_pack(k := 'color', v := color), struct_pack(k := 'condition', v := condition), struct_pack(k := 'sku', v := sku)]) AS d FROM offers) SELECT d.k AS dimension, d.v AS label, count(*) AS offers FROM u WHERE d.v IS NOT NULL GROUP BY ALL")
def variant_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return op.variant_dimensions(offers(spark, d)).groupBy("dimension", "label").agg(F.count("*").alias("offers"))


@query("q_presentation", f"{OFFERS_SQL}, r AS (SELECT *, CASE WHEN category IN ('bolt', 'gear') THEN 'accessory' ELSE 'product' END AS role FROM offers), s AS (SELECT CASE WHEN role = 'product' AND match_confidence >= 0.35e0 AND condition = 'new' THEN 'primary' ELSE 'secondary' END AS lane, CASE WHEN role = 'product' AND match_confidence >= 0.35e0 AND condition = 'new' THEN category WHEN role = 'accessory' THEN 'accessory' ELSE 'alternative' END AS section FROM r) SELECT lane, section, count(*) AS offers FROM s GROUP BY ALL")
def presentation(spark: SparkSession, d: str) -> DataFrame:
    return op.presentation(offers(spark, d).withColumn("role", mt.sold_role(F.col("title")))).groupBy("lane", "section").agg(F.count("*").alias("offers"))


@query("q_observation_append", f"{OFFERS_SQL} SELECT product_id, count(*) AS logged, max(observed_at) AS newest FROM offers WHERE product_price > 0 GROUP BY product_id")
def observation_append(spark: SparkSession, d: str) -> DataFrame:
    """The log after new observations, and what it leaves of each product in the canonical table."""
    o = offers(spark, d).where("product_price > 0")
    log, current = cat.record(o.where("data_kind <> 'live'"), o.where("data_kind <> 'live'").limit(0), o.where("data_kind = 'live'"), ["product_id"])
    kept = cat.upsert(current, o.where("data_kind <> 'live'"), ["product_id"]).select("product_id", F.col("observed_at").alias("newest"))
    return log.groupBy("product_id").agg(F.count("*").alias("logged")).join(kept, "product_id")
