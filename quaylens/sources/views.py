"""Offers, observations and extraction candidates seen in the star-schema and event tables.

The column definitions are SQL that Spark and DuckDB read alike, so that a query and its twin start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PRICE = "(l_extendedprice / l_quantity)"
_UNITS = "cast(l_quantity as bigint)"
_SCORE = "((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 101)"

OFFER_COLUMNS: dict[str, str] = {
    "offer_id": f"concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', {_UNITS})",
    "product_id": "l_partkey",
    "provider": "concat('provider_', l_suppkey % 5)",
    "merchant": "s_name",
    "merchant_country": "n_name",
    "market": "r_name",
    "title": "concat(p_name, ' ', lower(p_type), ' ', (p_size % 4 + 1) * 64, 'gb')",
    "brand": "p_brand",
    "category": "split_part(p_name, ' ', 2)",
    "color": "split_part(p_name, ' ', 1)",
    "storage": "case when p_size % 5 = 0 then null else concat((p_size % 4 + 1) * 64, ' GB') end",
    "model_number": "case when l_linenumber % 3 = 0 then null else concat('MN-', p_partkey % 50) end",
    "sku": "case when l_linenumber % 2 = 0 then null else concat('SKU', l_partkey) end",
    "product_price": f"case when l_linenumber = 7 and l_suppkey % 3 = 0 then null else {_PRICE} end",
    "shipping": f"case when {_UNITS} % 7 = 0 then null when {_UNITS} % 5 = 0 then 0e0 else 12.5e0 + ({_UNITS} % 4) * 2.5e0 end",
    "import_cost": f"case when r_name = 'MIDDLE EAST' then 0e0 else {_PRICE} * 0.05e0 end",
    "tax": f"{_PRICE} * (l_tax + 0e0)",
    "mandatory_fees": "case when l_linenumber = 6 then null else (l_linenumber % 2) * 1e0 end",
    "discount": f"case when l_linenumber = 5 then null else {_PRICE} * (l_discount + 0e0) end",
    "currency": "case when n_nationkey % 10 = 9 then 'USD' else 'SAR' end",
    "condition": "case when l_linestatus = 'F' then 'new' else 'used' end",
    "availability": "case l_returnflag when 'N' then 'in_stock' when 'R' then 'out_of_stock' else 'unknown' end",
    "can_ship_to_saudi": "case r_name when 'EUROPE' then false when 'ASIA' then null else true end",
    "is_local": "r_name = 'MIDDLE EAST'",
    "delivery_days": "case when l_linenumber % 4 = 0 then null else cast(l_linenumber + n_nationkey % 5 as int) end",
    "match_confidence": f"{_SCORE} / 100e0",
    "exact_match": f"{_SCORE} >= 92",
    "price_confidence": "case when l_linenumber % 3 = 0 then 'estimated' else 'observed' end",
    "data_kind": "case when l_linenumber % 2 = 1 then 'live' else 'indexed' end",
    "observed_at": "l_shipdate",
    "source_url": "concat('https://www.', lower(replace(s_name, '#', '')), '.example.com/p/', l_partkey, '/?utm_source=feed&v=', l_linenumber, '#top')",
}

_FROM = "lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
#: for the twins: WITH offers AS (...)
OFFERS_SQL = "WITH offers AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in OFFER_COLUMNS.items()) + f" FROM {_FROM})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer per line item. The joins are plain equi-joins: Spark broadcasts the sides that are small by its own measure."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in OFFER_COLUMNS.items()])


#: An event as an observation of a source: errors are failed calls, the value is its latency in tenths of a second, k its offers.
OBSERVATION_COLUMNS: dict[str, str] = {
    "event_id": "event_id",
    "source_id": "concat('source_', user_id % 40)",
    "product_id": "user_id",
    "kind": "event_type",
    "transport_ok": "event_type <> 'error'",
    "latency_ms": "value * 100e0",
    "price": "value",
    "observed_at": "ts",
}
OBSERVATIONS_SQL = "WITH observations AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in OBSERVATION_COLUMNS.items()) + ", cast(json_extract(props, '$.k') as bigint) AS offers FROM events)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.selectExpr(*[f"{e} AS {n}" for n, e in OBSERVATION_COLUMNS.items()], "cast(get_json_object(props, '$.k') as bigint) AS offers")


#: How the same product is seen by different ways of extraction: every offer of a part in one order month is a candidate.
STRATEGIES = ("jsonld", "domain_adapter", "embedded_json", "storefront_data", "hydrated_state", "meta")
_STRATEGY = "case (l_linenumber + l_suppkey) % 6 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STRATEGIES)) + " end"
CANDIDATE_COLUMNS: dict[str, str] = {
    "candidate_id": OFFER_COLUMNS["offer_id"],
    "product_id": "l_orderkey",
    "strategy": _STRATEGY,
    "confidence": f"{_SCORE} / 100e0",
    "name": "case when l_linenumber = 7 then null else concat(p_name, ' ', lower(p_type)) end",
    "brand": "p_brand",
    "sku": "case when l_linenumber % 2 = 0 then null else concat('SKU', l_partkey % 9) end",
    "model": "case when l_linenumber % 3 = 0 then null else concat('MN-', p_partkey % 7) end",
    "gtin": "case when l_linenumber % 4 <> 0 then null else concat('0', l_partkey % 5) end",
    "price": "round(l_extendedprice / l_quantity)",
    "currency": "case when l_suppkey % 6 = 0 then 'USD' else 'SAR' end",
    "availability": "case l_returnflag when 'N' then 'instock' when 'R' then 'outofstock' else null end",
    "observed_at": "case when l_linenumber = 2 then null else l_shipdate end",
}
CANDIDATES_SQL = "WITH candidates AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CANDIDATE_COLUMNS.items()) + " FROM lineitem join part on l_partkey = p_partkey)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in CANDIDATE_COLUMNS.items()])
