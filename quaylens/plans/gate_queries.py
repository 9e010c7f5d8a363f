"""Queries about gates, coverage, routes and walks, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.functions import text as tx
from quaylens.operators import catalog as cat
from quaylens.operators import coverage as cov
from quaylens.operators import evidence as ev
from quaylens.operators import gates as gt
from quaylens.operators import matching as mt
from quaylens.plans.catalog_queries import CATEGORIES, COLORS
from quaylens.plans.evidence_queries import _TOK, _verdict_sql
from quaylens.plans.registry import query
from quaylens.schema import OFFERS_NOW
from quaylens.sources.storage import work_folder, written
from quaylens.sources.views import CANDIDATES_SQL, OBSERVATIONS_SQL, OFFERS_SQL, candidates, observations, offers, table


def _case(key: str, values: list[str | None]) -> str:
    """SQL that Spark and DuckDB read alike: one of the values by a key modulo their number."""
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(quoted)) + " end"


def _mapped(text: str, known: dict[str, str], other: str) -> str:
    return "CASE " + text + " " + " ".join("WHEN '" + k.replace("'", "''") + f"' THEN '{v}'" for k, v in known.items()) + f" ELSE '{other}' END"


_STORE_NAME = "case c_custkey % 7 when 0 then 'Decathlon' when 1 then 'decathlon Riyadh' when 2 then 'Decathlonia' else c_name end"
_STORE_URL = "case c_custkey % 5 when 0 then 'https://www.decathlon.com.sa/p' when 1 then 'https://notdecathlon.example/p' else concat('https://shop', c_custkey, '.example.com/') end"


@query("q_excluded_merchant", f"SELECT c_nationkey, count(*) AS stores, count(*) FILTER (c_custkey % 7 IN (0, 1) OR c_custkey % 5 = 0 OR c_custkey % 11 = 0) AS excluded FROM customer GROUP BY c_nationkey")
def excluded_merchant(spark: SparkSession, d: str) -> DataFrame:
    ids = F.expr("case when c_custkey % 11 = 0 then 'Decathlon-sa' else concat('store-', c_custkey) end")
    out = gt.excluded_merchant(ids, F.expr(_STORE_NAME), F.expr(_STORE_URL))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("stores"), F.count_if(out).alias("excluded"))


@query("q_structural_validity", f"{OFFERS_SQL} SELECT merchant, count(*) AS offers, count(*) FILTER (product_price > 0 AND currency = 'SAR') AS valid FROM offers GROUP BY merchant")
def structural_validity(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("merchant").agg(F.count("*").alias("offers"), F.count_if(gt.structurally_valid()).alias("valid"))


@query("q_publication_gate", f"{OFFERS_SQL} SELECT category, count(*) AS returned_offers, count(DISTINCT concat(provider, '|', merchant)) AS returned_merchants FROM offers WHERE provider <> 'provider_3' GROUP BY category")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    market = F.when(F.col("provider") == "provider_3", "Amazon-DE").otherwise(F.col("provider"))
    return gt.coverage_after(gt.publishable(offers(spark, d).withColumn("provider_market", market)), ["category"])


@query("q_ingest_batch", f"{OFFERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY offer_id, product_price, observed_at) AS n FROM offers) SELECT merchant, count(*) AS kept, sum(CASE WHEN condition = 'new' THEN 1 ELSE 0 END)::BIGINT AS fresh FROM r WHERE n <= 500 AND product_price > 0 AND observed_at <= TIMESTAMP '1998-06-01 00:01:00' GROUP BY merchant")
def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each merchant's first batch of 500, as a request would bring it."""
    rows = offers(spark, d).withColumn("title", F.concat(F.lit("  "), "title")).withColumn("condition", F.upper("condition"))
    kept = gt.ingest(rows, "1998-06-01 00:00:00", ["merchant"], ["offer_id", "product_price", "observed_at"])
    return kept.groupBy("merchant").agg(F.count("*").alias("kept"), F.count_if(F.col("condition") == "new").alias("fresh"))


@query("q_canary", f"{OFFERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY offer_id, product_price) AS n FROM offers), s AS (SELECT merchant, count(*) AS sampled, count(*) FILTER (product_price > 0) AS valid FROM r WHERE n <= 200 GROUP BY merchant) SELECT merchant, sampled, valid, valid / sampled::DOUBLE AS validity, valid / sampled::DOUBLE >= 0.99e0 AS passed FROM s")
def canary(spark: SparkSession, d: str) -> DataFrame:
    return gt.canary(offers(spark, d), "merchant", ["offer_id", "product_price"])


@query("q_limited_ingest", f"{OFFERS_SQL}, g AS (SELECT merchant, count(*) AS attempted, count(*) FILTER (product_price > 0 AND currency = 'SAR') AS saved FROM offers GROUP BY merchant) SELECT merchant, attempted, saved, attempted - saved AS failed, attempted = saved AS passed FROM g")
def limited_ingest(spark: SparkSession, d: str) -> DataFrame:
    return gt.limited_ingest(offers(spark, d).withColumn("recorded", gt.structurally_valid()), "merchant")


_SAID = ["https://schema.org/NewCondition", "", None, "UsedCondition", "barely worn"]
_ASKED = ["NewCondition", None, "Renewed"]
_KNOWN = {"https://schema.org/NewCondition": "new", "NewCondition": "new", "UsedCondition": "used", "Renewed": "refurbished"}


@query(
    "q_condition_evidence",
    f"""WITH t AS (SELECT coalesce({_case('l_partkey', _SAID)}, '') AS p, coalesce({_case('l_suppkey', _ASKED)}, '') AS o FROM lineitem), c AS (SELECT p, o, {_mapped('p', _KNOWN, 'unknown')} AS pc, {_mapped('o', _KNOWN, 'unknown')} AS oc FROM t),
    e AS (SELECT CASE WHEN p <> '' AND o <> '' THEN CASE WHEN pc = oc AND pc <> 'unknown' THEN pc ELSE 'unknown' END WHEN p <> '' THEN pc ELSE oc END AS condition,
      CASE WHEN p <> '' AND o <> '' THEN CASE WHEN pc = oc AND pc <> 'unknown' THEN 'PRODUCT_AND_SELECTED_OFFER' ELSE 'CONFLICTING_OR_UNVERIFIED' END WHEN p <> '' THEN CASE WHEN pc = 'unknown' THEN 'UNVERIFIED' ELSE 'PRODUCT' END WHEN o <> '' THEN 'SELECTED_PRICED_OFFER' ELSE 'ABSENT' END AS evidence FROM c)
    SELECT condition, evidence, count(*) AS n FROM e GROUP BY ALL""",
)
def condition_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(f"{_case('l_partkey', _SAID)} AS p", f"{_case('l_suppkey', _ASKED)} AS o")
    condition, evidence = gt.condition_evidence(F.col("p"), F.col("o"))
    return rows.groupBy(condition.alias("condition"), evidence.alias("evidence")).agg(F.count("*").alias("n"))


_LABELS = {"12 per month": "installment", "Trade-in price": "trade-in", "Members only": "member", "from 99": "starting-from", "Sale 50": "sale", "SAR 99": "regular", "sale, monthly": "installment"}


@query("q_price_semantics", f"WITH t AS (SELECT {_case('o_orderkey', list(_LABELS))} AS label FROM orders) SELECT label, {_mapped('label', _LABELS, '')} AS kind, {_mapped('label', _LABELS, '')} NOT IN ('installment', 'trade-in') AS is_price, count(*) AS n FROM t GROUP BY ALL")
def price_semantics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(f"{_case('o_orderkey', list(_LABELS))} AS label")
    return rows.groupBy("label", gt.price_kind(F.col("label")).alias("kind"), gt.is_product_price(F.col("label")).alias("is_price")).agg(F.count("*").alias("n"))


@query("q_field_mapping", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS sourceProductId, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END AS price, CASE WHEN p_size % 3 <> 0 THEN 5 ELSE 4 END / 5e0 AS coverage FROM part")
def field_mapping(spark: SparkSession, d: str) -> DataFrame:
    record = "map('productId', cast(p_partkey as string), 'name', p_name, 'salePrice', case when p_size % 3 <> 0 then cast(p_size as string) end, 'priceCurrency', 'SAR', 'url', concat('https://x/', p_partkey))"
    return gt.map_fields(table(spark, d, "part").selectExpr("p_partkey", f"{record} AS record"), "record").select("p_partkey", "sourceProductId", "title", "price", "coverage")


_SPECS = ["Black", "N/A", "yes", " ", "unknown", "No", None]


@query("q_display_spec", f"WITH t AS (SELECT {_case('p_partkey', _SPECS)} AS v FROM part) SELECT CASE WHEN v = 'Black' THEN v END AS color, CASE v WHEN 'Black' THEN v WHEN 'yes' THEN 'yes' WHEN 'No' THEN 'no' END AS waterproof, count(*) AS n FROM t GROUP BY ALL")
def display_spec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(f"{_case('p_partkey', _SPECS)} AS v")
    return rows.groupBy(gt.display_value("color", F.col("v")).alias("color"), gt.display_value("waterproof", F.col("v")).alias("waterproof")).agg(F.count("*").alias("n"))


@query("q_merchant_key", f"""{OFFERS_SQL} SELECT CASE WHEN provider = 'provider_1' THEN concat('["shopify","', market, '"]') ELSE concat('["', provider, '","', merchant, '"]') END AS merchant_key, count(*) AS offers FROM offers GROUP BY merchant_key""")
def merchant_key(spark: SparkSession, d: str) -> DataFrame:
    provider = F.when(F.col("provider") == "provider_1", "shopify").otherwise(F.col("provider"))
    return offers(spark, d).groupBy(gt.merchant_key(provider, F.col("merchant"), F.col("market")).alias("merchant_key")).agg(F.count("*").alias("offers"))


_HOSTS = {"https://www.extra.com/x": "eXtra", "https://shop.acme.sa/": "Acme", "https://acme.co.uk/p?q=1": "Acme", "https://m.jarir.com": "Jarir", "https://single.de/": "Single"}
_LANDS = {"https://shop.acme.sa/": "SA", "https://acme.co.uk/p?q=1": "GB", "https://single.de/": "DE"}


@query("q_merchant_origin", f"WITH t AS (SELECT {_case('s_suppkey', list(_HOSTS))} AS url, CASE s_suppkey % 3 WHEN 0 THEN 'aed' WHEN 1 THEN 'XXX' END AS currency FROM supplier) SELECT url, {_mapped('url', _HOSTS, '')} AS merchant, CASE WHEN url IN ('https://www.extra.com/x', 'https://m.jarir.com') THEN CASE WHEN currency = 'aed' THEN 'AE' ELSE 'UN' END ELSE {_mapped('url', _LANDS, '')} END AS country, count(*) AS n FROM t GROUP BY ALL")
def merchant_origin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr(f"{_case('s_suppkey', list(_HOSTS))} AS url", "case s_suppkey % 3 when 0 then 'aed' when 1 then 'XXX' end AS currency")
    return rows.groupBy("url", gt.merchant_name(F.col("url")).alias("merchant"), gt.country_of(F.col("url"), F.col("currency")).alias("country")).agg(F.count("*").alias("n"))




@query(
    "q_buybox_parity",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 13 = 0 AS no_asin, o_totalprice <= 1000 AS cheap, o_orderkey % 5 = 0 AS other_asin, o_orderkey % 7 = 0 AS other_seller, o_orderkey % 3 = 0 AS other_price, o_orderkey % 11 = 0 AS absent FROM orders)
    SELECT CASE WHEN no_asin THEN 'DECLARED_ASIN_MISSING' WHEN cheap THEN 'DECLARED_OFFER_INCOMPLETE' WHEN absent OR other_asin THEN 'BUYBOX_ASIN_CONFLICT' WHEN other_seller THEN 'BUYBOX_SELLER_CONFLICT' WHEN other_price THEN 'BUYBOX_PRICE_CONFLICT' ELSE 'SAME_OFFER_MATCH_NOT_ATTESTED' END AS reason, count(*) AS n FROM t GROUP BY reason""",
)
def buybox_parity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    asin = "concat('AB', lpad(cast(o_orderkey as string), 8, '0'))"
    declared = o.selectExpr("o_orderkey AS key", f"case when o_orderkey % 13 <> 0 then lower({asin}) end AS asin", "concat(' S', o_custkey) AS seller", "case when o_totalprice > 1000 then o_totalprice end AS price", "'EUR' AS currency")
    seen = o.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey AS key", f"case when o_orderkey % 5 = 0 then 'AB00000000' else {asin} end AS asin", "case when o_orderkey % 7 = 0 then 'other' else concat('S', o_custkey) end AS seller", "case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end AS price", "'EUR' AS currency")
    return gt.buybox_parity(declared, seen).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_shared_model", f"{OFFERS_SQL}, g AS (SELECT product_id, condition, count(DISTINCT merchant) AS merchants, min(coalesce(model_number, '')) AS a, max(coalesce(model_number, '')) AS b FROM offers GROUP BY ALL) SELECT product_id, condition, merchants, merchants >= 2 AND a = b AND a <> '' AS shared_model FROM g")
def shared_model(spark: SparkSession, d: str) -> DataFrame:
    return gt.shared_model_evidence(offers(spark, d), ["product_id", "condition"])




@query(
    "q_same_offer",
    f"""{CANDIDATES_SQL}, k AS (SELECT *, list_distinct({_TOK.format('name')}) AS toks FROM candidates),
    p AS (SELECT a.product_id, a.candidate_id AS candidate_id_a, b.candidate_id AS candidate_id_b, a.name AS na, b.name AS nb, a.toks AS ta, b.toks AS tb, a.gtin AS ga, b.gtin AS gb, a.sku AS sa, b.sku AS sb, a.model AS ma, b.model AS mb, a.brand AS ba, b.brand AS bb FROM k a JOIN k b ON a.product_id = b.product_id AND a.candidate_id < b.candidate_id), {_verdict_sql('p')}
    SELECT candidate_id_a, candidate_id_b, split_part(candidate_id_a, '-', 3) = split_part(candidate_id_b, '-', 3) AND verdict IN ('same', 'likely_same') AND NOT coalesce(ga <> gb, false) AND NOT coalesce(sa <> sb, false) AND NOT coalesce(ma <> mb, false) AND ba = bb AND (coalesce(ga = gb, false) OR coalesce(sa = sb, false) OR coalesce(ma = mb, false) OR coalesce(lower(na) = lower(nb), false)) AS same_offer FROM v""",
)
def same_offer(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: f"substring_index(substring_index(candidate_id, '-', {i}), '-', -1)"
    c = candidates(spark, d).withColumn("n", F.expr(part(2)).cast("int"))
    c = c.withColumn("source_url", F.expr(f"concat('https://', case when n % 2 = 0 then 'www.' else '' end, 'Shop.example.com/p/', {part(3)}, case when n % 3 = 0 then '/' else '' end, '?v=', n)"))
    # written, so that both sides of the pairs read it and share one shuffle
    made = written(gt.listing(c).select("product_id", *gt.LISTING_COLUMNS), work_folder(spark, "listings"))
    p = ev.pairs(made, gt.LISTING_COLUMNS)
    return gt.same_offer(p).select("candidate_id_a", "candidate_id_b", "same_offer")


@query("q_variant_select", "WITH o AS (SELECT l_partkey AS page_id, l_suppkey AS v, count(*) AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL) SELECT page_id, CAST(v AS VARCHAR) AS variant_id, price FROM o JOIN part ON p_partkey = page_id WHERE n = 1 AND v = p_size % 10 + 1")
def variant_select(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "part").selectExpr("p_partkey AS page_id", "concat('https://www.shop.example.com/p/', p_partkey, '/?utm=1&variant=', p_size % 10 + 1) AS url")
    found = table(spark, d, "lineitem").selectExpr("l_partkey AS page_id", "concat('https://shop.example.com/p/', l_partkey, '?variant=', l_suppkey) AS url", "l_extendedprice AS price")
    return gt.select_variant(found, requests).select("page_id", "variant_id", "price")


_EURO = {"SOURCE_IDENTITY": "data_kind <> 'live'", "IMAGE_MISSING_OR_INVALID": "sku IS NULL", "SAR_PRICE_INVALID": "NOT coalesce(product_price > 0, false) OR currency <> 'SAR'", "ORIGINAL_PRICE_OR_CURRENCY_INVALID": "NOT coalesce(product_price > 0, false)", "FX_PROVENANCE_MISSING": "model_number IS NULL", "UNSUPPORTED_SAUDI_DELIVERY_CLAIM": "can_ship_to_saudi"}


@query("q_european_yield", f"{OFFERS_SQL}, u AS (SELECT merchant, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _EURO.items()) + "], lambda x: x IS NOT NULL)) AS issue FROM offers) SELECT merchant, issue, count(*) AS offers FROM u GROUP BY ALL")
def european_yield(spark: SparkSession, d: str) -> DataFrame:
    made = {"source_country": F.lit("DE"), "spec_country": F.lit("DE"), "spec_currency": F.lit("EUR"), "original_price": F.col("product_price"), "original_currency": F.lit("EUR"), "fx_rate": F.lit(4.1), "fx_source": F.col("model_number"), "fx_observed_at": F.col("observed_at"), "image": F.concat(F.lit("https://i/"), "sku")}
    issues = gt.european_issues("spec_country", "spec_currency")
    return offers(spark, d).withColumns(made).select("merchant", F.explode(issues).alias("issue")).groupBy("merchant", "issue").agg(F.count("*").alias("offers"))


_MESSAGES = {"HTTP status 403 for /p": "HTTP_403_ACCESS_DENIED", "Too many requests": "HTTP_429_RATE_LIMITED", "request timed out": "HTTP_TIMEOUT", "AbortError": "HTTP_ABORTED", "price missing on page": "PRICE_EVIDENCE_INCOMPLETE", "json parse failed": "EXTRACTION_FAILURE", "status: 503": "HTTP_5XX_SOURCE_FAILURE", "socket hang up": "SOURCE_TRANSPORT_FAILURE", "model 403 not in stock": "UNKNOWN", "block page": "HTTP_200_BLOCK_PAGE"}
_CLASS_SQL = f"WITH f AS (SELECT concat('source_', user_id % 40) AS source_id, CASE WHEN event_id % 17 = 0 THEN 'HTTP_404_RESOURCE_NOT_FOUND' ELSE {_mapped(_case('event_id', list(_MESSAGES)), _MESSAGES, '')} END AS failure_class FROM events), m AS (SELECT source_id, failure_class, count(*) AS events FROM f GROUP BY ALL)"


def _failures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id", "concat('source_', user_id % 40) AS source_id", "case when event_id % 17 = 0 then 404 end AS status", f"{_case('event_id', list(_MESSAGES))} AS message")


@query("q_failure_classes", f"{_CLASS_SQL} SELECT * FROM m")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    return cov.failure_events(_failures(spark, d))


@query("q_failure_totals", f"{_CLASS_SQL} SELECT sum(events)::BIGINT AS events, (sum(events) FILTER (failure_class <> 'UNKNOWN'))::BIGINT AS classified, count(DISTINCT source_id) AS sources, count(DISTINCT source_id) FILTER (source_id IN ('source_1', 'source_2')) AS core_sources, count(DISTINCT source_id) FILTER (source_id NOT IN ('source_1', 'source_2')) AS optional_sources FROM m")
def failure_totals(spark: SparkSession, d: str) -> DataFrame:
    return cov.failure_totals(cov.failure_events(_failures(spark, d)), ["source_1", "source_2"])


@query("q_recoverable", f"WITH f AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 'HTTP_404_RESOURCE_NOT_FOUND' ELSE {_mapped(_case('event_id', list(_MESSAGES)), _MESSAGES, '')} END AS c FROM events WHERE user_id % 40 IN (1, 2)) SELECT user_id, bool_or(c IN ('HTTP_TIMEOUT', 'HTTP_ABORTED', 'SOURCE_TRANSPORT_FAILURE', 'HTTP_5XX_SOURCE_FAILURE')) AND NOT bool_or(c IN ('HTTP_403_ACCESS_DENIED', 'HTTP_429_RATE_LIMITED')) AS recoverable FROM f GROUP BY user_id")
def recoverable(spark: SparkSession, d: str) -> DataFrame:
    marked = _failures(spark, d).withColumn("failure_class", cov.failure_class(F.col("status"), F.col("message")))
    return cov.recoverable(marked, "user_id", ["source_1", "source_2"])


_STATIC = "SELECT concat('s', s_suppkey) AS source_id, n_name AS country, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_REGISTRY = f"""WITH st AS ({_STATIC}), r AS (SELECT st.*, CASE WHEN s.s_suppkey % 3 <> 0 THEN concat('adapter_', s.s_suppkey % 4) END AS adapter, CASE WHEN s.s_suppkey % 3 = 0 THEN 'candidate' WHEN s.s_suppkey % 4 IN (0, 1) THEN 'configured' ELSE 'disabled' END AS status FROM st JOIN supplier s ON source_id = concat('s', s.s_suppkey)
UNION ALL SELECT concat('c', c_custkey), n_name, r_name, 'dynamic', 'configured' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    static = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey", "concat('s', s_suppkey) AS source_id", "n_name AS country", "r_name AS region")
    adapters = t("supplier").where("s_suppkey % 3 <> 0").selectExpr("concat('s', s_suppkey) AS source_id", "concat('adapter_', s_suppkey % 4) AS adapter")
    configured = adapters.where("adapter in ('adapter_0', 'adapter_1')").select("adapter").distinct()
    dynamic = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("concat('c', c_custkey) AS source_id", "n_name AS country", "r_name AS region")
    known = static.drop("s_suppkey")
    return cov.registry(known, adapters, configured, dynamic.unionByName(known))


@query("q_registry", f"{_REGISTRY} SELECT * FROM r")
def registry(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d)


@query("q_source_summary", f"{_REGISTRY} SELECT count(*) AS sources, count(*) FILTER (status = 'configured') AS configured, count(*) FILTER (status = 'disabled') AS disabled, count(*) FILTER (status = 'candidate') AS candidate, count(DISTINCT country) AS countries, count(DISTINCT region) AS regions FROM r")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return cov.source_summary(_registry(spark, d))


@query("q_wave_evidence", f"{OBSERVATIONS_SQL}, w AS (SELECT source_id, coalesce(offers, 0) AS n, CASE kind WHEN 'view' THEN NULL WHEN 'error' THEN false ELSE true END AS ok FROM observations) SELECT source_id, count(*) AS reports, count(*) FILTER (n > 0) AS with_offers, sum(n)::BIGINT AS reported_offers, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS no_success, count(*) FILTER (ok IS NULL) AS unknown FROM w GROUP BY source_id")
def wave_evidence(spark: SparkSession, d: str) -> DataFrame:
    ok = F.when(F.col("kind") == "view", F.lit(None)).otherwise(F.col("kind") != "error")
    return cov.wave_evidence(observations(spark, d).select("source_id", F.col("offers").alias("returned_offers"), ok.alias("ok")), ["source_id"])


@query("q_storefront_audit", f"{OBSERVATIONS_SQL}, g AS (SELECT product_id, count(*) FILTER (kind = 'purchase') AS o, count(*) AS c, count(*) FILTER (kind = 'error') AS f FROM observations GROUP BY product_id), s AS (SELECT CASE WHEN o > 3 THEN 'LIVE_VERIFIED' WHEN f >= c - 3 THEN 'BLOCKED_OR_RESOLUTION_FAILED' WHEN c > 3 THEN 'CONNECTED_NO_VERIFIED_PRICE' ELSE 'CONNECTED_NO_CANDIDATES' END AS state FROM (SELECT o, c, CASE WHEN c > 3 THEN f ELSE -99 END AS f FROM g)) SELECT state, count(*) AS stores FROM s GROUP BY state")
def storefront_audit(spark: SparkSession, d: str) -> DataFrame:
    g = observations(spark, d).groupBy("product_id").agg(F.count_if(F.col("kind") == "purchase").alias("o"), F.count("*").alias("c"), F.count_if(F.col("kind") == "error").alias("f"))
    return g.groupBy(cov.audit_state(F.col("o") - 3, F.col("c") - 3, F.col("f")).alias("state")).agg(F.count("*").alias("stores"))


@query("q_coverage_status", "WITH t AS (SELECT o_orderkey % 9 = 0 AS deadline, o_custkey % 4 AS pending, o_orderkey % 5 AS reported, o_orderkey % 3 AS core, o_custkey % 2 AS optional FROM orders) SELECT CASE WHEN deadline THEN 'deadline' WHEN pending > 0 THEN 'pending' WHEN reported = 0 THEN 'complete' WHEN core > 0 AND optional > 0 THEN 'partial_core_and_optional' WHEN core > 0 THEN 'partial_core' WHEN optional > 0 THEN 'partial_optional' ELSE 'partial' END AS status, count(*) AS n FROM t GROUP BY status")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    status = cov.coverage_status(e("o_orderkey % 9 = 0"), e("o_custkey % 4"), e("o_orderkey % 5"), e("o_orderkey % 3"), e("o_custkey % 2"))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("q_recall_evidence", f"{OFFERS_SQL}, h AS (SELECT *, CASE WHEN sku IS NULL THEN '' ELSE title END AS t, provider = 'provider_2' AS ex, (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(observed_at)) / 1e6 AS age FROM offers) SELECT category, count(*) AS fetched, count(*) FILTER (t <> '' AND NOT ex AND age BETWEEN -60 AND 8640000) AS accepted, count(*) FILTER (t <> '' AND NOT ex AND NOT age BETWEEN -60 AND 8640000) AS rejected_stale, count(*) FILTER (t <> '' AND ex) AS rejected_excluded, count(*) FILTER (t = '') AS rejected_malformed FROM h GROUP BY category")
def recall_evidence(spark: SparkSession, d: str) -> DataFrame:
    hits = offers(spark, d).withColumn("title", F.when(F.col("sku").isNull(), "").otherwise(F.col("title"))).withColumn("name", F.when(F.col("provider") == "provider_2", "Decathlon").otherwise(F.col("merchant")))
    return cov.recall_evidence(hits, ["category"], cat.hit_reason(OFFERS_NOW, 8_640_000, F.col("name")))


@query("q_catalog_windows", f"{OFFERS_SQL}, r AS (SELECT category, offer_id, row_number() OVER (PARTITION BY category ORDER BY match_confidence DESC, offer_id) - 1 AS i FROM offers) SELECT category, offer_id, CASE WHEN i < 120 THEN 0 WHEN i < 500 THEN 1 ELSE 2 END AS depth FROM r WHERE i < 1000")
def catalog_windows(spark: SparkSession, d: str) -> DataFrame:
    return cov.windowed(offers(spark, d), ["category"], [F.desc("match_confidence"), F.asc("offer_id")], cov.CATALOG_WINDOWS).select("category", "offer_id", "depth")


@query("q_catalog_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE CAST(p_partkey AS BIGINT) END AS total, CASE WHEN p_size % 3 = 0 THEN 1 END::BIGINT AS current_start, CASE WHEN p_size % 3 = 0 THEN p_size END::BIGINT AS current_end, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 24 END::BIGINT AS page_size, CASE WHEN p_size % 3 = 0 THEN 1200 END::BIGINT AS price_max, p_size % 3 = 0 AND p_size < p_partkey AS has_more, CASE p_size % 3 WHEN 0 THEN p_partkey >= p_size WHEN 1 THEN true ELSE false END AS passed FROM part")
def catalog_text(spark: SparkSession, d: str) -> DataFrame:
    html = "case p_size % 3 when 0 then concat('<p>1 - ', p_size, ' of <b>', p_partkey, '</b> products</p><i>99 SAR - 1,200 SAR</i>') when 1 then concat('<h1>', p_partkey, ' products</h1> Sort <span>Item per page</span> 24') else '<p>nothing</p>' end"
    out = cov.catalog_text(F.expr(html))
    return table(spark, d, "part").select("p_partkey", *[out[c].alias(c) for c in ("total", "current_start", "current_end", "page_size", "price_max", "has_more", "passed")])


_NEAR = [("ring", "widget"), ("bolt", "gear"), ("gear", "bolt")]


@query(
    "q_route_sources",
    """WITH q AS (SELECT DISTINCT r_regionkey, r_name, c.category FROM region, (SELECT DISTINCT split_part(p_name, ' ', 2) AS category FROM part) c), near(a, b) AS (VALUES ('ring', 'widget'), ('bolt', 'gear'), ('gear', 'bolt')),
    st AS (SELECT concat('s', s_suppkey) AS store_id, s_suppkey, n_regionkey, CASE WHEN s_suppkey % 4 = 0 THEN 'SA' WHEN s_suppkey % 4 = 1 THEN 'AE' ELSE 'US' END AS country, CASE s_suppkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'ring' WHEN 2 THEN 'gear' WHEN 3 THEN 'widget' ELSE 'bolt' END AS cat, s_suppkey % 10 = 0 AS general FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    m AS (SELECT concat(r_name, '/', category) AS query_id, st.*, category, s_suppkey % 9 = 0 AS brand, cat = category AS exact, cat = '*' AS broad, EXISTS (SELECT 1 FROM near WHERE a = category AND b = cat) AS adjacent FROM q JOIN st ON n_regionkey = r_regionkey),
    s AS (SELECT *, CASE WHEN brand THEN 120 ELSE 0 END + CASE WHEN exact THEN 65 WHEN adjacent THEN 24 ELSE 0 END + CASE WHEN broad THEN 32 ELSE 0 END + CASE country WHEN 'SA' THEN 8 WHEN 'AE' THEN 5 ELSE 2 END + CASE WHEN general THEN 8 ELSE 0 END + CASE WHEN general AND country = 'SA' THEN 24 ELSE 0 END + greatest(-20, least(20, s_suppkey % 61 - 30)) AS score FROM m WHERE exact OR adjacent OR broad OR brand)
    SELECT query_id, store_id, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY brand DESC, exact DESC, (general AND country = 'SA') DESC, score DESC, store_id) AS place FROM s WHERE score > 0""",
)
def route_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each region's stores for a query of each category there."""
    t = lambda n: table(spark, d, n)
    kinds = t("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category")).groupBy(F.lit(1).alias("one")).agg(F.collect_set("category").alias("kinds"))  # the categories are a few words
    asked = t("region").withColumn("one", F.lit(1)).join(kinds, "one").select("r_regionkey", "r_name", F.explode("kinds").alias("category"))
    store = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("n_regionkey", "s_suppkey", "concat('s', s_suppkey) AS store_id", "case when s_suppkey % 4 = 0 then 'SA' when s_suppkey % 4 = 1 then 'AE' else 'US' end AS country", "array(case s_suppkey % 5 when 0 then '*' when 1 then 'ring' when 2 then 'gear' when 3 then 'widget' else 'bolt' end) AS categories", "case when s_suppkey % 9 = 0 then array('best', 'acme') else array('acme') end AS brands", "s_suppkey % 10 = 0 AS general")
    rows = store.join(asked, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("query_id", F.concat("r_name", F.lit("/"), "category")).withColumn("q", F.concat(F.lit("best "), "category"))
    near = spark.createDataFrame(_NEAR, "category string, near string")
    return cov.route(rows, F.col("q"), F.col("category"), near, F.expr("cast(s_suppkey % 61 - 30 as int)")).select("query_id", "store_id", F.col("score").cast("int").alias("score"), "place")


@query("q_search_runs", f"WITH r AS (SELECT concat('source_', user_id % 40) AS source_id, {_case('event_id', list(cov.SEARCH_CASES))} AS case_type, event_id % 4 AS n, (event_id % 7) / 100e0 AS dup FROM events), g AS (SELECT source_id, sum(n)::BIGINT AS results, count(DISTINCT CASE WHEN (CASE WHEN case_type = 'zero-result' THEN n = 0 ELSE n > 0 END) AND dup <= 0.05e0 THEN case_type END) AS cases_passed FROM r GROUP BY source_id) SELECT source_id, results, cases_passed, cases_passed = 5 AS passed FROM g")
def search_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").selectExpr("concat('source_', user_id % 40) AS source_id", f"{_case('event_id', list(cov.SEARCH_CASES))} AS case_type", "event_id % 4 AS result_count", "cast(event_id % 7 as double) / 100e0 AS duplicate_rate")
    return cov.search_runs(runs, "source_id")


@query("q_end_to_end", f"WITH s AS (SELECT user_id, {_case('event_id', list(cov.E2E_STAGES))} AS stage, event_type <> 'error' AS ok FROM events), k AS (SELECT user_id, list(DISTINCT stage) FILTER (ok) AS done FROM s GROUP BY user_id), m AS (SELECT user_id, list_filter({list(cov.E2E_STAGES)}, lambda x: NOT coalesce(list_contains(done, x), false)) AS missing FROM k) SELECT user_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS passed FROM m")
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return cov.end_to_end(table(spark, d, "events").selectExpr("user_id", f"{_case('event_id', list(cov.E2E_STAGES))} AS stage", "event_type <> 'error' AS passed"), "user_id")


_VECTOR = {"correctness": "avg(confidence)", "completeness": "avg(CASE WHEN sku IS NOT NULL THEN 1e0 ELSE 0e0 END)", "stability": "avg(CASE WHEN gtin IS NOT NULL THEN 1e0 ELSE 0e0 END)", "speed": "avg(CASE WHEN model IS NOT NULL THEN 1e0 ELSE 0e0 END)", "repeatability": "avg(CASE WHEN availability IS NOT NULL THEN 1e0 ELSE 0e0 END)", "maintainability": "avg(CASE WHEN currency = 'SAR' THEN 1e0 ELSE 0e0 END)", "resource_cost": "avg(CASE WHEN name IS NOT NULL THEN 1e0 ELSE 0e0 END)"}


@query(
    "q_probe_rank",
    f"{CANDIDATES_SQL}, m AS (SELECT brand, strategy, " + ", ".join(f"floor({e} * 100) / 100 AS {n}" for n, e in _VECTOR.items()) + " FROM candidates GROUP BY ALL), s AS (SELECT brand, strategy, floor((0e0 + correctness * 0.25e0 + completeness * 0.18e0 + stability * 0.15e0 + speed * 0.12e0 + repeatability * 0.1e0 + maintainability * 0.1e0 + resource_cost * 0.1e0) * 10000 + 0.5) / 100 AS score FROM m) SELECT brand, strategy, score, row_number() OVER (PARTITION BY brand ORDER BY score DESC, strategy) AS place, max(score) OVER (PARTITION BY brand) < 85 AS deep_probe FROM s",
)
def probe_rank(spark: SparkSession, d: str) -> DataFrame:
    metrics = candidates(spark, d).groupBy("brand", "strategy").agg(*[F.expr(f"floor({e} * 100) / 100 AS {n}") for n, e in _VECTOR.items()])
    return cov.rank_probes(metrics, "brand").select("brand", "strategy", "score", "place", "deep_probe")


@query(
    "q_differential",
    f"""{CANDIDATES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY candidate_id, price, strategy) AS turn FROM candidates), j AS (SELECT a.product_id, a.strategy AS left_strategy, b.strategy AS right_strategy, unnest([struct_pack(f := 'price', l := CAST(a.price AS VARCHAR), r := CAST(b.price AS VARCHAR)), struct_pack(f := 'currency', l := a.currency, r := b.currency), struct_pack(f := 'sku', l := a.sku, r := b.sku), struct_pack(f := 'availability', l := a.availability, r := b.availability)]) AS x FROM k a JOIN k b ON a.product_id = b.product_id AND a.turn = 1 AND b.turn > 1)
    SELECT product_id, left_strategy, right_strategy, x.f AS field, count(*) AS n FROM j WHERE x.l <> x.r GROUP BY ALL""",
)
def differential(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("product_id").orderBy("candidate_id", "price", "strategy"))
    rows = cov.differential(candidates(spark, d).withColumn("turn", turn), "product_id")
    return rows.groupBy("product_id", "left_strategy", "right_strategy", "field").agg(F.count("*").alias("n"))


@query("q_pagination_walk", "WITH RECURSIVE l AS (SELECT p_partkey AS page, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_partkey - 2 ELSE p_partkey + 1 END AS next FROM part), w(start, last, seen, termination) AS (SELECT page, page, [page], NULL::VARCHAR FROM l UNION ALL SELECT start, CASE WHEN next IS NULL OR list_contains(seen, next) THEN last ELSE next END, CASE WHEN next IS NULL OR list_contains(seen, next) THEN seen ELSE list_append(seen, next) END, CASE WHEN next IS NULL THEN 'natural-end' WHEN list_contains(seen, next) THEN 'cycle' WHEN len(seen) = 5 THEN 'max-pages' END FROM w LEFT JOIN l ON page = last WHERE termination IS NULL AND len(seen) <= 5) SELECT start, CASE WHEN termination = 'max-pages' THEN 5 ELSE len(seen) END::INT AS pages, CASE WHEN termination = 'max-pages' THEN seen[5] ELSE last END AS last, termination FROM w WHERE termination IS NOT NULL")
def pagination_walk(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "part").selectExpr("p_partkey AS page", "case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then p_partkey - 2 else p_partkey + 1 end AS next")
    return cov.walk(spark, links, links.select("page"))


@query("q_sitemap", "WITH k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT concat('shop', l_suppkey, '.example.com') AS merchant_host, CASE WHEN l_suppkey % 4 = 1 THEN 'SITEMAP_INDEX_REQUIRES_CHILDREN' WHEN l_suppkey % 4 = 2 THEN 'INVALID_OR_UNTRUSTED_SITEMAP' WHEN l_suppkey % 4 = 3 THEN 'NOT_A_URL_SITEMAP' ELSE 'SITEMAP_URLSET_PARSED' END AS reason, CASE WHEN l_suppkey % 4 = 0 THEN count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) ELSE 0 END AS urls FROM k GROUP BY l_suppkey")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's sitemap lists its parts: some twice, some on another host."""
    entry = "concat('<url><loc> https://', case when l_partkey % 3 = 0 then 'cdn.example.com' else concat('Shop', l_suppkey, '.example.com') end, '/p/', l_partkey, '?a=1&amp;b=2#x</loc></url>')"
    kept = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.expr(entry))), "").alias("e"))
    xml = "case l_suppkey % 4 when 0 then concat('<?xml version=\"1.0\"?><urlset>', e, e, '</urlset>') when 1 then '<sitemapindex></sitemapindex>' when 2 then '<!DOCTYPE x><urlset></urlset>' else '<feed></feed>' end"
    out = cov.sitemap_urls(kept.selectExpr("concat('shop', l_suppkey, '.example.com') AS merchant_host", f"{xml} AS xml"))
    return out.select("merchant_host", "reason", F.size("urls").cast("long").alias("urls"))


@query("q_normalize_query", r"SELECT p_partkey, concat(p_name, ' ps5 ', p_size, 'gb ', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' laptop' ELSE '' END) AS normal FROM part")
def normalize_query(spark: SparkSession, d: str) -> DataFrame:
    raw = "concat('Please find ', upper(p_name), ', PlayStation 5 ', p_size, ' GB / ', p_partkey, 'th', case when p_partkey % 2 = 0 then ' ordinateur portable' else '' end)"
    return table(spark, d, "part").select("p_partkey", tx.query_normalizer({}, {"ordinateur portable": "laptop", "ordinateur": "computer"})(F.expr(raw)).alias("normal"))


@query("q_models", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'iphone 15 pro max' WHEN 1 THEN 'galaxy s24 ultra,galaxy s23' WHEN 2 THEN 'dyson v15' ELSE '' END AS models FROM part")
def named_models(spark: SparkSession, d: str) -> DataFrame:
    titles = ["Apple iPhone-15 Pro Max case", "Galaxy S24 Ultra, not Galaxy S23", "Dyson V15 detect", "plain"]
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.models(tx.plain_text(F.expr(_case("p_partkey", titles)))), ",").alias("models"))


_WORD_CATEGORIES = {"HP LaserJet": "printer", "iPhone 15 case": "accessory", "leather sofas": "furniture", "Galaxy Tab S9": "tablet", "rope": "none", "Trail Running Shoes": "shoes"}


@query("q_category", f"SELECT {_mapped(_case('p_partkey', list(_WORD_CATEGORIES)), _WORD_CATEGORIES, '')} AS category, count(*) AS n FROM part GROUP BY ALL")
def word_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.coalesce(mt.category(F.expr(_case("p_partkey", list(_WORD_CATEGORIES)))), F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query("q_sold_role", f"{OFFERS_SQL} SELECT CASE WHEN category IN ('bolt', 'gear') THEN 'accessory' ELSE 'product' END AS role, count(*) AS n FROM offers GROUP BY role")
def sold_role(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy(mt.sold_role(F.concat("title", F.lit(" with charger"))).alias("role")).agg(F.count("*").alias("n"))


@query("q_fuzzy_ratio")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(tx.fuzzy_ratio(tx.folded_text(F.col("p_name")), tx.folded_text(F.concat(F.upper("p_name"), F.lit("!"), "p_brand"))), 6).alias("ratio"))


BROAD = mt.parse_intent("new red widget", CATEGORIES, COLORS)
_BROAD = """w AS (SELECT *, string_split(trim(regexp_replace(lower(concat(title, ' ', brand)), '[^a-z0-9]+', ' ', 'g')), ' ') AS w, string_split(title, ' ') AS tw FROM {0}),
s AS (SELECT *, floor(greatest(0e0, least(1e0, (CASE WHEN category = 'widget' THEN ((list_contains(w, 'red'))::INT + 1) / 2e0 ELSE (list_contains(w, 'red'))::INT * 0.2e0 END) * (CASE WHEN list_has_any(w, ['case','cover','charger','protector','strap','bolt','gear']) THEN 0.12e0 ELSE 1e0 END) - CASE WHEN condition NOT IN ('new', 'unknown') THEN 0.15e0 ELSE 0e0 END)) * 100 + 0.5) / 100 AS query_score FROM w)"""


@query("q_retain_acquired", f"{OFFERS_SQL}, {_BROAD.format('offers')} SELECT offer_id, query_score FROM s WHERE query_score >= 0.65e0")
def retain_acquired(spark: SparkSession, d: str) -> DataFrame:
    return mt.retain_acquired(offers(spark, d), BROAD).select("offer_id", "query_score")


@query("q_retain_related", f"{OFFERS_SQL}, n AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY product_id, merchant, condition ORDER BY observed_at DESC NULLS LAST, (data_kind = 'live') DESC, offer_id) = 1), {_BROAD.format('n')} SELECT offer_id, query_score FROM s WHERE query_score >= 0.35e0 OR (list_contains(tw, 'red') AND list_contains(tw, 'widget'))")
def retain_related(spark: SparkSession, d: str) -> DataFrame:
    return mt.retain_related(offers(spark, d), BROAD, ["product_id", "merchant", "condition"]).select("offer_id", "query_score")


@query("q_read_boundary", f"{OFFERS_SQL}, k AS (SELECT DISTINCT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as bigint)) AS offer_id FROM lineitem WHERE l_returnflag = 'R') SELECT offer_id, observed_at FROM offers WHERE offer_id IN (SELECT offer_id FROM k) AND (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(observed_at)) / 1e6 BETWEEN -60 AND 86400000")
def read_boundary(spark: SparkSession, d: str) -> DataFrame:
    keys = offers(spark, d).where("availability = 'out_of_stock'").select("offer_id")
    return cat.read_by_key(offers(spark, d), keys, "offer_id", OFFERS_NOW, 86_400_000).select("offer_id", "observed_at")


@query("q_index_sink", f"{OFFERS_SQL}, i AS (SELECT product_id, max(observed_at) AS t FROM offers WHERE data_kind = 'indexed' GROUP BY product_id), n AS (SELECT product_id, max(observed_at) AS t FROM offers WHERE data_kind = 'live' AND product_price > 0 AND currency = 'SAR' GROUP BY product_id) SELECT n.product_id, CASE WHEN i.t IS NULL THEN 'add' WHEN n.t > i.t THEN 'replace' ELSE 'skip' END AS action FROM n LEFT JOIN i ON i.product_id = n.product_id")
def index_sink(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d)
    current = o.where("data_kind = 'indexed'").groupBy("product_id").agg(F.max("observed_at").alias("observed_at"))
    incoming = o.where("data_kind = 'live'").where(gt.structurally_valid()).groupBy("product_id").agg(F.max("observed_at").alias("observed_at"))
    return cat.index_writes(current, incoming, "product_id")


