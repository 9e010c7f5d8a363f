"""Queries over candidates and observations, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.operators import evidence as ev
from quaylens.operators import reliability as rel
from quaylens.plans.registry import query
from quaylens.schema import EVENTS_NOW, OFFERS_NOW
from quaylens.sources.views import CANDIDATES_SQL, OBSERVATIONS_SQL, candidates, observations, offers, table
from quaylens.sources.views import OFFERS_SQL

_AGE = f"(CASE WHEN observed_at IS NULL THEN NULL ELSE greatest(0e0, (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(observed_at)) / 1e6) END)"


def _fresh_sql(age: str) -> str:
    return f"(CASE WHEN {age} IS NULL THEN 0.5e0 WHEN {age} > 172800 THEN 0.2e0 WHEN {age} > 21600 THEN floor((0.85e0 - ({age} - 21600) / 151200e0 * 0.55e0) * 1000 + 0.5) / 1000 ELSE 1e0 END)"


def _trust_sql(field: str) -> str:
    t = ev.BY_FIELD.get(ev.FIELD_TABLE.get(field, ""), {})
    w = "CASE strategy " + " ".join(f"WHEN '{s}' THEN {t.get(s, g)}::DOUBLE" for s, g in ev.GENERAL.items()) + " ELSE 0.8e0 END"
    fresh = f"(0.75e0 + {_fresh_sql('age')} * 0.25e0)" if field in ("price", "availability") else f"(0.9e0 + {_fresh_sql('age')} * 0.1e0)"
    return f"coalesce(confidence, 0e0) * {w} * {fresh}"


_AGED = f"{CANDIDATES_SQL}, aged AS (SELECT *, {_AGE} AS age FROM candidates)"


@query("q_freshness", f"{OFFERS_SQL}, a AS (SELECT *, {_AGE.replace(OFFERS_NOW, '2001-06-01 00:00:00')} AS age FROM offers) SELECT merchant, CASE WHEN age IS NULL THEN 'unknown' WHEN age > 172800 THEN 'stale' WHEN age > 21600 THEN 'aging' ELSE 'fresh' END AS status, count(*) AS offers, min({_fresh_sql('age')}) AS low, max({_fresh_sql('age')}) AS high FROM a GROUP BY ALL")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    weight, status = ev.freshness(F.col("observed_at"), "2001-06-01 00:00:00")
    return offers(spark, d).groupBy("merchant", status.alias("status")).agg(F.count("*").alias("offers"), F.min(weight).alias("low"), F.max(weight).alias("high"))


@query(
    "q_observation_freshness",
    f"{OBSERVATIONS_SQL}, a AS (SELECT *, greatest(0e0, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(observed_at)) / 1e6) AS age FROM observations) SELECT event_id, CASE WHEN age > 172800 THEN 'stale' WHEN age > 21600 THEN 'aging' ELSE 'fresh' END AS status, {_fresh_sql('age')} AS weight FROM a",
)
def observation_freshness(spark: SparkSession, d: str) -> DataFrame:
    weight, status = ev.freshness(F.col("observed_at"), EVENTS_NOW)
    return observations(spark, d).select("event_id", status.alias("status"), weight.alias("weight"))


@query("q_preferred_candidate", f"{_AGED}, t AS (SELECT product_id, candidate_id, strategy, price, {_trust_sql('price')} AS trust FROM aged WHERE price IS NOT NULL) SELECT product_id, candidate_id, strategy, price, trust FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY trust DESC, candidate_id) AS rn FROM t) WHERE rn = 1")
def preferred(spark: SparkSession, d: str) -> DataFrame:
    return ev.preferred(candidates(spark, d), "price", OFFERS_NOW).select("product_id", "candidate_id", "strategy", "price", "trust")


_FIELDS = ["name", "brand", "sku", "model", "gtin", "availability"]


@query(
    "q_reconcile",
    _AGED + ", r AS (" + " UNION ALL ".join(f"SELECT product_id, '{f}' AS field, CAST({f} AS VARCHAR) AS value, candidate_id, {_trust_sql(f)} AS trust FROM aged WHERE {f} IS NOT NULL" for f in _FIELDS) + ") SELECT product_id, field, value, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field ORDER BY trust DESC, candidate_id DESC) AS rn FROM r) WHERE rn = 1",
)
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return ev.reconcile(candidates(spark, d), _FIELDS, OFFERS_NOW)


_TOK = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_SIM = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0e0 ELSE len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))::DOUBLE END)"
_PAIRS = f"""{CANDIDATES_SQL}, k AS (SELECT *, list_distinct({_TOK.format('name')}) AS toks FROM candidates),
p AS (SELECT a.product_id, a.candidate_id AS candidate_id_a, b.candidate_id AS candidate_id_b, a.price AS pa, b.price AS pb, a.currency AS ca, b.currency AS cb, a.availability AS va, b.availability AS vb, a.name AS na, b.name AS nb, a.toks AS ta, b.toks AS tb,
  a.gtin AS ga, b.gtin AS gb, a.sku AS sa, b.sku AS sb, a.model AS ma, b.model AS mb, a.brand AS ba, b.brand AS bb FROM k a JOIN k b ON a.product_id = b.product_id AND a.candidate_id < b.candidate_id)"""
_GAP = "(abs(pa - pb) / greatest(abs(pa), abs(pb), 1e0))"
_CONFLICTS = f"""{_PAIRS}, s AS (SELECT *, {_SIM.format('ta', 'tb')} AS sim FROM p),
c AS (SELECT product_id, candidate_id_a, candidate_id_b, 'price' AS field, CASE WHEN {_GAP} >= 0.15e0 THEN 'high' ELSE 'medium' END AS severity, {_GAP} AS measure FROM s WHERE ca = cb AND {_GAP} >= 0.03e0
  UNION ALL SELECT product_id, candidate_id_a, candidate_id_b, 'availability', 'medium', 1e0 FROM s WHERE ca = cb AND va <> vb
  UNION ALL SELECT product_id, candidate_id_a, candidate_id_b, 'name', CASE WHEN sim < 0.2e0 THEN 'high' ELSE 'medium' END, sim FROM s WHERE na IS NOT NULL AND nb IS NOT NULL AND sim < 0.45e0)"""


@query("q_conflicts", f"{_CONFLICTS} SELECT * FROM c")
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ev.conflicts(candidates(spark, d))


@query("q_conflict_summary", f"{_CONFLICTS} SELECT product_id, count(*) AS conflicts, count(*) FILTER (severity = 'high') AS high, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM c GROUP BY product_id")
def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    fields = F.concat_ws(",", *[F.when(F.bool_or(F.col("field") == f), f) for f in ("availability", "name", "price")])
    return ev.conflicts(candidates(spark, d)).groupBy("product_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("severity") == "high").alias("high"), fields.alias("fields"))


@query("q_token_similarity", f"{_PAIRS} SELECT candidate_id_a, candidate_id_b, {_SIM.format('ta', 'tb')} AS similarity FROM p WHERE na IS NOT NULL AND nb IS NOT NULL")
def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    from quaylens.functions.text import token_similarity as similarity

    p = ev.pairs(ev.prepared(candidates(spark, d).where("name is not null")), ["candidate_id", "words"])
    return p.select("candidate_id_a", "candidate_id_b", similarity(F.col("words_a"), F.col("words_b")).alias("similarity"))


def _ev_sql(a: str, b: str, w: float) -> str:
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0e0 WHEN {a} = {b} THEN {w}e0 ELSE -{w}e0 END)"


def _verdict_sql(source: str) -> str:
    return f"""e AS (SELECT *, {_ev_sql('ga', 'gb', 0.45)} AS g, {_ev_sql('sa', 'sb', 0.35)} AS s, {_ev_sql('ma', 'mb', 0.22)} AS m, CASE WHEN ba = bb THEN 0.12e0 WHEN ba <> bb THEN -0.22e0 ELSE 0e0 END AS b,
      CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN {_SIM.format("list_filter(ta, lambda t: length(t) > 1)", "list_filter(tb, lambda t: length(t) > 1)")} END AS t FROM {source}),
    sc AS (SELECT *, greatest(0e0, least(1e0, floor((0.5e0 + g + s + m + b + CASE WHEN t >= 0.75e0 THEN 0.16e0 WHEN t >= 0.45e0 THEN 0.06e0 WHEN t < 0.2e0 THEN -0.28e0 ELSE 0e0 END) * 1000 + 0.5) / 1000)) AS score, coalesce(t >= 0.75e0, false) AS st FROM e),
    v AS (SELECT *, CASE WHEN g < 0 OR (s < 0 AND NOT (g > 0 OR s > 0 OR m > 0 OR b > 0 OR st)) OR (m < 0 AND b < 0) OR score < 0.3e0 THEN 'different' WHEN score >= 0.78e0 OR g > 0 OR s > 0 THEN 'same' WHEN score >= 0.58e0 OR (b > 0 AND st AND m >= 0) THEN 'likely_same' ELSE 'uncertain' END AS verdict FROM sc)"""


@query("q_identity_compare", f"{_PAIRS}, {_verdict_sql('p')} SELECT product_id, candidate_id_a, candidate_id_b, score, verdict FROM v")
def identity_compare(spark: SparkSession, d: str) -> DataFrame:
    p = ev.pairs(ev.prepared(candidates(spark, d)), ev.PREPARED_COLUMNS)
    return ev.identity_verdict(p).select("product_id", "candidate_id_a", "candidate_id_b", "score", "verdict")


@query(
    "q_identity_cluster",
    f"""{CANDIDATES_SQL}, k AS (SELECT *, list_distinct({_TOK.format('name')}) AS toks FROM candidates),
    an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY -coalesce(confidence, 0e0), candidate_id, gtin NULLS FIRST, sku NULLS FIRST, model NULLS FIRST, brand, name NULLS FIRST) AS rn FROM k) WHERE rn = 1),
    j AS (SELECT k.product_id, an.candidate_id AS candidate_id_a, k.candidate_id AS candidate_id_b, an.gtin AS ga, k.gtin AS gb, an.sku AS sa, k.sku AS sb, an.model AS ma, k.model AS mb, an.brand AS ba, k.brand AS bb, an.name AS na, k.name AS nb, an.toks AS ta, k.toks AS tb
      FROM k JOIN an ON an.product_id = k.product_id AND an.candidate_id <> k.candidate_id), {_verdict_sql('j')}
    SELECT product_id, candidate_id_b, verdict, verdict <> 'different' AS accepted FROM v""",
)
def identity_cluster(spark: SparkSession, d: str) -> DataFrame:
    return ev.identity_cluster(candidates(spark, d)).select("product_id", "candidate_id_b", "verdict", "accepted")


@query(
    "q_expected_observed",
    f"""{CANDIDATES_SQL}, x AS (SELECT c.*, p_brand AS eb, concat('MN-', p_partkey % 7) AS em, concat('SKU', p_partkey % 9) AS es FROM candidates c JOIN part ON p_partkey = CAST(split_part(candidate_id, '-', 3) AS BIGINT)),
    y AS (SELECT candidate_id, concat_ws(',', CASE WHEN brand <> eb THEN 'brand' END, CASE WHEN model <> em THEN 'model' END, CASE WHEN sku <> es THEN 'sku' END) AS wrong, concat_ws(',', CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN model IS NULL THEN 'model' END, CASE WHEN sku IS NULL THEN 'sku' END) AS absent FROM x)
    SELECT candidate_id, CASE WHEN wrong <> '' THEN 'REJECT' WHEN absent <> '' THEN 'INSUFFICIENT' ELSE 'CANDIDATE' END AS verdict, CASE WHEN wrong <> '' THEN wrong ELSE absent END AS fields FROM y""",
)
def expected_observed(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey", "p_brand AS expected_brand", "concat('MN-', p_partkey % 7) AS expected_model", "concat('SKU', p_partkey % 9) AS expected_sku")
    seen = candidates(spark, d).withColumn("p_partkey", F.split_part("candidate_id", F.lit("-"), F.lit(3)).cast("long")).join(part, "p_partkey")
    return ev.compare_expected(seen, ["brand", "model", "sku"]).select("candidate_id", "verdict", "fields")


@query(
    "q_enrich_interval",
    f"""{OFFERS_SQL}, f AS (SELECT product_id, min(product_price) AS found_price FROM offers WHERE data_kind = 'live' GROUP BY product_id)
    SELECT offer_id, found_price IS NOT NULL AND (product_price IS NULL OR found_price BETWEEN product_price * 0.5e0 AND product_price * 2) AS admitted, CASE WHEN found_price IS NOT NULL AND (product_price IS NULL OR found_price BETWEEN product_price * 0.5e0 AND product_price * 2) THEN found_price ELSE product_price END AS final_price
    FROM offers LEFT JOIN f USING (product_id)""",
)
def enrich_interval(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d)
    found = o.where("data_kind = 'live'").groupBy("product_id").agg(F.min("product_price").alias("found_price"))
    return ev.enrich_with(o, found, "product_id", "product_price").select("offer_id", "admitted", "final_price")


_RATES = f"""{OBSERVATIONS_SQL}, c AS (SELECT source_id, count(*) AS attempts, count(*) FILTER (transport_ok) AS good, count(*) FILTER (transport_ok AND offers > 0) AS productive, count(*) FILTER (transport_ok AND coalesce(offers, 0) <= 0) AS empty FROM observations GROUP BY source_id),
r AS (SELECT *, (good + 8) / (attempts + 10)::DOUBLE AS transport, (productive + 3) / (productive + empty + 6)::DOUBLE AS yield FROM c), q AS (SELECT *, transport * 0.78e0 + yield * 0.22e0 AS reliability, least(1e0, attempts / 12e0) AS confidence FROM r)"""


@query("q_reliability", f"{_RATES} SELECT source_id, attempts, good, productive, empty, transport, yield, reliability, confidence, CAST(floor((reliability - 0.7e0) * 36 * confidence + 0.5) AS INT) AS adjustment FROM q")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return rel.rates(observations(spark, d))


_FOLDED = """l AS (SELECT source_id, list(struct_pack(l := latency_ms, ok := transport_ok) ORDER BY observed_at, event_id) AS l FROM observations GROUP BY source_id),
f AS (SELECT source_id, list_reduce(list_transform(l, lambda x: x.l), lambda a, x: a * 0.72e0 + x * 0.28e0) AS latency_ewma, CAST(list_reduce(list_prepend(0, list_transform(l, lambda x: CASE WHEN x.ok THEN -1 ELSE 1 END)), lambda a, x: CASE WHEN x < 0 THEN 0 ELSE a + 1 END) AS INT) AS consecutive_failures FROM l)"""


@query("q_ewma_latency", f"{OBSERVATIONS_SQL}, {_FOLDED} SELECT * REPLACE (round(latency_ewma, 6) AS latency_ewma), CASE WHEN consecutive_failures >= 3 THEN least(1800e0, 120e0 * pow(2e0, consecutive_failures - 3)) ELSE 0e0 END AS cooldown_seconds FROM f")
def ewma(spark: SparkSession, d: str) -> DataFrame:
    return rel.folded(observations(spark, d)).withColumn("latency_ewma", F.round("latency_ewma", 6))


@query("q_route", f"{_RATES}, {_FOLDED}, s AS (SELECT source_id, floor(reliability * (0.45e0 + yield * 0.55e0) * (1 / (1 + greatest(0e0, coalesce(latency_ewma, 1800e0)) / 1800)) * (0.35e0 + confidence * 0.65e0) * 1e6 + 0.5) / 1e6 AS routing_score FROM q JOIN f USING (source_id)) SELECT source_id, routing_score, row_number() OVER (ORDER BY routing_score DESC, source_id) AS place FROM s")
def route(spark: SparkSession, d: str) -> DataFrame:
    return rel.routing(observations(spark, d)).select("source_id", "routing_score", "place")


@query("q_failure_matrix", f"{OBSERVATIONS_SQL} SELECT source_id, kind, count(*) AS events FROM observations GROUP BY source_id, kind")
def failure_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rel.failure_matrix(observations(spark, d))


_ISLANDS = """ch AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR price IS DISTINCT FROM lag(price) OVER w THEN 1 ELSE 0 END AS ch FROM obs WINDOW w AS (PARTITION BY product_id ORDER BY observed_at, event_id)),
rn AS (SELECT *, sum(ch) OVER (PARTITION BY product_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM ch),
isl AS (SELECT product_id, island, any_value(price) AS price, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS observations FROM rn GROUP BY product_id, island)"""
_COARSE = f"{OBSERVATIONS_SQL}, obs AS (SELECT * REPLACE (floor(price / 20) * 20 AS price) FROM observations), {_ISLANDS}"


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).withColumn("price", F.floor(F.col("price") / 20) * F.lit(20.0))


@query("q_price_history", f"{_COARSE} SELECT product_id, CAST(island AS BIGINT) AS island, price::DOUBLE AS price, first_seen, last_seen, observations FROM isl")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return rel.price_islands(_coarse(spark, d), ["product_id"])


@query("q_price_stats", f"{_COARSE}, pv AS (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY island) AS previous FROM isl), g AS (SELECT product_id, min(price)::DOUBLE AS low, max(price)::DOUBLE AS high, arg_min(price, island)::DOUBLE AS first_price, arg_max(price, island)::DOUBLE AS latest, arg_max_null(previous, island)::DOUBLE AS previous, count(*) - 1 AS changes FROM pv GROUP BY product_id) SELECT *, latest - previous AS delta, CASE WHEN latest > previous THEN 'up' WHEN latest < previous THEN 'down' ELSE 'flat' END AS direction FROM g")
def price_stats(spark: SparkSession, d: str) -> DataFrame:
    return rel.price_stats(_coarse(spark, d), ["product_id"])


@query(
    "q_revision_outcomes",
    """WITH o AS (SELECT event_id, user_id AS product_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * (event_id % 5) AS observed_at, floor(value / 50) AS price FROM events),
    n AS (SELECT *, max(observed_at) OVER w AS newest, max(struct_pack(t := observed_at, n := -event_id, p := price)) OVER w AS held FROM o WINDOW w AS (PARTITION BY product_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, CASE WHEN newest IS NULL OR observed_at > newest THEN 'accepted' WHEN observed_at < newest THEN 'rejected_older' WHEN held.p IS NOT DISTINCT FROM price THEN 'duplicate' ELSE 'equal_time_conflict' END AS outcome FROM n)
    SELECT event_id, outcome, sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS revision FROM x""",
)
def revision_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").select("event_id", F.col("user_id").alias("product_id"), (F.date_trunc("hour", F.col("ts").cast("timestamp")) - F.make_interval(hours=(F.col("event_id") % 5).cast("int"))).alias("observed_at"), F.floor(F.col("value") / 50).alias("price"))
    return rel.revisions(o, "product_id").select("event_id", "outcome", "revision")


@query(
    "q_source_health",
    f"""{OBSERVATIONS_SQL}, h AS (SELECT source_id, max(struct_pack(t := observed_at, e := event_id)) FILTER (transport_ok) AS last_ok, avg(CASE WHEN transport_ok THEN 1e0 ELSE 0e0 END) AS success, avg(CASE WHEN price >= 10 THEN 1e0 ELSE 0e0 END) AS valid FROM observations GROUP BY source_id),
    r AS (SELECT o.source_id, count(*) AS failures FROM observations o JOIN h ON h.source_id = o.source_id WHERE NOT transport_ok AND (last_ok IS NULL OR struct_pack(t := observed_at, e := event_id) > last_ok) GROUP BY o.source_id),
    s AS (SELECT h.source_id, coalesce(failures, 0) AS consecutive_failures, success, valid, h.source_id = 'source_7' AS quarantined FROM h LEFT JOIN r ON r.source_id = h.source_id)
    SELECT source_id, CAST(consecutive_failures AS INT) AS consecutive_failures, CASE WHEN quarantined THEN 'QUARANTINED' WHEN consecutive_failures >= 3 OR success < 0.5e0 OR valid < 0.9e0 THEN 'CIRCUIT_OPEN' WHEN consecutive_failures > 0 OR success < 0.9e0 OR valid < 0.99e0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state,
      NOT quarantined AND NOT (consecutive_failures >= 3 OR success < 0.5e0 OR valid < 0.9e0) AS ingest FROM s""",
)
def source_health(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    calls = observations(spark, d)
    rates = calls.groupBy("source_id").agg(share(F.col("transport_ok")).alias("success_rate"), share(F.col("price") >= 10).alias("price_validity"))
    metrics = rates.join(rel.folded(calls).select("source_id", "consecutive_failures"), "source_id").withColumn("quarantined", F.col("source_id") == "source_7")
    return rel.health(metrics).select("source_id", "consecutive_failures", "state", "ingest")


@query("q_quantile", f"{OBSERVATIONS_SQL} SELECT kind, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM observations GROUP BY kind")
def quantile(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)")
    return observations(spark, d).groupBy("kind").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("q_first_milestones", f"{OBSERVATIONS_SQL} SELECT product_id, min(event_id) FILTER (transport_ok) AS first_valid, min(event_id) FILTER (kind = 'purchase') AS first_exact, count(*) FILTER (transport_ok) AS valid, count(*) FILTER (kind = 'purchase') AS exact FROM observations GROUP BY product_id")
def first_milestones(spark: SparkSession, d: str) -> DataFrame:
    exact = F.col("kind") == "purchase"
    return observations(spark, d).groupBy("product_id").agg(F.min(F.when(F.col("transport_ok"), F.col("event_id"))).alias("first_valid"), F.min(F.when(exact, F.col("event_id"))).alias("first_exact"), F.count_if("transport_ok").alias("valid"), F.count_if(exact).alias("exact"))


@query("q_failure_pivot", f"{OBSERVATIONS_SQL} SELECT source_id, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'view') AS views, count(DISTINCT CASE WHEN kind = 'error' THEN product_id END) AS failing_products FROM observations GROUP BY source_id")
def failure_pivot(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("source_id").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "view").alias("views"), F.countDistinct(F.when(F.col("kind") == "error", F.col("product_id"))).alias("failing_products"))


@query("q_ndcg", "WITH g AS (SELECT l_partkey AS q, (l_linenumber + l_suppkey) % 4 AS grade, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem), b AS (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) AS j FROM g), d AS (SELECT q, sum(CAST((pow(2, grade) - 1) / log2(i + 1) AS DECIMAL(18,9))) AS dcg FROM g WHERE i <= 10 GROUP BY q), n AS (SELECT q, sum(CAST((pow(2, grade) - 1) / log2(j + 1) AS DECIMAL(18,9))) AS best FROM b WHERE j <= 10 GROUP BY q) SELECT q AS product_id, CASE WHEN best > 0 THEN round(CAST(dcg AS DOUBLE) / CAST(best AS DOUBLE), 6) ELSE 0e0 END AS ndcg FROM d JOIN n USING (q)")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").selectExpr("l_partkey AS product_id", "(l_linenumber + l_suppkey) % 4 AS grade", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("product_id").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")))
    g = g.withColumn("j", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("grade"), "i")))
    gain = lambda at: F.sum(F.when(F.col(at) <= 10, ((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(at) + 1)).cast("decimal(18,9)")))
    both = g.groupBy("product_id").agg(gain("i").cast("double").alias("dcg"), gain("j").cast("double").alias("best"))
    return both.select("product_id", F.when(F.col("best") > 0, F.round(F.col("dcg") / F.col("best"), 6)).otherwise(0.0).alias("ndcg"))
