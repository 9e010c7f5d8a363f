"""Queries on stored state: the inverted index, groups, evidence in time, quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.catalogue import Catalogue
from quaylens.operators import audit as au
from quaylens.operators import coverage as cov
from quaylens.operators import evidence as ev
from quaylens.operators import extraction as ex
from quaylens.operators import groups
from quaylens.operators import quotes as qt
from quaylens.operators.inverted import OfferIndex
from quaylens.operators.selector import cascade
from quaylens.operators.sweeps import Cursor, advance, reconcile_page
from quaylens.plans.catalog_queries import _REV, _SOLD_SQL, CATEGORIES, COLORS, _revisions, _sold
from quaylens.plans.gate_queries import _BROAD
from quaylens.plans.registry import query
from quaylens.schema import OFFERS_NOW
from quaylens.sources import nested
from quaylens.sources.storage import work_folder, written
from quaylens.sources.views import OBSERVATIONS_SQL, OFFERS_SQL, observations, offers, table

INDEX_QUERY, INDEX_SECONDS, INDEX_LIMIT = "widget 128gb", 2000 * 86400.0, 40
_WORDS = [f"list_contains(w, '{t}')" for t in INDEX_QUERY.split()]
_POINTS = " + ".join(f"len(list_filter(w, lambda x: x = '{t}')) * (SELECT floor(1000 * ln(1 + count(*) / count_if(list_contains(w, '{t}')))) FROM w)" for t in INDEX_QUERY.split())
_INDEX_SQL = rf"""{OFFERS_SQL}, w AS (SELECT offer_id, title, observed_at, list_filter(string_split(trim(regexp_replace(lower(concat_ws(' ', title, brand)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM offers),
r AS (SELECT offer_id, title, observed_at, ({_POINTS}) / len(w) AS text_rank FROM w WHERE {' AND '.join(_WORDS)} AND observed_at BETWEEN TIMESTAMP '{OFFERS_NOW}' - INTERVAL 2000 DAY AND TIMESTAMP '{OFFERS_NOW}' + INTERVAL 60 SECOND)
SELECT (row_number() OVER (ORDER BY text_rank DESC, observed_at DESC, offer_id) - 1)::INT AS place, offer_id, title, text_rank FROM r ORDER BY place LIMIT {INDEX_LIMIT}"""


CHAIN_QUERY = "red widget"
_CHAIN_POINTS = " + ".join(f"len(list_filter(w, lambda x: x = '{t}')) * (SELECT floor(1000 * ln(1 + count(*) / count_if(list_contains(w, '{t}')))) FROM iw)" for t in CHAIN_QUERY.split())
_CHAIN_SQL = rf"""{OFFERS_SQL}, iw AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(concat_ws(' ', title, brand)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM offers WHERE product_price > 0 AND observed_at <= TIMESTAMP '{OFFERS_NOW}' + INTERVAL 60 SECOND),
hits AS (SELECT * EXCLUDE (w) FROM iw WHERE list_contains(w, 'red') AND list_contains(w, 'widget') AND observed_at >= TIMESTAMP '{OFFERS_NOW}' - INTERVAL 2000 DAY ORDER BY ({_CHAIN_POINTS}) / len(w) DESC, observed_at DESC, offer_id LIMIT 1000),
picked AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY product_id, merchant, condition ORDER BY observed_at DESC NULLS LAST, offer_id) = 1), {_BROAD.format('picked')}
SELECT offer_id, query_score, product_price FROM s ORDER BY query_score DESC, product_price ASC NULLS LAST, offer_id LIMIT 20"""


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", "title", "brand", "merchant", "product_price", "observed_at")


@query("q_index_recall", _INDEX_SQL)
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    index = OfferIndex(spark, work_folder(spark, "offer-index"), buckets=16)
    index.write(_catalogue(spark, d))
    return index.search(INDEX_QUERY, OFFERS_NOW, INDEX_SECONDS, INDEX_LIMIT).select("place", "offer_id", "title", "text_rank")


@query("q_index_incremental", _INDEX_SQL)
def index_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same catalogue after three writes: older offers and early versions of the others, newer ones, and ones that come too late."""
    index = OfferIndex(spark, work_folder(spark, "offer-index"), buckets=16)
    rows = _catalogue(spark, d)
    before = F.col("observed_at") < F.lit("1998-01-01").cast("timestamp")
    earlier = lambda days: F.col("observed_at") - F.expr(f"INTERVAL {days} DAYS")
    first = rows.where(~before).withColumns({"observed_at": earlier(300), "title": F.concat(F.lit("128gb widget widget "), "title")})
    index.write(rows.where(before).unionByName(first))
    index.write(rows.where(~before))
    index.write(rows.withColumns({"observed_at": earlier(10), "title": F.lit("widget 128gb")}))
    return index.search(INDEX_QUERY, OFFERS_NOW, INDEX_SECONDS, INDEX_LIMIT).select("place", "offer_id", "title", "text_rank")


@query("q_search_chain", _CHAIN_SQL)
def search_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ingest, recall, dedupe, score, admit, and the first page."""
    catalogue = Catalogue(spark, work_folder(spark, "catalogue"), CATEGORIES, COLORS, buckets=16)
    catalogue.ingest(offers(spark, d), OFFERS_NOW)
    return catalogue.search(CHAIN_QUERY, OFFERS_NOW, INDEX_SECONDS).page(0).select("offer_id", "query_score", "product_price")


# groups: no twin, since each step of the rule depends on those before; tests hold it against the rule over plain offers

@query("q_comparable_groups")
def comparable_groups(spark: SparkSession, d: str) -> DataFrame:
    stated = F.expr("map('Material', element_at(split(title, ' '), 3), 'Pack', case when delivery_days % 3 = 0 then 'pack of 2' end)")
    return groups.comparable(offers(spark, d).withColumn("extra_specs", stated))


# evidence in time: an event as an offer, and evidence shifted around its time, on and beyond both edges

_SHIFT = "case event_id % 6 when 0 then -300 when 1 then 60 when 2 then -301 when 3 then 61 when 4 then -10 else 0 end"
_FOUND = {
    "sku": "concat('S', user_id)",
    "model": "concat('m', (user_id + event_id % 11 % 2) % 3)",
    "price": "case when event_id % 13 = 0 then null when event_id % 5 = 0 then value * 3 else value end",
    "currency": "case when event_id % 7 = 0 then 'USD' else 'SAR' end",
    "evidence_id": "event_id",
}


@query(
    "q_enrich_in_time",
    f"""WITH o AS (SELECT event_id, concat('S', user_id) AS sku, concat('m', user_id % 3) AS model, value AS product_price, ts + INTERVAL 60 SECOND AS x FROM events WHERE event_type IN ('view', 'click')),
    e AS (SELECT {', '.join(f'{c} AS {n}' for n, c in _FOUND.items())}, ts + ({_SHIFT}) * INTERVAL 1 SECOND AS t FROM events),
    n AS (SELECT sku, t, arg_max(struct_pack(model := model, price := price, currency := currency, id := evidence_id), evidence_id) AS f FROM e GROUP BY sku, t),
    j AS (SELECT o.*, CASE WHEN n.t >= o.x - INTERVAL 360 SECOND THEN n.f END AS f FROM o ASOF LEFT JOIN n ON o.sku = n.sku AND o.x >= n.t),
    r AS (SELECT *, CASE WHEN f IS NULL THEN 'no_evidence' WHEN f.price IS NULL OR NOT f.price > 0 OR f.currency <> 'SAR' THEN 'price_invalid' WHEN f.model <> model THEN 'variant_conflict'
      WHEN NOT coalesce(product_price > 0, false) OR f.price < product_price * 0.5e0 OR f.price > product_price * 2 THEN 'price_review' ELSE 'admitted' END AS reason FROM j)
    SELECT event_id, f.id AS evidence_id, reason, CASE WHEN reason = 'admitted' THEN f.price ELSE product_price END AS final_price FROM r""",
)
def enrich_in_time(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    asked = events.where("event_type in ('view', 'click')").selectExpr("event_id", "concat('S', user_id) AS sku", "cast(null AS string) AS brand", "concat('m', user_id % 3) AS model", "value AS product_price", "ts")
    told = events.selectExpr(*[f"{c} AS {n}" for n, c in _FOUND.items()], "cast(null AS string) AS brand", f"ts + make_interval(0, 0, 0, 0, 0, 0, {_SHIFT}) AS found_at")
    told = told.withColumn("key", F.col("sku"))
    joined = ev.newest_in_time(asked.withColumn("key", F.col("sku")), told, "key", "ts")
    return ev.admit_evidence(joined, "key", "product_price").select("event_id", F.col("found.evidence_id").alias("evidence_id"), "reason", "final_price")


# quotes: events as commands, some of which come twice

_COMMANDS = {
    "quote_id": "concat('q', user_id)",
    "command_id": "concat('c', lpad(cast(event_id as varchar(20)), 12, '0'))",
    "at": "ts",
    "kind": "case event_type when 'signup' then 'request' when 'view' then 'quote' when 'error' then 'quote' else 'decide' end",
    "payload": "case when event_type = 'signup' then concat('p', event_id % 2) end",
    "price": "cast(floor(value * 100) as bigint)",
    "eta_days": "k",
    "valid_seconds": "k * 1000",
    "terms": "case when event_id % 23 = 0 then ' ' else 'net 30' end",
    "expected_revision": "case event_type when 'view' then null when 'error' then event_id % 5 when 'signup' then null else event_id % 4 end",
    "decision": "case event_type when 'purchase' then 'accepted' when 'click' then 'declined' end",
}
_SOUND = "price BETWEEN 1 AND 999999999 AND eta_days BETWEEN 0 AND 90 AND valid_seconds BETWEEN 60 AND 2592000 AND trim(terms) <> ''"
_QUOTES_SQL = f"""WITH RECURSIVE e AS (SELECT *, cast(json_extract(props, '$.k') as bigint) AS k FROM events), c AS (SELECT {', '.join(f'{c} AS "{n}"' for n, c in _COMMANDS.items())} FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY "at", command_id) AS i FROM c),
s AS (SELECT DISTINCT quote_id, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::VARCHAR AS held, 0::BIGINT AS revision, NULL::TIMESTAMP AS valid_until, NULL::VARCHAR AS command_id, NULL::VARCHAR AS outcome FROM n
  UNION ALL SELECT quote_id, i, CASE outcome WHEN 'requested' THEN 'requested' WHEN 'quoted' THEN 'quoted' WHEN 'accepted' THEN 'accepted' WHEN 'declined' THEN 'declined' ELSE status END, CASE WHEN outcome = 'requested' THEN payload ELSE held END,
    CASE WHEN outcome = 'quoted' THEN revision + 1 ELSE revision END, CASE WHEN outcome = 'quoted' THEN "at" + valid_seconds * INTERVAL 1 SECOND ELSE valid_until END, command_id, outcome
  FROM (SELECT n.quote_id, n.i, s.status, s.held, s.revision, s.valid_until, n.command_id, n.payload, n."at", n.valid_seconds, CASE
    WHEN kind = 'request' THEN CASE WHEN status IS NULL THEN 'requested' WHEN payload = held THEN 'replayed' ELSE 'payload_conflict' END
    WHEN kind = 'quote' THEN CASE WHEN NOT ({_SOUND}) THEN 'invalid_quote' WHEN coalesce(status, '') NOT IN ('requested', 'quoted') OR coalesce(expected_revision, revision) <> revision THEN 'not_mutable' ELSE 'quoted' END
    ELSE CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'quoted' OR expected_revision <> revision OR valid_until <= "at" THEN 'expired_or_changed' ELSE decision END END AS outcome
    FROM s JOIN n ON n.quote_id = s.quote_id AND n.i = s.i + 1))
SELECT quote_id, command_id, outcome, status, revision::INT AS revision FROM s WHERE i > 0 UNION ALL SELECT quote_id, command_id, 'repeated', status, revision::INT FROM s WHERE i > 0 AND cast(command_id[2:] AS BIGINT) % 7 = 0"""


def quote_commands(spark: SparkSession, d: str) -> DataFrame:
    """Every event a command; each seventh comes twice."""
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    commands = rows.selectExpr(*[f"{c} AS {n}" for n, c in _COMMANDS.items()], "explode(case when event_id % 7 = 0 then array(1, 2) else array(1) end) AS time")
    return commands.drop("time").withColumn("at", F.col("at").cast("timestamp"))


@query("q_quote_fold", _QUOTES_SQL)
def quote_fold(spark: SparkSession, d: str) -> DataFrame:
    return qt.outcomes(quote_commands(spark, d)).select("quote_id", "command_id", "outcome", "status", "revision")


# payloads whose cards lie at any depth

@query("q_source_nested_cards", f"{_SOLD_SQL}, x AS (SELECT *, unnest(CASE WHEN p_partkey % 4 = 0 THEN [1, 2] ELSE [1] END) AS o FROM v) SELECT s_name AS source_id, concat_ws('|', p_partkey, o, s_name, concat(CAST(price AS BIGINT), '.00')) AS listing_id, p_name AS title, price, CASE WHEN p_partkey % 3 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM x")
def source_nested_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards in the payload's list, in a slot of a widget, and in rows of a grid; some twice, some with the price in a part, some without a product."""
    own = "'productId', cast(p_partkey as string), 'offerId', '1', 'shopName', s_name, 'productName', p_name, 'sellingPrice', case when p_partkey % 2 = 0 then floor(p_retailprice) end, 'stock', named_struct('stockLevelStatus', case when p_partkey % 3 = 0 then 'outOfStock' else 'lowStock' end)"
    parts = "array(named_struct('componentDTO', named_struct('priceDTO', named_struct('finalPrice', floor(p_retailprice)))))"
    card = f"to_json(named_struct('uid', 'master-product-card', 'componentDTO', named_struct('additionalAttributes', named_struct({own}), 'productCardComponents', {parts})))"
    banner = """'{"uid":"banner","componentDTO":{"additionalAttributes":{"productName":"x"}}}'"""
    # a card is made once; quotes within its texts are escaped, so the other offer differs there only
    cards = f"""concat_ws(',', card, {banner}, case when p_partkey % 4 = 0 then replace(card, '"offerId":"1"', '"offerId":"2"') else card end)"""
    item = """case p_partkey % 3 when 0 then cards when 1 then concat('{"widget":{"slot":[', cards, ']}}') else concat('{"grid":[{"row":[[', cards, ']]}]}') end"""
    sold = _sold(spark, d, item, "concat('{\"rows\":[', array_join(l, ','), ']}')", card=card, cards=cards)
    return nested.product_cards(sold).select("source_id", "listing_id", "title", "price", "availability")


# audits by round, source and kind

_CELLS = "count(*) AS calls, count(*) FILTER (transport_ok) AS passed, sum(cast(floor(latency_ms) as bigint))::BIGINT AS total_ms, max(cast(floor(latency_ms) as bigint)) AS slowest_ms"


@query("q_audit_rollup", f"{OBSERVATIONS_SQL}, r AS (SELECT *, date_diff('day', DATE '2024-01-01', cast(observed_at as date)) // 10 AS round FROM observations) SELECT round, source_id, kind, {_CELLS} FROM r GROUP BY GROUPING SETS ((round, source_id, kind), (round, source_id), (round, kind), (source_id), (round), ())")
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).withColumn("round", F.floor(F.datediff("observed_at", F.lit("2024-01-01")) / 10))
    return au.matrix(o, [["round", "source_id", "kind"], ["round", "source_id"], ["round", "kind"], ["source_id"], ["round"], []])


@query("q_slowest_calls", f"{OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY latency_ms DESC NULLS LAST, event_id) AS place FROM observations) SELECT kind, place::INT AS place, source_id, event_id, latency_ms FROM r WHERE place <= 10")
def slowest_calls(spark: SparkSession, d: str) -> DataFrame:
    return au.slowest(observations(spark, d), ["kind"]).select("kind", "place", "source_id", "event_id", "latency_ms")


# pages of parts, each of which one or two ways of extraction can read

_PRODUCT = "named_struct('@type', 'Product', 'name', p_name, 'sku', {sku}, 'brand', named_struct('name', p_brand), 'offers', named_struct('@type', 'Offer', 'price', price, 'priceCurrency', 'SAR'))"
_OWN = _PRODUCT.format(sku="concat('SKU', p_partkey)")
_LD = """concat('<script type="application/ld+json">', to_json({}), '</script>')"""
_META = """concat('<meta property="og:title" content="', p_name, '"><meta property="product:price:amount" content="', price, '">')"""
_KINDS = [
    _LD.format(_OWN),
    """concat('<script type="application/json">', to_json(named_struct('list', array(named_struct('title', p_name, 'price', price, 'currency', 'SAR')))), '</script>')""",
    """concat('<script id="__NEXT_DATA__">', to_json(named_struct('props', named_struct('item', named_struct('name', p_name, 'sellingPrice', price)))), '</script>')""",
    """concat('<script id="ProductJson-x" type="application/json">', to_json(named_struct('title', p_name, 'variants', array(named_struct('sku', 'other', 'price', 1), named_struct('sku', concat('SKU', p_partkey), 'price', cast(price as int) * 100)))), '</script>')""",
    _META,
    """concat('<h1>', p_name, '</h1><p><b class="price">', price, '</b> SAR</p>')""",
    _LD.format(f"array({_OWN}, {_PRODUCT.format(sku=repr('other'))})"),
    f"concat({_LD.format(_OWN)}, {_META})",
]
_WAYS = ["jsonld", "embedded_json", "hydrated_state", "storefront_data", "meta", "visible_dom", "jsonld", "jsonld"]


@query(
    "q_page_candidates",
    f"""WITH p AS (SELECT p_partkey AS page_id, p_partkey % 8 AS k, cast(cast(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price FROM part),
    w AS (SELECT *, unnest(CASE WHEN k = 7 THEN ['jsonld', 'meta'] ELSE [({_WAYS!r})[k + 1]] END) AS strategy FROM p)
    SELECT page_id, strategy, CASE WHEN k <> 6 THEN CASE WHEN k = 3 THEN price || '.00' ELSE price END END AS price, CASE WHEN k = 6 THEN 'several products' END AS refused,
      CASE WHEN k <> 6 THEN CASE strategy WHEN 'jsonld' THEN 0.99e0 WHEN 'embedded_json' THEN 0.94e0 WHEN 'hydrated_state' THEN 0.9e0 WHEN 'storefront_data' THEN 0.92e0 WHEN 'meta' THEN 0.72e0 ELSE 0.6e0 END END AS confidence,
      k <> 6 AND NOT (k = 7 AND strategy = 'meta') AS owns FROM w""",
)
def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    html = "case p_partkey % 8 " + " ".join(f"when {i} then {k}" for i, k in enumerate(_KINDS)) + " end"
    # a file of parts is small, and its pages aren't: parts are dealt out before pages are made of them
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.floor("p_retailprice").cast("string").alias("price"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    pages = parts.selectExpr("p_partkey AS page_id", f"{html} AS html", "case when p_partkey % 8 = 3 then concat('SKU', p_partkey) end AS expected_sku")
    return ex.owned(ex.page_candidates(pages)).select("page_id", "strategy", "price", "refused", "confidence", "owns")


# passes in pages

_PAGES = 4


@query("q_reconcile_pages", f"{_REV} SELECT c.key AS key, CASE WHEN i.key IS NULL OR i.revision <> c.revision THEN 'repair' ELSE 'keep' END AS action FROM c LEFT JOIN i ON c.key = i.key")
def reconcile_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages of a pass over the canonical table, each a quarter of it; each page is written, then the cursor."""
    canonical, index = _revisions(spark, d)
    folder = work_folder(spark, "reconcile")
    cursor, size, pages = Cursor(spark, f"{folder}/cursor"), -(-canonical.count() // _PAGES) or 1, []
    kind = canonical.schema["key"].dataType.simpleString()
    ended = False
    while not ended:
        actions, last, upper = reconcile_page(canonical, index, "key", cursor, size)
        pages.append(written(actions, f"{folder}/page-{len(pages)}"))
        ended = advance(cursor, last, upper, kind)
    return reduce(DataFrame.unionByName, pages)


# the variant selector: a product is a category and brand, its groups are what is sold under one set of variants

_DIMS = ("model", "storage", "condition", "color")
_ENTRIES = "SELECT category, brand, coalesce(model_number, '') AS model, coalesce(storage, '') AS storage, condition, color, min(product_price) AS value, bool_or(exact_match) AS exact FROM offers WHERE currency = 'SAR' GROUP BY ALL"


def _pick_sql() -> str:
    steps, before = [], "placed"
    for n, dim in enumerate(_DIMS):
        asked = {"storage": "'128 GB'", "color": "'red'"}.get(dim, "NULL")
        steps.append(f"""p{n} AS (SELECT *, CASE WHEN bool_or({dim} = {asked}) OVER w THEN {asked} WHEN bool_or({dim} = fall.{dim} AND {dim} <> '') OVER w THEN fall.{dim} ELSE (min(CASE WHEN {dim} <> '' THEN struct_pack(p := coalesce(value, 'infinity'::DOUBLE), k := {dim}) END) OVER w).k END AS picked_{dim} FROM {before} WINDOW w AS (PARTITION BY category, brand)),
        f{n} AS (SELECT * FROM p{n} WHERE nullif({dim}, '') IS NOT DISTINCT FROM picked_{dim})""")
        before = f"f{n}"
    picked = ", ".join(f"picked_{dim}" for dim in _DIMS)
    return f"""{OFFERS_SQL}, e AS ({_ENTRIES}), n AS (SELECT *, row_number() OVER (PARTITION BY category, brand ORDER BY value NULLS LAST, model, storage, condition, color) AS place FROM e),
    placed AS (SELECT *, first_value(struct_pack(model := model, storage := storage, condition := condition, color := color)) OVER (PARTITION BY category, brand ORDER BY NOT (exact AND condition = 'new'), place) AS fall FROM n), {', '.join(steps)}
    SELECT category, brand, {picked}, value FROM {before} QUALIFY row_number() OVER (PARTITION BY category, brand ORDER BY place) = 1"""


@query("q_variant_cascade", _pick_sql())
def variant_cascade(spark: SparkSession, d: str) -> DataFrame:
    sold = offers(spark, d).where("currency = 'SAR'").withColumns({"model": F.coalesce("model_number", F.lit("")), "storage": F.coalesce("storage", F.lit(""))})
    entries = sold.groupBy("category", "brand", *_DIMS).agg(F.min("product_price").alias("value"), F.bool_or("exact_match").alias("exact"))
    order = Window.partitionBy("category", "brand").orderBy(F.col("value").asc_nulls_last(), *_DIMS)
    asked = {"requested_storage": F.lit("128 GB"), "requested_color": F.lit("red")}
    chosen, _ = cascade(entries.withColumn("place", F.row_number().over(order)).withColumns(asked), ["category", "brand"], _DIMS)
    return chosen.select("category", "brand", *[f"picked_{c}" for c in _DIMS], "value")


# sources: what their markets and sitemaps say

_MARKET = "case l_suppkey % 5 when 0 then 'KSA' when 1 then 'ae' when 2 then 'UAE' when 3 then '' end"
_CURRENCY = "case l_partkey % 4 when 0 then 'SAR' when 1 then 'aed' when 2 then 'USD' end"
_HOST = "case l_linenumber % 3 when 0 then 'shop.example.sa' when 1 then 'shop.example.AE' else 'example.com' end"


@query(
    "q_market_issues",
    f"""WITH s AS (SELECT upper(coalesce({_MARKET}, '')) AS m, upper(coalesce({_CURRENCY}, '')) AS c, {_HOST} AS h FROM lineitem),
    x AS (SELECT *, CASE m WHEN 'KSA' THEN 'SAR' WHEN 'AE' THEN 'AED' WHEN 'UAE' THEN 'AED' END AS e, CASE WHEN h LIKE '%.sa' THEN 'KSA' WHEN h LIKE '%.AE' THEN 'UAE' END AS hint FROM s)
    SELECT concat_ws(',', CASE WHEN m = '' THEN 'market-missing' END, CASE WHEN c = '' THEN 'currency-missing' END, CASE WHEN c <> '' AND e <> c THEN 'currency-market-mismatch' END, CASE WHEN m <> '' AND hint <> m THEN 'host-market-mismatch' END) AS issues, count(*) AS n FROM x GROUP BY issues""",
)
def market_issues(spark: SparkSession, d: str) -> DataFrame:
    issues = cov.market_issues(F.expr(_MARKET), F.expr(_CURRENCY), F.expr(_HOST))
    return table(spark, d, "lineitem").groupBy(F.array_join(issues, ",").alias("issues")).agg(F.count("*").alias("n"))


@query("q_sitemap_absent", "WITH i AS (SELECT DISTINCT l_suppkey AS source_id, concat('/p/', l_partkey) AS url FROM lineitem), o AS (SELECT DISTINCT l_suppkey AS source_id, concat('/p/', l_partkey) AS url FROM lineitem WHERE l_quantity > 10), n AS (SELECT source_id FROM i GROUP BY source_id HAVING count(*) <= 10000 INTERSECT SELECT source_id FROM o GROUP BY source_id HAVING count(*) <= 10000) SELECT source_id, url, 'reverify' AS status FROM (SELECT * FROM i EXCEPT SELECT * FROM o) JOIN n USING (source_id)")
def sitemap_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.concat(F.lit("/p/"), "l_partkey").alias("url"), "l_quantity")
    return cov.absent_from_sitemap(rows.select("source_id", "url").distinct(), rows.where("l_quantity > 10").select("source_id", "url").distinct(), "url", complete=True)
