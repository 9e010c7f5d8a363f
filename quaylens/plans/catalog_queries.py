"""Queries about matching, pages, payloads, audits, the catalogue and streams, most with twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.functions import text as tx
from quaylens.functions import urls
from quaylens.functions.money import to_riyal
from quaylens.operators import audit as au
from quaylens.operators import catalog as cat
from quaylens.operators import matching as mt
from quaylens.operators import pages as pg
from quaylens.plans.registry import query
from quaylens.schema import OFFERS_NOW
from quaylens.sources import payloads as pl
from quaylens.sources.views import OBSERVATIONS_SQL, OFFERS_SQL, observations, offers, table
from quaylens.streaming import observations as st

CATEGORIES, COLORS = ("ring", "widget", "bolt", "gear", "gizmo"), ("red", "blue", "small", "hot", "old")
QUERY = mt.parse_intent("new red widget 128 GB", CATEGORIES, COLORS)
_HITS = "((list_contains(w, 'red'))::INT + (list_contains(w, '128gb'))::INT)"
_SCORED = f"""{OFFERS_SQL}, w AS (SELECT *, string_split(trim(regexp_replace(lower(concat(title, ' ', brand)), '[^a-z0-9]+', ' ', 'g')), ' ') AS w, regexp_extract_all(title, '[0-9]+(?:gb|tb)') AS named FROM offers),
h AS (SELECT *, {_HITS} AS hits, condition NOT IN ('new', 'unknown') AS worn, list_has_any(w, ['case','cover','charger','protector','strap','bolt','gear']) AS acc FROM w),
s AS (SELECT *, floor(greatest(0e0, least(1e0, (CASE WHEN category = 'widget' THEN least(1e0, (hits + 1) / 3e0) ELSE hits / 2e0 * 0.2e0 END) * (CASE WHEN acc THEN 0.12e0 ELSE 1e0 END) * (CASE WHEN len(named) > 0 AND NOT list_contains(named, '128gb') THEN 0.82e0 ELSE 1e0 END) - CASE WHEN condition NOT IN ('new', 'unknown') THEN 0.15e0 ELSE 0e0 END)) * 100 + 0.5) / 100 AS query_score FROM h)"""


@query("q_match_score", f"{_SCORED} SELECT offer_id, query_score, query_score >= 0.92e0 AND hits = 2 AND category = 'widget' AND NOT acc AND NOT worn AND NOT (len(named) > 0 AND NOT list_contains(named, '128gb')) AS exact FROM s")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    return mt.assess(offers(spark, d), QUERY).select("offer_id", "query_score", "exact")


@query("q_filter_query", f"{_SCORED} SELECT concat_ws(',', CASE WHEN len(named) > 0 AND NOT list_contains(named, '128gb') THEN 'capacity_conflict' END, CASE WHEN NOT (query_score >= 0.92e0 AND hits = 2 AND category = 'widget' AND NOT acc AND NOT worn) THEN 'query_mismatch' END) AS reasons, count(*) AS offers FROM s GROUP BY reasons")
def filter_query(spark: SparkSession, d: str) -> DataFrame:
    return mt.reasons(offers(spark, d), QUERY).groupBy("reasons").agg(F.count("*").alias("offers"))


@query("q_admission", f"{_SCORED}, t AS (SELECT *, string_split(title, ' ') AS tw FROM s) SELECT offer_id FROM t WHERE query_score >= 0.35e0 OR (list_contains(tw, 'red'))::INT + (list_contains(tw, 'widget'))::INT + (list_contains(tw, '128gb'))::INT >= 2")
def admission(spark: SparkSession, d: str) -> DataFrame:
    return mt.admit(offers(spark, d), QUERY).select("offer_id")


@query("q_simple_score", "SELECT p_partkey, ((contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'ring'))::INT) / 2e0 AS score FROM part")
def simple_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", mt.simple_score("red ring", F.col("p_name")).alias("score"))


@query("q_find_best", "WITH s AS (SELECT p_partkey, ((contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'ring'))::INT) / 2e0 AS score FROM part) SELECT p_partkey, score FROM s WHERE score >= 0.5e0 ORDER BY score DESC, p_partkey LIMIT 1")
def find_best(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", mt.simple_score("red ring", F.col("p_name")).alias("score"))
    return rows.where("score >= 0.5").orderBy(F.desc("score"), "p_partkey").limit(1)


@query("q_relaxed_queries", """WITH o AS (SELECT * FROM (VALUES (0, 'red widget'), (1, 'widget')) AS t(step, q)) SELECT step, q, count(*) AS hits FROM o JOIN part ON len(list_filter(string_split(q, ' '), lambda x: NOT list_contains(string_split(p_name, ' '), x))) = 0 GROUP BY step, q""")
def relaxed_queries(spark: SparkSession, d: str) -> DataFrame:
    steps = mt.relaxed(QUERY)
    names = F.split("p_name", " ")
    out = [table(spark, d, "part").where(F.size(F.array_except(F.array(*[F.lit(w) for w in q.split()]), names)) == 0).agg(F.count("*").alias("hits")).select(F.lit(i).alias("step"), F.lit(q).alias("q"), "hits") for i, q in enumerate(steps)]
    return reduce(DataFrame.unionByName, out)


@query("q_comparison_query", f"{OFFERS_SQL} SELECT concat_ws(' ', brand, title, storage, color, condition) AS comparison_query, count(*) AS n FROM offers GROUP BY comparison_query")
def comparison_query(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy(F.concat_ws(" ", "brand", "title", "storage", "color", "condition").alias("comparison_query")).agg(F.count("*").alias("n"))


# pages

_STRIP = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\?.*$', '')"
_PARAMS = r"string_split(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '\?(.*)$', 1), '&')"


@query(
    "q_canonical_url",
    rf"""WITH u AS (SELECT page_id, {_STRIP} AS head, array_to_string(list_filter({_PARAMS}, lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '(?i)^(utm_.*|gclid|fbclid|ref|aff|affiliate)$')), '&') AS q FROM pages),
    h AS (SELECT page_id, regexp_replace(lower(regexp_extract(head, '^https://([^/@]+)(/.*)?$', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(head, '^https://[^/@]+(/.*)?$', 1), '/+$', '') AS path, q FROM u)
    SELECT page_id, CASE WHEN host <> '' THEN concat('https://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) END AS canonical FROM h""",
)
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("q_comparison_url", rf"""SELECT page_id, concat({_STRIP}, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS comparison, regexp_matches(url, '(?i)^https?://[^\s/]+') AS is_url FROM (SELECT *, array_to_string(list_filter({_PARAMS}, lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '(?i)^(utm_|campaign|gclid|fbclid|gad_|gbraid|wbraid)')), '&') AS q FROM pages)""")
def comparison_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.comparison_url(F.col("url")).alias("comparison"), urls.is_url(F.col("url")).alias("is_url"))


@query("q_page_probe", "SELECT " + ", ".join(f"regexp_matches(html, '{p}') AS {n}" for n, p in pg.PROBES.items()) + ", page_id FROM pages")
def page_probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in pg.probes(F.col("html")).items()])


@query("q_page_diagnostics", r"""WITH c AS (SELECT page_id, length(html) AS chars, len(regexp_extract_all(html, '(?i)<a ')) AS links, len(regexp_extract_all(html, '(?i)<p>')) AS paragraphs, len(regexp_extract_all(html, '(?i)<script')) AS scripts, html FROM pages)
SELECT page_id, chars, links, paragraphs, scripts, CASE WHEN regexp_matches(html, '(?i)cdn\.shopify|myshopify') THEN 'shopify' WHEN regexp_matches(html, '(?i)mage/|magento') THEN 'magento' WHEN regexp_matches(html, '(?i)woocommerce|wp-content') THEN 'woocommerce' WHEN regexp_matches(html, '(?i)demandware|dw/shop') THEN 'salesforce' ELSE 'unknown' END AS platform,
CASE WHEN regexp_matches(html, '(?i)captcha|access denied|unusual traffic|are you a robot') THEN 'blocked' WHEN regexp_matches(html, '(?i)<article\b') THEN 'article' WHEN len(regexp_extract_all(html, '(?i)<a\s')) > 50 THEN 'listing' ELSE 'unknown' END AS model FROM c""")
def page_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return pg.diagnostics(table(spark, d, "pages"))


@query("q_links", r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"#]+)"', 1))) AS href FROM pages), f AS (SELECT page_id, root, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN concat(root, href) ELSE concat(root, '/', href) END AS link FROM l)
SELECT page_id, link, regexp_replace(lower(regexp_extract(link, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(root, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS same_host FROM f""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pg.links(table(spark, d, "pages"))


@query("q_anti_sitemap", r"""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="(/[^"#]+)"', 1)) AS path FROM pages), k AS (SELECT DISTINCT concat('/', split_part(lower(p_name), ' ', 1)) AS path FROM part) SELECT path FROM l ANTI JOIN k USING (path)""")
def anti_sitemap(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="(/[^"#]+)"'), F.lit(1))).alias("path")).distinct()
    known = table(spark, d, "part").select(F.concat(F.lit("/"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))).alias("path")).distinct()
    return found.join(known, "path", "left_anti")


@query("q_extract_products")
def extract_products(spark: SparkSession, d: str) -> DataFrame:
    """Pages as found, and each with a JSON-LD product made from an offer of the same number."""
    pages = table(spark, d, "pages").select("page_id", "html")
    goods = table(spark, d, "part").selectExpr("p_partkey AS page_id", "to_json(named_struct('@type', 'Product', 'name', p_name, 'sku', concat('SKU', p_partkey), 'brand', named_struct('name', p_brand), 'offers', named_struct('price', cast(p_retailprice as string), 'priceCurrency', 'SAR', 'availability', 'https://schema.org/InStock'))) AS ld")
    marked = pages.join(goods, "page_id").select("page_id", F.concat(F.lit('<script type="application/ld+json">'), "ld", F.lit("</script>"), "html").alias("html"))
    return pg.extract_products(pages.unionByName(marked))


# payloads: what merchants' answers would look like for these offers

def _answers(spark: SparkSession, d: str, item: str, wrap: str) -> DataFrame:
    rows = offers(spark, d).select("merchant", "offer_id", F.expr(item).alias("i"))
    return rows.groupBy(F.col("merchant").alias("source_id"), (F.pmod(F.xxhash64("offer_id"), F.lit(16))).alias("page")).agg(F.array_sort(F.collect_list("i")).alias("l")).select("source_id", F.expr(wrap).alias("payload"))


_SOURCE_SQL = f"{OFFERS_SQL}, u AS (SELECT merchant, offer_id, any_value(title) AS title, any_value(brand) AS brand, min(floor(product_price * 100)) AS cents, any_value(availability) AS availability FROM offers GROUP BY merchant, offer_id)"


@query("q_source_search_api", f"{_SOURCE_SQL} SELECT merchant AS source_id, offer_id AS listing_id, title, brand, cents / 100 AS price FROM u")
def source_search_api(spark: SparkSession, d: str) -> DataFrame:
    item = "to_json(named_struct('uniqueId', offer_id, 'title', title, 'brand', brand, 'price', cast(floor(product_price * 100) / 100 as decimal(18,2))))"
    answers = _answers(spark, d, item, "concat('{\"response\":{\"products\":[', array_join(l, ','), ']}}')")
    return pl.parse(answers, pl.FORMATS["search_api"]).select("source_id", "listing_id", "title", "brand", "price")


@query("q_source_hits", f"{_SOURCE_SQL} SELECT merchant AS source_id, offer_id AS listing_id, cents / 100 AS price, CASE availability WHEN 'in_stock' THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM u")
def source_hits(spark: SparkSession, d: str) -> DataFrame:
    item = "to_json(named_struct('objectID', offer_id, 'name', title, 'prices', named_struct('list', cast(floor(product_price * 100) / 100 as decimal(18,2))), 'in_stock', availability = 'in_stock'))"
    return pl.parse(_answers(spark, d, item, "concat('{\"hits\":[', array_join(l, ','), ']}')"), pl.FORMATS["hits"]).select("source_id", "listing_id", "price", "availability")


@query("q_source_constructor", f"{OFFERS_SQL}, u AS (SELECT merchant, offer_id, any_value(title) AS title, any_value(brand) AS brand, min(floor(product_price * 100)) AS cents FROM offers GROUP BY merchant, offer_id) SELECT merchant AS source_id, offer_id AS listing_id, title, brand, cents / 100 AS price FROM u")
def source_constructor(spark: SparkSession, d: str) -> DataFrame:
    item = "to_json(named_struct('value', title, 'data', named_struct('id', offer_id, 'brand', brand, 'final_price', cast(floor(product_price * 100) / 100 as decimal(18,2)))))"
    answers = _answers(spark, d, item, "concat('{\"results\":[', array_join(l, ','), ']}')")
    return pl.parse(answers, pl.FORMATS["constructor"]).select("source_id", "listing_id", "title", "brand", "price")


_SOLD_SQL = "WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), v AS (SELECT p_partkey, p_name, p_brand, floor(p_retailprice) AS price, s_name, s_suppkey FROM k JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"


def _sold(spark: SparkSession, d: str, item: str, wrap: str, **made_first: str) -> DataFrame:
    """Payloads in which each supplier offers the parts of its line items, in pages; made_first: columns that an item or a later one uses more than once."""
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    made = sold.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    for name, e in {**made_first, "page": "pmod(xxhash64(p_partkey), 64L)"}.items():
        made = made.withColumn(name, F.expr(e))
    # many groups are gathered by sorting: a hash in front, and their names are hardly compared
    pages = made.groupBy(F.xxhash64("s_name", "page").alias("_hash"), F.col("s_name").alias("source_id"), "page").agg(F.array_sort(F.collect_list(F.expr(item))).alias("l"))
    return pages.select("source_id", F.expr(wrap).alias("payload"))


@query("q_source_items", f"{_SOLD_SQL} SELECT s_name AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, price, CASE WHEN s_suppkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE p_partkey % 3 WHEN 0 THEN 'used' WHEN 1 THEN 'new' ELSE 'unknown' END AS condition, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 4) - 0.5e0 END AS shipping, CASE WHEN s_suppkey % 3 <> 0 THEN floor(price * 3.75e0 * 100 + 0.5) / 100 END AS price_sar FROM v")
def source_items(spark: SparkSession, d: str) -> DataFrame:
    item = "to_json(named_struct('itemId', cast(p_partkey as string), 'title', p_name, 'brand', p_brand, 'price', named_struct('value', cast(cast(floor(p_retailprice) as int) as string), 'currency', case when s_suppkey % 3 = 0 then 'EUR' else 'USD' end), 'condition', case p_partkey % 3 when 0 then 'Pre-owned' when 1 then 'Brand New' else 'mint' end, 'shippingOptions', case when p_partkey % 4 > 0 then array(named_struct('cost', '9'), named_struct('cost', cast(p_partkey % 4 - 0.5 as string))) end))"
    rows = pl.parse(_sold(spark, d, item, "concat('{\"itemSummaries\":[', array_join(l, ','), ']}')"), pl.FORMATS["item_summaries"])
    rates = spark.createDataFrame([("USD", 3.75)], "currency string, rate double")
    return to_riyal(rows, rates, "price").select("source_id", "listing_id", "price", "currency", "condition", "shipping", "price_sar")


@query("q_source_marketplace", f"{_SOLD_SQL} SELECT s_name AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, p_brand AS brand, CASE p_partkey % 3 WHEN 0 THEN price - 1 ELSE price END AS price, CASE WHEN p_partkey % 5 = 0 THEN 'out_of_stock' WHEN p_partkey % 5 = 1 THEN 'unknown' ELSE 'in_stock' END AS availability, CASE WHEN s_suppkey % 2 = 0 THEN 0e0 END AS shipping FROM v")
def source_marketplace(spark: SparkSession, d: str) -> DataFrame:
    item = "to_json(named_struct(case when p_partkey % 2 = 0 then 'sku' else 'sku_config' end, cast(p_partkey as string), 'name', p_name, 'brand', p_brand, 'price', floor(p_retailprice), 'sale_price', case p_partkey % 3 when 0 then floor(p_retailprice) - 1 when 1 then floor(p_retailprice) + 5 end, 'is_buyable', case when p_partkey % 5 <> 1 then p_partkey % 5 <> 0 end, 'flags', case when s_suppkey % 2 = 0 then array('new', 'free_delivery_eligible') end))"
    item = item.replace("named_struct(case when p_partkey % 2 = 0 then 'sku' else 'sku_config' end, cast(p_partkey as string)", "named_struct('sku', case when p_partkey % 2 = 0 then cast(p_partkey as string) end, 'sku_config', case when p_partkey % 2 = 1 then cast(p_partkey as string) end")
    rows = pl.parse(_sold(spark, d, item, "concat('{\"hits\":[', array_join(l, ','), ']}')"), pl.FORMATS["marketplace_hits"])
    return rows.select("source_id", "listing_id", "brand", "price", "availability", "shipping")


@query("q_source_cards", f"{_SOLD_SQL}, x AS (SELECT *, unnest(CASE WHEN p_partkey % 4 = 0 THEN [1, 2] ELSE [1] END) AS o FROM v) SELECT s_name AS source_id, concat_ws('|', p_partkey, o, s_name, CAST(price AS BIGINT)) AS listing_id, price, CASE WHEN p_partkey % 3 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM x")
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards in rows: some twice (one offer), some with two offers of one product, some without a product."""
    card = "named_struct('type', 'product', 'additionalAttributes', named_struct('productId', cast(p_partkey as string), 'offerId', '{0}', 'shopName', s_name, 'productName', p_name, 'stock', case when p_partkey % 3 = 0 then 'Out of Stock' else 'In stock' end, 'price', cast(cast(floor(p_retailprice) as int) as string)))"
    none = "named_struct('type', 'banner', 'additionalAttributes', named_struct('productId', cast(null as string), 'offerId', '', 'shopName', s_name, 'productName', p_name, 'stock', '', 'price', ''))"
    item = f"to_json(named_struct('cards', case when p_partkey % 4 = 0 then array({card.format(1)}, {none}, {card.format(2)}) else array({card.format(1)}, {card.format(1)}, {none}) end))"
    rows = pl.parse(_sold(spark, d, item, "concat('{\"rows\":[', array_join(l, ','), ']}')"), pl.FORMATS["cards"])
    return rows.select("source_id", "listing_id", "price", "availability")


@query("q_source_catalog_items", f"{_SOLD_SQL} SELECT s_name AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, CASE WHEN p_partkey % 5 = 0 THEN concat('Item ', p_partkey) ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'SAR' END AS currency, CASE WHEN p_partkey % 2 = 0 THEN 'refurbished' ELSE 'new' END AS condition, CASE WHEN p_partkey % 2 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM v WHERE p_partkey % 7 <> 0")
def source_catalog_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with several listings, of which the one in the buy box counts, else the first; items without a listing are no offers."""
    first = "named_struct('isBuyBoxWinner', false, 'amount', floor(p_retailprice), 'currency', 'sar', 'condition', cast(null as string), 'availability', 'NOW_IN_STOCK')"
    won = "named_struct('isBuyBoxWinner', true, 'amount', floor(p_retailprice) + 1, 'currency', 'eur', 'condition', 'Renewed', 'availability', 'OUT_OF_STOCK')"
    item = f"to_json(named_struct('asin', cast(p_partkey as string), 'detailPageURL', concat('https://x/', p_partkey), 'title', case when p_partkey % 5 <> 0 then p_name end, 'brand', p_brand, 'listings', case when p_partkey % 7 = 0 then array() when p_partkey % 2 = 0 then array({first}, {won}) else array({first}) end))"
    rows = pl.parse(_sold(spark, d, item, "concat('{\"searchResult\":{\"items\":[', array_join(l, ','), ']}}')"), pl.FORMATS["catalog_items"])
    return rows.select("source_id", "listing_id", "title", "price", "currency", "condition", "availability")


@query("q_source_storefront", "WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), v AS (SELECT s_name, p_partkey, p_retailprice, (p_partkey + s_suppkey) % 5 + 1 AS n FROM k JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT s_name AS source_id, concat(p_partkey, '-', i) AS listing_id, floor(p_retailprice) + i AS price FROM v, range(0, 3) r(i) WHERE i < n")
def source_storefront(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier is a storefront that offers the parts of its line items, in one to five variants, of which a search shows three."""
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    made = sold.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    variants = "transform(sequence(0, cast((p_partkey + s_suppkey) % 5 as int)), i -> named_struct('id', concat(p_partkey, '-', i), 'price', cast(cast(floor(p_retailprice) + i as int) as string), 'available', true))"
    products = made.select(F.col("s_name").alias("source_id"), F.expr(f"to_json(named_struct('products', array(named_struct('id', cast(p_partkey as string), 'title', p_name, 'variants', {variants}))))").alias("payload"))
    return pl.parse(products, pl.FORMATS["storefront"]).select("source_id", "listing_id", "price")


@query("q_search_store_tiers", f"{OFFERS_SQL}, t AS (SELECT offer_id, merchant, CASE WHEN price_confidence = 'observed' AND match_confidence > 0.99e0 THEN 0 WHEN data_kind = 'live' THEN 1 ELSE 2 END AS tier FROM offers) SELECT merchant, tier, count(*) AS offers FROM (SELECT *, min(tier) OVER (PARTITION BY merchant) AS best FROM t) WHERE tier = best GROUP BY ALL")
def search_store_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when((F.col("price_confidence") == "observed") & (F.col("match_confidence") > 0.99), 0).when(F.col("data_kind") == "live", 1).otherwise(2)
    return pl.first_tier(offers(spark, d), "merchant", tier).groupBy("merchant", "tier").agg(F.count("*").alias("offers"))


@query("q_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# audits

@query(
    "q_audit_accounting",
    f"""{OFFERS_SQL}, b AS (SELECT *, product_price IS NULL OR NOT product_price > 0 OR currency <> 'SAR' AS bad, row_number() OVER (PARTITION BY merchant, product_id, condition ORDER BY offer_id) > 1 AS again FROM offers)
    SELECT merchant, count(*) AS raw, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad AND again) AS duplicates, count(*) FILTER (NOT bad AND NOT again) AS accepted FROM b GROUP BY merchant""",
)
def audit_accounting(spark: SparkSession, d: str) -> DataFrame:
    return au.account(offers(spark, d), "merchant", ["product_id", "condition"])


@query("q_audit_reasons", f"{OFFERS_SQL}, r AS (SELECT unnest(list_filter([CASE WHEN product_price IS NULL THEN 'missing_price' END, CASE WHEN currency <> 'SAR' THEN 'foreign_currency' END], lambda x: x IS NOT NULL)) AS reason FROM offers) SELECT reason, count(*) AS offers FROM r GROUP BY reason")
def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select(F.explode(au.violations()).alias("reason")).groupBy("reason").agg(F.count("*").alias("offers"))


@query("q_audit_warnings", f"{OFFERS_SQL}, r AS (SELECT merchant, unnest(list_filter([CASE WHEN shipping IS NULL THEN 'shipping_unknown' END, CASE WHEN availability = 'unknown' THEN 'availability_unknown' END, CASE WHEN delivery_days IS NULL THEN 'delivery_unknown' END], lambda x: x IS NOT NULL)) AS warning FROM offers) SELECT merchant, warning, count(*) AS offers FROM r GROUP BY ALL")
def audit_warnings(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("merchant", F.explode(au.warnings()).alias("warning")).groupBy("merchant", "warning").agg(F.count("*").alias("offers"))


_SHARES = {
    "correctness": "product_price > 0",
    "completeness": "sku IS NOT NULL",
    "stability": "shipping IS NOT NULL",
    "speed": "delivery_days <= 5",
    "repeatability": "price_confidence = 'observed'",
    "maintainability": "data_kind = 'live'",
    "resource_cost": "mandatory_fees IS NOT NULL",
}
_SHARES_SQL = ", ".join(f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END) AS {n}" for n, c in _SHARES.items())
_SCORE_SQL = "floor((0e0 + correctness * 0.25e0 + completeness * 0.18e0 + stability * 0.15e0 + speed * 0.12e0 + repeatability * 0.1e0 + maintainability * 0.1e0 + resource_cost * 0.1e0) * 10000 + 0.5) / 100"


def _shares() -> list[Column]:
    return [F.avg(F.when(F.expr(c), 1.0).otherwise(0.0)).alias(n) for n, c in _SHARES.items()]


@query(
    "q_certification",
    f"""{OFFERS_SQL}, m AS (SELECT merchant, {_SHARES_SQL}, avg(CASE WHEN title IS NOT NULL AND product_price IS NOT NULL AND source_url IS NOT NULL THEN 1e0 ELSE 0e0 END) AS critical, min(currency) = max(currency) AS one_currency, min(market) = max(market) AS one_market,
      avg(CASE WHEN match_confidence >= 0.35e0 THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS found, 1 - count(DISTINCT product_id) / count(*)::DOUBLE <= 0.5e0 AS paged, avg(CASE WHEN color IS NOT NULL THEN 1e0 ELSE 0e0 END) AS variants, count(*) FILTER (product_price <= 0) AS issues, avg(CASE WHEN price_confidence = 'observed' THEN 1e0 ELSE 0e0 END) >= 0.6e0 AS repeats FROM offers GROUP BY merchant),
    f AS (SELECT merchant, list_filter([CASE WHEN {_SCORE_SQL} < 70 THEN 'extraction_candidate' END, CASE WHEN critical < 0.99e0 THEN 'critical_fields' END, CASE WHEN correctness < 0.99e0 THEN 'price_validity' END, CASE WHEN NOT one_currency THEN 'currency_verified' END, CASE WHEN NOT one_market THEN 'market_verified' END, CASE WHEN NOT found THEN 'search_passed' END,
      CASE WHEN NOT paged THEN 'pagination_passed' END, CASE WHEN variants < 0.995e0 THEN 'variant_accuracy' END, CASE WHEN issues > 0 THEN 'semantic_issues' END, CASE WHEN NOT repeats THEN 'repeatability_passed' END], lambda x: x IS NOT NULL) AS failed FROM m)
    SELECT merchant, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed, CASE WHEN len(failed) = 0 THEN 'CERTIFIED' WHEN NOT list_contains(failed, 'extraction_candidate') THEN 'CANDIDATE' ELSE 'PROBED' END AS state FROM f""",
)
def certification(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(F.expr(c), 1.0).otherwise(0.0))
    evidence = offers(spark, d).groupBy("merchant").agg(
        *_shares(),
        F.lit(True).alias("reachable"),
        share("title is not null and product_price is not null and source_url is not null").alias("critical_field_coverage"),
        (F.min("currency") == F.max("currency")).alias("currency_verified"),
        (F.min("market") == F.max("market")).alias("market_verified"),
        (share("match_confidence >= 0.35") >= 0.5).alias("search_passed"),
        (1 - F.countDistinct("product_id") / F.count("*") <= 0.5).alias("pagination_passed"),
        share("color is not null").alias("variant_accuracy"),
        F.count_if(F.col("product_price") <= 0).alias("semantic_critical_issues"),
        (share("price_confidence = 'observed'") >= 0.6).alias("repeatability_passed"),
    )
    out = au.certify(evidence.withColumn("strategy_score", au.extraction_score()).withColumn("price_validity", F.col("correctness")))
    return out.select("merchant", F.array_join("failed", ",").alias("failed"), "passed", "state")


@query(
    "q_extraction_score",
    f"""{OFFERS_SQL}, m AS (SELECT merchant, provider, {_SHARES_SQL} FROM offers GROUP BY ALL), s AS (SELECT merchant, provider, {_SCORE_SQL} AS score FROM m) SELECT merchant, provider, score, row_number() OVER (PARTITION BY provider ORDER BY score DESC, merchant) AS place FROM s""",
)
def extraction_score(spark: SparkSession, d: str) -> DataFrame:
    out = offers(spark, d).groupBy("merchant", "provider").agg(*_shares()).withColumn("score", au.extraction_score())
    return out.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("score"), "merchant"))).select("merchant", "provider", "score", "place")


@query("q_repeatability", f"{OBSERVATIONS_SQL}, d AS (SELECT source_id, date_trunc('day', observed_at) AS day, count(*)::DOUBLE AS n FROM observations GROUP BY ALL) SELECT source_id, count(*) AS runs, (max(n) - min(n)) / avg(n) AS spread, (max(n) - min(n)) / avg(n) <= 0.15e0 AS repeatable FROM d GROUP BY source_id")
def repeatability(spark: SparkSession, d: str) -> DataFrame:
    daily = observations(spark, d).groupBy("source_id", F.date_trunc("day", F.col("observed_at").cast("timestamp")).alias("day")).agg(F.count("*").cast("double").alias("n"))
    return au.repeatability(daily, "source_id", "n")


@query("q_pagination_quality", f"{OFFERS_SQL}, q AS (SELECT merchant, product_id, count(*) AS n, min(currency) = max(currency) AS one FROM offers GROUP BY ALL) SELECT merchant, 1 - count(*) / sum(n)::DOUBLE AS duplicate_rate, CASE WHEN count(*) < 5 THEN 5 WHEN bool_and(one) AND count(*) >= 10 THEN NULL WHEN count(*) < 10 THEN 10 WHEN count(*) < 20 THEN 20 WHEN count(*) < 50 THEN 50 WHEN bool_and(one) THEN NULL ELSE 100 END AS next_sample FROM q GROUP BY merchant")
def pagination_quality(spark: SparkSession, d: str) -> DataFrame:
    products = offers(spark, d).groupBy("merchant", "product_id").agg(F.count("*").alias("n"), (F.min("currency") == F.max("currency")).alias("one"))
    return products.groupBy("merchant").agg((1 - F.count("*") / F.sum("n")).alias("duplicate_rate"), au.next_sample_size(F.count("*"), F.bool_and("one")).alias("next_sample"))


@query("q_variant_integrity", f"{OFFERS_SQL} SELECT product_id, sku, count(*) AS n FROM offers WHERE sku IS NOT NULL GROUP BY product_id, sku HAVING count(*) > 1")
def variant_integrity(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).where("sku is not null").groupBy("product_id", "sku").agg(F.count("*").alias("n")).where("n > 1")


@query("q_audit_matrix", f"{OFFERS_SQL}, s AS (SELECT DISTINCT provider FROM offers), c AS (SELECT DISTINCT category FROM offers), n AS (SELECT provider, category, count(*) FILTER (product_price > 0) AS passed, count(*) AS total FROM offers GROUP BY ALL) SELECT s.provider, c.category, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total FROM s CROSS JOIN c LEFT JOIN n ON n.provider = s.provider AND n.category = c.category")
def audit_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every source with every category: the grid is rolled up from the counts, which are few, not built from offers."""
    n = offers(spark, d).groupBy("provider", "category").agg(F.count_if(F.col("product_price") > 0).alias("passed"), F.count("*").alias("total"))
    grid = n.groupBy(F.lit(1).alias("g")).agg(F.collect_set("provider").alias("p"), F.collect_set("category").alias("c")).select(F.explode("p").alias("provider"), "c").select("provider", F.explode("c").alias("category"))
    return grid.join(n, ["provider", "category"], "left").select("provider", "category", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"))


@query("q_market_context", f"{OFFERS_SQL} SELECT market, currency, count(*) AS offers, count(*) FILTER (currency <> 'SAR' AND is_local) AS local_foreign FROM offers GROUP BY ALL")
def market_context(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("market", "currency").agg(F.count("*").alias("offers"), F.count_if((F.col("currency") != "SAR") & F.col("is_local")).alias("local_foreign"))


# the catalogue

@query("q_recall_scan", f"""{OFFERS_SQL}, w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(concat(title, ' ', brand)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM offers),
r AS (SELECT offer_id, len(list_filter(w, lambda t: t = 'red' OR t = 'ring')) / len(w)::DOUBLE AS text_rank, observed_at FROM w WHERE list_contains(w, 'red') AND list_contains(w, 'ring') AND (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(observed_at)) / 1e6 BETWEEN -60 AND 8640000)
SELECT offer_id, text_rank, observed_at FROM r ORDER BY text_rank DESC, observed_at DESC, offer_id LIMIT 100""")
def recall_scan(spark: SparkSession, d: str) -> DataFrame:
    return cat.recall(offers(spark, d), "red ring", OFFERS_NOW, 8_640_000, 100).select("offer_id", "text_rank", "observed_at")


@query("q_fresh_hits", f"{OFFERS_SQL}, a AS (SELECT (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(observed_at)) / 1e6 AS age FROM offers) SELECT CASE WHEN age < -60 THEN 'future' WHEN age > 8640000 THEN 'stale' ELSE 'kept' END AS reason, count(*) AS offers FROM a GROUP BY reason")
def fresh_hits(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy(F.coalesce(cat.reject_reason(OFFERS_NOW, 8_640_000), F.lit("kept")).alias("reason")).agg(F.count("*").alias("offers"))


@query("q_batch_upsert", f"{OFFERS_SQL}, b AS (SELECT *, CASE WHEN data_kind = 'live' THEN 1 ELSE 0 END AS side FROM offers) SELECT product_id, merchant, offer_id, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id, merchant ORDER BY observed_at DESC NULLS LAST, side, offer_id) AS rn FROM b) WHERE rn = 1")
def batch_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d)
    return cat.upsert(o.where("data_kind <> 'live'"), o.where("data_kind = 'live'"), ["product_id", "merchant"]).select("product_id", "merchant", "offer_id", "observed_at")


_REV = "WITH c AS (SELECT user_id AS key, count(*) AS revision FROM events GROUP BY user_id), i AS (SELECT user_id AS key, count(*) AS revision FROM events WHERE event_id % 97 <> 0 AND user_id % 13 <> 0 GROUP BY user_id UNION ALL SELECT 100000 + n_nationkey, 1 FROM nation)"


def _revisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id")
    index = e.where("event_id % 97 <> 0 and key % 13 <> 0").groupBy("key").agg(F.count("*").alias("revision"))
    extra = table(spark, d, "nation").select((F.lit(100000) + F.col("n_nationkey")).cast("long").alias("key"), F.lit(1).cast("long").alias("revision"))
    return e.groupBy("key").agg(F.count("*").alias("revision")), index.unionByName(extra)


@query("q_guarded_scan", f"{_REV} SELECT i.key, i.revision, c.revision AS canonical_revision, i.revision < c.revision AS lagging FROM i JOIN c USING (key)")
def guarded_scan(spark: SparkSession, d: str) -> DataFrame:
    c, i = _revisions(spark, d)
    return cat.guarded(i, c, "key")


@query("q_outbox", f"{_REV} SELECT CASE WHEN c.key IS NULL THEN 'orphan' WHEN i.revision = c.revision THEN 'published' ELSE 'superseded' END AS status, count(*) AS n FROM i LEFT JOIN c USING (key) GROUP BY status")
def outbox(spark: SparkSession, d: str) -> DataFrame:
    c, i = _revisions(spark, d)
    return cat.drain(i, c, "key").groupBy("status").agg(F.count("*").alias("n"))


@query("q_reconcile_index", f"{_REV} SELECT coalesce(c.key, i.key) AS key, CASE WHEN c.key IS NULL THEN 'prune' WHEN i.key IS NULL OR i.revision < c.revision THEN 'repair' ELSE 'keep' END AS action FROM c FULL JOIN i ON c.key = i.key")
def reconcile_index(spark: SparkSession, d: str) -> DataFrame:
    c, i = _revisions(spark, d)
    return cat.reconcile_index(c, i, "key")


@query("q_profile_diff", """WITH o AS (SELECT p_partkey, p_name AS n, CAST(p_size AS VARCHAR) AS s FROM part WHERE p_partkey % 7 <> 0), x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS n, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS s FROM part),
j AS (SELECT coalesce(o.p_partkey, x.p_partkey) AS p_partkey, o.n AS on1, x.n AS xn, o.s AS os, x.s AS xs FROM o FULL JOIN x ON o.p_partkey = x.p_partkey), u AS (SELECT p_partkey, 'p_name' AS field, on1 AS before, xn AS after FROM j UNION ALL SELECT p_partkey, 'p_size', os, xs FROM j) SELECT * FROM u WHERE before IS DISTINCT FROM after""")
def profile_diff(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return cat.field_diff(part.where("p_partkey % 7 <> 0"), new, "p_partkey", ["p_name", "p_size"])


@query("q_union_recovery", f"{OFFERS_SQL}, u AS (SELECT source_url, offer_id, 0 AS side FROM offers WHERE data_kind = 'indexed' UNION ALL SELECT source_url, offer_id, 1 FROM offers WHERE data_kind = 'live' AND match_confidence >= 0.9e0), n AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY side, offer_id) AS rn FROM u) SELECT source_url, offer_id, side FROM n WHERE rn = 1")
def union_recovery(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d)
    both = o.where("data_kind = 'indexed'").select("source_url", "offer_id", F.lit(0).alias("side")).unionByName(o.where("data_kind = 'live' and match_confidence >= 0.9").select("source_url", "offer_id", F.lit(1).alias("side")))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("source_url").orderBy("side", "offer_id"))).where("rn = 1").drop("rn")


@query("q_set_exclusions", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@query("q_quote_states", "SELECT o_orderstatus AS raw, CASE WHEN o_orderdate <= TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus = 'O' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'quoted' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'requested' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def quote_states(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("o_orderdate").cast("timestamp") <= F.lit("1997-01-01 00:00:00").cast("timestamp")
    state = F.when(old & (F.col("o_orderstatus") == "O"), "expired").when(F.col("o_orderstatus") == "O", "quoted").when(F.col("o_orderstatus") == "F", "accepted").otherwise("requested")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("raw"), state.alias("state")).agg(F.count("*").alias("n"))


# texts

@query("q_tokens", "WITH t AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("q_normalize_text")
def normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_text(F.col("text")).alias("normal"))


@query("q_capacity", f"{OFFERS_SQL} SELECT offer_id, CAST(regexp_extract(title, '([0-9]+)gb', 1) AS INT) AS capacity, CASE WHEN storage IS NULL THEN NULL ELSE lower(replace(storage, ' ', '')) END AS joined FROM offers")
def capacity(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", tx.capacity_gb(F.col("title")).alias("capacity"), tx.joined_units(tx.plain_text(F.col("storage"))).alias("joined"))


# streams

def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return raw.select("event_id", F.concat(F.lit("source_"), F.col("user_id") % 40).alias("source_id"), F.col("user_id").alias("product_id"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("transport_ok"), (F.col("value") * 100).alias("latency_ms"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("observed_at"))


@query("q_stream_newest", "SELECT user_id AS product_id, max(ts) AS observed_at, arg_max(value, struct_pack(a := ts, b := event_id)) AS price FROM events GROUP BY user_id")
def stream_newest(spark: SparkSession, d: str) -> DataFrame:
    out = st.run_available(st.newest_by_key(_stream(spark, d), "product_id"), "complete")
    return out.select("product_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "price")


@query("q_stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS events FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = st.run_available(st.windowed_counts(_stream(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "events")


@query("q_stream_distinct", "SELECT DISTINCT concat('source_', user_id % 40) AS source_id, event_type AS kind FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    return st.run_available(st.distinct_within(_stream(spark, d), ["source_id", "kind"]).select("source_id", "kind"), "append")
