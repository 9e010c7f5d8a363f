"""Queries about a merchant's links, variants and products, what else to ask it, and the way of a source into the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.operators import addresses as ad
from quaylens.operators import coverage as cov
from quaylens.operators import matching as mt
from quaylens.operators import onboarding as ob
from quaylens.operators.product_links import product_links
from quaylens.plans.catalog_queries import CATEGORIES, COLORS
from quaylens.plans.registry import query
from quaylens.sources.views import OFFERS_SQL, offers, table


def _choice(key: str, values: tuple[str | None, ...]) -> str:
    """SQL that both engines read: a value by the remainder of a key."""
    said = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case ({key}) % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(said)) + " end"


@query(
    "q_product_links",
    r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages WHERE url LIKE 'https:%'),
    d AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '(?i)["'']((?:https?:)?(?:\\?/){1,2}[^"'' <>\s]+)["'']', 1)) AS href, '' AS label, 1000000 AS pos FROM pages WHERE url LIKE 'https:%'),
    f AS (SELECT page_id, url, pos, trim(regexp_replace(label, '<[^>]*>', ' ', 'g')) AS label, replace(CASE WHEN href LIKE 'http%' THEN href WHEN starts_with(href, '/') THEN concat(root, href) END, '&amp;', '&') AS link FROM (SELECT * FROM a UNION ALL SELECT * FROM d)),
    s AS (SELECT *, regexp_replace(lower(concat(label, ' ', link)), '[^\p{L}\p{N}]+', ' ', 'g') AS said FROM f WHERE starts_with(link, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/')) AND regexp_matches(link, '^https://[^/]+/[A-Z]')),
    g AS (SELECT page_id, link, ((contains(said, 'th'))::INT + (contains(said, 'es'))::INT + (contains(said, 'page'))::INT) / 3e0 AS score, pos FROM s QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1)
    SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos, link) AS place FROM g WHERE score >= 0.2e0 QUALIFY place <= 5""",
)
def best_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page's five best links to addresses that begin with a capital."""
    return product_links(table(spark, d, "pages"), "th es page", "^/[A-Z]", 5).select("page_id", "link", "score", "place")


_HOSTS = ("shop.example.com", "www.shop.example.com")
_STEP = "concat('https://shop.example.com/en/p/SKU', k, '?step=', {})"
_ASKED = f"case when k % 9 = 8 then concat('http://shop.example.com/p/SKU', k) else concat({_STEP.format('0')}, '#top') end"
#: of each product's addresses all but the last lead on, one of some products astray
_ANSWER = {
    "address": _STEP.format("i"),
    "head_status": "case when i < k % 5 then 301 else case k % 6 when 0 then 200 when 1 then 404 when 2 then 503 when 3 then 405 when 4 then 403 else 400 end end",
    "head_location": "case when i < k % 5 then case when k % 7 = 6 and i = 1 then concat('/en/p/SKU', k, '?step=0') when k % 11 = 10 and i = 0 then 'https://other.example.com/' when k % 13 = 12 and i = 0 then '/en/p/OTHER?step=1' else concat('/en/p/SKU', k, '?step=', i + 1) end end",
    "get_status": "case when i < k % 5 then null else case k % 6 when 3 then 200 when 4 then 410 end end",
    "get_location": "cast(null as {})",
}


@query(
    "q_link_health",
    f"""WITH RECURSIVE steps AS (SELECT p_partkey AS k, unnest(range(0, p_partkey % 5 + 1)) AS i FROM part), answers AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ANSWER.items() if n != "get_location")} FROM steps),
    known AS (SELECT address, CASE WHEN head_status IN (403, 405, 501) THEN get_status ELSE head_status END AS code, CASE WHEN starts_with(head_location, '/') THEN concat('https://shop.example.com', head_location) ELSE head_location END AS target FROM answers),
    walk AS (SELECT p_partkey AS k, 0 AS hop, CASE WHEN p_partkey % 9 <> 8 THEN concat('https://shop.example.com/en/p/SKU', p_partkey, '?step=0') END AS here, []::VARCHAR[] AS seen, CASE WHEN p_partkey % 9 = 8 THEN 'INVALID_URL' END AS st FROM part
      UNION ALL SELECT w.k, hop + 1, CASE WHEN code = 301 THEN target ELSE here END, list_append(seen, here), CASE WHEN list_contains(seen, here) THEN 'REDIRECT_LOOP' WHEN NOT contains(here, concat('/p/SKU', w.k, '?')) THEN 'SKU_HINT_MISMATCH' WHEN code IS NULL THEN 'RETRYABLE_ERROR' WHEN code = 301 AND NOT starts_with(target, 'https://shop.example.com/') THEN 'UNSAFE_REDIRECT'
        WHEN code = 301 AND hop = 3 THEN 'REDIRECT_LIMIT' WHEN code = 301 THEN NULL WHEN code = 200 THEN 'OK' WHEN code IN (404, 410) THEN 'NOT_FOUND' WHEN code = 503 THEN 'RETRYABLE_ERROR' ELSE 'REJECTED' END FROM walk w LEFT JOIN known ON known.address = w.here WHERE w.st IS NULL)
    SELECT k AS product_id, st AS link_status, CASE WHEN st = 'OK' THEN here END AS final_url FROM walk WHERE st IS NOT NULL""",
)
def link_health(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    steps = parts.select("k", F.explode(F.sequence(F.lit(0), (F.col("k") % 5).cast("int"))).alias("i"))
    answers = steps.selectExpr(*[f"{e.format('string') if n == 'get_location' else e} AS {n}" for n, e in _ANSWER.items()])
    links = parts.selectExpr("k AS product_id", f"{_ASKED} AS address", "concat('SKU', k) AS sku").where("length(sku) >= 4")
    return ad.link_health(links, answers, _HOSTS).select("product_id", "link_status", "final_url")


_LINE = ad.VariantLine("Superlux", "HD-662", ("hd", "662"), ("F", "B"), "www.shop.example.de", ("/de/superlux_hd662", ".htm"))
_NAMED = ("Superlux HD-662", "Superlux HD 662 F", "superlux hd662b", "Superlux HD-662 Evo", "Superlux HD-662 F B-Stock", "Superlux HD-668 B", None)
_PATHS = ("/de/superlux_hd662.htm", "/de/superlux_hd662_f.htm", "/de/superlux_hd662_b.htm", "/de/superlux_hd662_evo.htm")
_CARD = {
    "offer_id": "offer_id",
    "title": _choice("product_id", _NAMED),
    "source_url": f"concat('https://www.shop.example.de', {_choice('length(merchant) + product_id', _PATHS)}, '?o=', offer_id)",
    "price": "product_price",
    "currency": "case when product_id % 9 = 0 then 'USD' else 'EUR' end",
}
_PAGE = {"title": "title", "source_url": "source_url", "price": "case when length(offer_id) % 5 = 0 then price + 1 else price end", "currency": "'EUR'"}


@query(
    "q_variant_parity",
    rf"""{OFFERS_SQL}, c AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _CARD.items())} FROM offers), p AS (SELECT *, CASE WHEN regexp_matches(source_url, '(?i)/superlux_hd662(_[fb])?\.htm') THEN coalesce(nullif(upper(regexp_extract(source_url, '(?i)/superlux_hd662_?([fb]?)\.htm', 1)), ''), 'BASE') END AS pv,
    CASE WHEN regexp_matches(title, '(?i)^superlux\s+hd[\s-]*662(?:[\s-]*[fb])?$') THEN coalesce(nullif(upper(regexp_extract(title, '(?i)662[\s-]*([fb])$', 1)), ''), 'BASE') END AS tv FROM c),
    v AS (SELECT *, CASE WHEN pv = tv THEN pv END AS variant, length(offer_id) % 5 = 0 AS dearer FROM p)
    SELECT variant, coalesce(CASE WHEN pv IS NULL THEN false ELSE variant = 'F' END, false) AS fits, CASE WHEN variant IS NULL THEN 'VARIANT_IDENTITY_CONFLICT' WHEN currency <> 'EUR' THEN 'CURRENCY_CONFLICT' WHEN price IS NULL THEN 'PRICE_NOT_OBSERVED' WHEN dearer THEN 'SEARCH_PDP_PRICE_CONFLICT' ELSE 'PDP_PARITY_CONFIRMED' END AS parity, count(*) AS n FROM v GROUP BY ALL""",
)
def variant_parity(spark: SparkSession, d: str) -> DataFrame:
    """Search cards of one model's variants against the products' own pages."""
    cards = offers(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in _CARD.items()])
    pages = cards.selectExpr(*[f"{e} AS {n}" for n, e in _PAGE.items()])
    told = _LINE.parity(cards, pages).withColumn("fits", _LINE.fitting("superlux hd-662 f", F.col("page_variant"), F.col("variant")))
    return told.groupBy("variant", "fits", "parity").agg(F.count("*").alias("n"))


_PRODUCT = {
    "merchant": "merchant",
    "source_product_id": "product_id",
    "title": "title",
    "price": "product_price",
    "currency": "currency",
    "product_url": "case when product_id % 40 = 0 then '' else source_url end",
    "sku": "sku",
    "capacity": "storage",
    "size": "cast(null as {s})",
    "concentration": "cast(null as {s})",
    "edition": "case when sku is not null then color end",
    "condition": "case when sku is not null then concat(condition, ' ', offer_id) end",
    "price_label": "case when product_id % 10 = 0 then 'SAR 10 per month' end",
    "price_text": "case when product_id % 15 = 0 then 'trade-in' end",
}
_CHECKED_SQL = f"""{OFFERS_SQL}, p AS (SELECT {", ".join(f"{e.format(s='varchar')} AS {n}" for n, e in _PRODUCT.items())} FROM offers), k AS (SELECT *, lower(concat_ws('|', sku, capacity, edition, condition)) AS variant_key, product_url <> '' AND coalesce(price > 0, false) AS filled, coalesce(price_label, '') <> '' OR coalesce(price_text, '') <> '' AS semantic FROM p),
g AS (SELECT merchant, variant_key, count(*) AS n, count(*) FILTER (filled AND NOT semantic) AS ok, count(*) FILTER (semantic) AS sem, count(*) FILTER (price IS NULL) AS priceless FROM k GROUP BY ALL)"""


@query("q_verify_products", f"{_CHECKED_SQL} SELECT merchant, sum(n)::BIGINT AS products, sum(ok)::BIGINT AS valid, sum(sem)::BIGINT AS semantic_issues, sum(CASE WHEN variant_key = '' THEN n ELSE n - 1 + priceless END)::BIGINT AS variant_issues, sum(ok) / sum(n)::DOUBLE AS price_validity, greatest(0e0, (sum(n) - sum(CASE WHEN variant_key = '' THEN n ELSE n - 1 + priceless END)) / sum(n)::DOUBLE) AS variant_accuracy, sum(ok) = sum(n) AND sum(CASE WHEN variant_key = '' THEN n ELSE n - 1 + priceless END) = 0 AS verified FROM g GROUP BY merchant")
def verify_products(spark: SparkSession, d: str) -> DataFrame:
    return ob.verify_products(offers(spark, d).selectExpr(*[f"{e.format(s='string')} AS {n}" for n, e in _PRODUCT.items()]), "merchant")


@query("q_product_issues", f"{_CHECKED_SQL}, i AS (SELECT merchant, unnest([CASE WHEN product_url = '' OR price IS NULL THEN 'field-coverage' END, CASE WHEN NOT coalesce(price > 0, false) THEN 'invalid-price' END, CASE WHEN semantic THEN 'semantic-price' END, CASE WHEN variant_key = '' THEN 'missing-identity' END, CASE WHEN variant_key <> '' AND price IS NULL THEN 'missing-price' END]) AS issue FROM k) SELECT merchant, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY ALL")
def product_issues(spark: SparkSession, d: str) -> DataFrame:
    products = offers(spark, d).selectExpr(*[f"{e.format(s='string')} AS {n}" for n, e in _PRODUCT.items()])
    return ob.product_issues(products, "merchant").groupBy("merchant", "issue").agg(F.count("*").alias("n"))


@query(
    "q_onboarding",
    f"""{OFFERS_SQL}, s AS (SELECT s_suppkey AS k, s_name AS merchant FROM supplier), r AS (SELECT merchant, product_price, row_number() OVER (PARTITION BY merchant ORDER BY offer_id, product_price) AS n FROM offers), c AS (SELECT merchant, avg(CASE WHEN product_price > 0 THEN 1e0 ELSE 0e0 END) >= 0.99e0 AS tried FROM r WHERE n <= 200 GROUP BY merchant), h AS (SELECT DISTINCT merchant FROM offers)
    SELECT s.merchant, array_to_string(list_filter([CASE WHEN k % 8 = 0 THEN 'no-strong-fast-strategy' END, CASE WHEN k % 9 = 4 THEN 'javascript-required' END, CASE WHEN k % 10 = 7 THEN 'network-endpoint-unknown' END], lambda x: x IS NOT NULL), ',') AS probe_reasons,
    array_to_string(list_filter([CASE WHEN k % 6 = 1 OR h.merchant IS NULL THEN 'critical_fields' END, CASE WHEN k % 6 = 1 OR h.merchant IS NULL THEN 'price_validity' END, CASE WHEN k % 5 = 3 THEN 'market_verified' END, CASE WHEN k % 6 = 1 AND h.merchant IS NOT NULL THEN 'semantic_issues' END], lambda x: x IS NOT NULL), ',') AS failed,
    CASE WHEN k % 8 = 0 OR k % 9 = 4 OR k % 10 = 7 THEN 'DEEP_PROBE_REQUIRED' WHEN k % 6 = 1 OR k % 5 = 3 OR h.merchant IS NULL THEN 'VERIFICATION_FAILED' WHEN NOT coalesce(tried, false) THEN 'CANARY_FAILED' WHEN k % 4 = 2 THEN 'E2E_FAILED' ELSE 'READY_FOR_REGISTRY' END AS stage
    FROM s LEFT JOIN c ON c.merchant = s.merchant LEFT JOIN h ON h.merchant = s.merchant""",
)
def onboarding(spark: SparkSession, d: str) -> DataFrame:
    """How far each supplier has come as a source."""
    k = "s_suppkey"
    profile = ["s_name AS merchant", f"84 + {k} % 8 AS strategy_score", f"case when {k} % 9 = 4 then 'required' end AS javascript", "'discovered' AS search", f"case when {k} % 10 <> 7 then array('/search') end AS search_endpoints", "'listed' AS variants", "'page' AS pagination"]
    evidence = [f"{v} AS {c}" for c, v in {"reachable": "true", "currency_verified": "true", "market_verified": f"{k} % 5 <> 3", "search_passed": "true", "repeatability_passed": "true", "pagination_passed": "true"}.items()]
    unknown = [f"cast(null as double) AS {c}" for c in ("critical_field_coverage", "price_validity", "variant_accuracy")] + ["cast(null as bigint) AS semantic_critical_issues"]
    supplier, o = table(spark, d, "supplier"), offers(spark, d)
    sold = o.groupBy("merchant", "product_id").agg(F.max(F.coalesce("product_price", F.lit(1.0))).alias("price")).join(supplier.select(F.col("s_name").alias("merchant"), k), "merchant")
    products = sold.selectExpr("merchant", "product_id AS source_product_id", "'a part' AS title", "price", "'SAR' AS currency", "'https://x.example.com/' AS product_url", "concat('SKU', product_id) AS sku", *[f"cast(null as string) AS {c}" for c in ob.VARIANT_FIELDS[1:]], f"case when {k} % 6 = 1 then 'per month' end AS price_label", "cast(null as string) AS price_text")
    stages = supplier.select(F.col("s_name").alias("merchant"), k, F.explode(F.array(*[F.lit(s) for s in cov.E2E_STAGES])).alias("stage")).selectExpr("merchant", "stage", f"not ({k} % 4 = 2 and stage = 'frontend') AS passed")
    out = ob.onboard(supplier.selectExpr(*profile, *evidence, *unknown), products, o, stages, "merchant", ["offer_id", "product_price"])
    return out.select("merchant", F.array_join("probe_reasons", ",").alias("probe_reasons"), F.array_join("failed", ",").alias("failed"), "stage")


_USED = mt.parse_intent("used red widget 128gb", CATEGORIES, COLORS)


@query("q_fallback_queries", f"{OFFERS_SQL}, q AS (SELECT * FROM (VALUES (0, 'widget'), (1, 'widget used')) AS t(step, q)), w AS (SELECT string_split(concat(title, ' ', condition), ' ') AS w, count(*) AS n FROM offers GROUP BY ALL) SELECT step, q, sum(n)::BIGINT AS hits FROM q JOIN w ON len(list_filter(string_split(q, ' '), lambda x: NOT list_contains(w, x))) = 0 GROUP BY step, q")
def fallback_queries(spark: SparkSession, d: str) -> DataFrame:
    """What else would be asked for a used red widget, and how many offers each query finds; one pass over the offers for all."""
    words = F.split(F.concat_ws(" ", "title", "condition"), " ")
    asked = mt.fallback_queries(_USED)
    fits = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in q.split()]), words)) == 0, F.struct(F.lit(i).alias("step"), F.lit(q).alias("q"))) for i, q in enumerate(asked)]
    return offers(spark, d).select(F.explode(F.array_compact(F.array(*fits))).alias("f")).groupBy("f.step", "f.q").agg(F.count("*").alias("hits"))


_SHOES = ("Nike Pegasus running shoes", "Nike Court shoes", "Acme sports shoes", "Nike sports bag", "Nike shoes cover", "Sandals")
_SHOE = {"offer_id": "offer_id", "title": _choice("product_id", _SHOES), "brand": "brand", "category": "case when product_id % 4 = 3 then 'bag' else 'shoes' end", "condition": "condition", "storage": "storage", "source_url": "concat('https://x.example.com/sports/', product_id)"}


@query(
    "q_athletic_shoes",
    rf"""{OFFERS_SQL}, t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _SHOE.items())} FROM offers), a AS (SELECT *, lower(title) AS l, regexp_matches(lower(title), '\b(?:running|sports? (?:shoes?|sneakers?))\b') AS athletic FROM t), h AS (SELECT *, (l LIKE '%nike%')::INT + athletic::INT AS hits, condition NOT IN ('new', 'unknown') AS worn FROM a),
    s AS (SELECT *, (CASE WHEN category = 'shoes' THEN least(1e0, (hits + 1) / 3e0) ELSE hits / 2e0 * 0.2e0 END) * (CASE WHEN l LIKE '%cover%' THEN 0.12e0 ELSE 1e0 END) - (CASE WHEN worn THEN 0.15e0 ELSE 0e0 END) AS b FROM h)
    SELECT offer_id, floor(greatest(0e0, least(1e0, CASE WHEN athletic THEN b ELSE least(b, 0.69e0) END)) * 100 + 0.5) / 100 AS query_score, athletic AND hits = 2 AND category = 'shoes' AND NOT worn AS exact FROM s""",
)
def athletic_shoes(spark: SparkSession, d: str) -> DataFrame:
    """Offers of shoes scored for a query of a brand's sports shoes: the sold title must prove the use."""
    titled = offers(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in _SHOE.items()])
    return mt.assess(titled, mt.parse_intent("nike sports shoes")).select("offer_id", "query_score", "exact")
