"""Merchants' payloads as offers: each format is a schema, a path to its items, and a projection. No payload is fetched here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.money import parse_money
from quaylens.functions.text import normalize_availability, normalize_condition


@dataclass(frozen=True)
class Format:
    """schema: DDL of the payload; items: SQL for the array of items; fields: SQL over `i`, one item, for each offer column; most: items kept per product."""

    name: str
    schema: str
    items: str
    fields: dict[str, str]
    most: int | None = None


FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("search_api", "response struct<products: array<struct<uniqueId: string, title: string, brand: string, price: string, sellingPrice: string, availability: string, productUrl: string>>>", "p.response.products", {"listing_id": "i.uniqueId", "title": "i.title", "brand": "i.brand", "price": "coalesce(i.sellingPrice, i.price)", "availability": "i.availability", "url": "i.productUrl"}),
        Format("constructor", "results array<struct<value: string, data: struct<id: string, brand: string, final_price: string, stock: string, url: string>>>", "p.results", {"listing_id": "i.data.id", "title": "i.value", "brand": "i.data.brand", "price": "i.data.final_price", "availability": "i.data.stock", "url": "i.data.url"}),
        Format("hits", "hits array<struct<objectID: string, name: string, brand: string, prices: struct<sale: string, list: string>, in_stock: boolean, permalink: string>>", "p.hits", {"listing_id": "i.objectID", "title": "i.name", "brand": "i.brand", "price": "coalesce(i.prices.sale, i.prices.list)", "availability": "case when i.in_stock then 'in stock' when not i.in_stock then 'out of stock' end", "url": "i.permalink"}),
        Format("storefront", "products array<struct<id: string, title: string, vendor: string, handle: string, variants: array<struct<id: string, sku: string, price: string, available: boolean>>>>", "flatten(transform(p.products, x -> transform(x.variants, v -> struct(x.id as product, x.title as title, x.vendor as vendor, x.handle as handle, v as v))))", {"listing_id": "i.v.id", "group_id": "i.product", "title": "i.title", "brand": "i.vendor", "price": "i.v.price", "availability": "case when i.v.available then 'in stock' when not i.v.available then 'out of stock' end", "url": "i.handle"}, most=3),
        Format("item_summaries", "itemSummaries array<struct<itemId: string, title: string, brand: string, price: struct<value: string, currency: string>, condition: string, itemWebUrl: string, shippingOptions: array<struct<cost: string>>>>", "p.itemSummaries", {"listing_id": "i.itemId", "title": "i.title", "brand": "i.brand", "price": "i.price.value", "currency": "i.price.currency", "condition": "i.condition", "url": "i.itemWebUrl", "shipping": "array_min(transform(i.shippingOptions, s -> try_cast(s.cost as double)))"}),
        Format(
            "marketplace_hits",
            "hits array<struct<sku: string, sku_config: string, name: string, brand: string, price: double, sale_price: double, is_buyable: boolean, url: string, flags: array<string>, store_name: string>>",
            "filter(p.hits, x -> coalesce(x.sale_price, x.price) > 0)",
            {
                "listing_id": "coalesce(i.sku, i.sku_config)",
                "title": "i.name",
                "brand": "i.brand",
                "price": "cast(cast(case when i.sale_price > 0 and (i.price is null or i.sale_price <= i.price) then i.sale_price else i.price end as decimal(18,2)) as string)",
                "availability": "case when i.is_buyable then 'in stock' when not i.is_buyable then 'out of stock' end",
                "url": "i.url",
                "shipping": "case when array_contains(i.flags, 'free_delivery_eligible') then 0e0 end",
            },
        ),
        Format(
            "cards",
            "rows array<struct<cards: array<struct<type: string, additionalAttributes: struct<productId: string, offerId: string, shopName: string, productName: string, productUrl: string, stock: string, price: string>>>>>",
            "filter(transform(flatten(transform(p.rows, r -> r.cards)), c -> c.additionalAttributes), a -> a.productId is not null)",
            {"listing_id": "concat_ws('|', i.productId, i.offerId, i.shopName, i.price)", "group_id": "i.productId", "title": "i.productName", "price": "i.price", "availability": "i.stock", "url": "i.productUrl"},
        ),
        Format(
            "catalog_items",
            "searchResult struct<items: array<struct<asin: string, detailPageURL: string, title: string, brand: string, listings: array<struct<isBuyBoxWinner: boolean, amount: double, currency: string, condition: string, availability: string, merchant: string>>>>>",
            "filter(transform(p.searchResult.items, x -> struct(x.asin as asin, x.detailPageURL as url, x.title as title, x.brand as brand, coalesce(get(filter(x.listings, l -> l.isBuyBoxWinner), 0), get(x.listings, 0)) as l)), i -> i.asin is not null and i.l.amount > 0)",
            {
                "listing_id": "i.asin",
                "title": "coalesce(i.title, concat('Item ', i.asin))",
                "brand": "i.brand",
                "price": "cast(cast(i.l.amount as decimal(18,2)) as string)",
                "currency": "upper(i.l.currency)",
                "condition": "coalesce(i.l.condition, 'new')",
                "availability": "case when upper(i.l.availability) like '%IN_STOCK%' then 'in stock' when upper(i.l.availability) like '%OUT_OF_STOCK%' then 'out of stock' end",
                "url": "i.url",
            },
        ),
    )
}


def parse(payloads: DataFrame, fmt: Format) -> DataFrame:
    """Offers from a table of payloads (source_id, payload): one row per item, money and words in normal form, repeated listings once. A payload that isn't of the format has no items."""
    parsed = payloads.select("source_id", F.from_json("payload", fmt.schema).alias("p"))
    items = parsed.select("source_id", F.posexplode(F.expr(fmt.items)).alias("position", "i"))
    col = lambda name: F.expr(fmt.fields[name]) if name in fmt.fields else F.lit(None).cast("string")
    rows = items.select("source_id", "position", *[col(n).alias(n) for n in ("listing_id", "group_id", "title", "brand", "price", "currency", "availability", "condition", "url")], (F.expr(fmt.fields["shipping"]) if "shipping" in fmt.fields else F.lit(None)).cast("double").alias("shipping"))
    rows = rows.withColumn("price", parse_money(F.col("price"))).withColumn("availability", normalize_availability(F.col("availability"))).withColumn("condition", normalize_condition(F.col("condition")))
    first = F.row_number().over(Window.partitionBy("source_id", "listing_id").orderBy("position"))
    rows = rows.where("listing_id is not null and length(trim(title)) > 0").withColumn("_rn", first).where("_rn = 1").drop("_rn")
    if fmt.most is not None:
        within = F.row_number().over(Window.partitionBy("source_id", "group_id").orderBy("position"))
        rows = rows.withColumn("_rn", within).where(F.col("_rn") <= fmt.most).drop("_rn")
    return rows


def first_tier(rows: DataFrame, by: str, tier: Column) -> DataFrame:
    """Of each store the rows of the best tier that has any. The best tier is an aggregate joined back, so that a large store isn't one task."""
    marked = rows.withColumn("tier", tier)
    best = marked.groupBy(F.col(by).alias("_by")).agg(F.min("tier").alias("_best"))
    return marked.join(best, (F.col(by) == F.col("_by")) & (F.col("tier") == F.col("_best"))).drop("_by", "_best")

