"""Operators on raw pages: links, platform and page probes, blocked pages, embedded data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.urls import host

PROBES = {
    "has_json_ld": r'(?i)application/ld\+json',
    "has_hydrated_state": r"(?i)__NEXT_DATA__|__NUXT__|__APOLLO_STATE__|__INITIAL_STATE__",
    "has_open_graph": r'(?i)property="(og|product):',
    "has_form": r"(?i)<form\b",
    "has_article": r"(?i)<article\b",
    "has_table": r"(?i)<table\b",
    "is_blocked": r"(?i)captcha|access denied|unusual traffic|are you a robot",
}
PLATFORMS = {"shopify": r"(?i)cdn\.shopify|myshopify", "magento": r"(?i)mage/|magento", "woocommerce": r"(?i)woocommerce|wp-content", "salesforce": r"(?i)demandware|dw/shop"}


def probes(html: Column) -> dict[str, Column]:
    return {name: html.rlike(pattern) for name, pattern in PROBES.items()}


def platform(html: Column) -> Column:
    return F.coalesce(*[F.when(html.rlike(p), F.lit(n)) for n, p in PLATFORMS.items()], F.lit("unknown"))


def page_model(html: Column) -> Column:
    links = F.regexp_count(html, F.lit(r"(?i)<a\s"))
    return F.when(html.rlike(PROBES["is_blocked"]), "blocked").when(html.rlike(PROBES["has_article"]), "article").when(links > 50, "listing").otherwise("unknown")


def links(pages: DataFrame) -> DataFrame:
    """page_id and each distinct address that a page links to, made absolute."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"#]+)"'), F.lit(1)))
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    rows = pages.select("page_id", root.alias("root"), F.explode(found).alias("href"))
    full = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("root", "href")).otherwise(F.concat("root", F.lit("/"), "href"))
    return rows.select("page_id", full.alias("link"), (host(full) == host(F.col("root"))).alias("same_host"))


def diagnostics(pages: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    return pages.select("page_id", F.length("html").alias("chars"), count("(?i)<a ").alias("links"), count("(?i)<p>").alias("paragraphs"), count("(?i)<script").alias("scripts"), platform(F.col("html")).alias("platform"), page_model(F.col("html")).alias("model"))


class _Blocks(HTMLParser):
    """The JSON-LD blocks and the meta properties of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.blocks, self.meta = False, [], {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.inside = True
            self.blocks.append("")
        elif tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a.get("name"), a.get("content") or "")

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "script"

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.blocks[-1] += data


def _nodes(value: object) -> Iterator[dict]:
    """Every object within a value, outer ones first, however deep."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, dict):
            yield v
            waiting += [x for x in reversed(list(v.values())) if isinstance(x, (dict, list))]
        elif isinstance(v, list):
            waiting += reversed(v)


def _is(node: dict, kind: str) -> bool:
    t = node.get("@type")
    return kind in (t if isinstance(t, list) else [t])


def products_of(html: str) -> list[dict]:
    """Offers that a page states: JSON-LD products (variants of a group too, references resolved), else one from meta properties. One source owns the price."""
    parser = _Blocks()
    parser.feed(html or "")
    nodes: list[dict] = []
    for block in parser.blocks:
        try:
            nodes += _nodes(json.loads(block))
        except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser reads
            continue
    by_id = {n["@id"]: n for n in nodes if isinstance(n.get("@id"), str) and len(n) > 1}
    resolve = lambda n: by_id.get(n.get("@id"), n) if isinstance(n, dict) and set(n) == {"@id"} else n
    out, seen = [], set()
    for n in nodes:
        if not _is(n, "Product"):
            continue
        offers = n.get("offers")
        for o in offers if isinstance(offers, list) else [offers]:
            o = resolve(o)
            if not isinstance(o, dict) or _is(o, "AggregateOffer"):
                continue
            key = (n.get("sku"), n.get("name"), o.get("price"), o.get("priceCurrency"))
            if o.get("price") is None or key in seen:
                continue
            seen.add(key)
            brand = n.get("brand")
            out.append({"strategy": "jsonld", "name": n.get("name"), "sku": n.get("sku"), "brand": brand.get("name") if isinstance(brand, dict) else brand, "price": str(o["price"]), "currency": o.get("priceCurrency"), "availability": o.get("availability"), "condition": o.get("itemCondition"), "url": o.get("url")})
    price = parser.meta.get("product:price:amount") or parser.meta.get("og:price:amount")
    if not out and price:
        out.append({"strategy": "meta", "name": parser.meta.get("og:title"), "sku": None, "brand": parser.meta.get("product:brand"), "price": price, "currency": parser.meta.get("product:price:currency"), "availability": parser.meta.get("product:availability"), "condition": None, "url": parser.meta.get("og:url")})
    return out


_PRODUCT = "strategy string, name string, sku string, brand string, price string, currency string, availability string, condition string, url string"


def extract_products(pages: DataFrame) -> DataFrame:
    """page_id and the offers of each page, in Arrow batches: JSON-LD needs a parser of HTML and of free-form JSON."""
    fields = [f.split()[0] for f in _PRODUCT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *(o.get(f) if o.get(f) is None else str(o.get(f)) for f in fields)) for p, html in zip(pdf["page_id"], pdf["html"], strict=True) for o in products_of(html)]
            yield pd.DataFrame(rows, columns=["page_id", *fields])

    return pages.select("page_id", "html").mapInPandas(run, f"page_id long, {_PRODUCT}")


def embedded_offers(pages: DataFrame, words: list[str]) -> DataFrame:
    """page_id, title, price, currency, url: every object in a page's embedded JSON that has all four, at least a fifth of the words in its title, and a positive price; each address and price of a page once."""
    names = {"title": ("title", "name"), "price": ("price", "salePrice"), "currency": ("currency", "priceCurrency"), "url": ("url", "productUrl")}
    wanted = {w.lower() for w in words}

    def found(html: str | None) -> Iterator[tuple[str, float, str, str]]:
        seen = set()
        for block in re.findall(r'(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>', html or ""):
            try:
                nodes = list(_nodes(json.loads(block)))
            except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser reads
                continue
            for n in nodes:
                v = {k: next((n[a] for a in aliases if isinstance(n.get(a), (str, int, float)) and n[a] != ""), None) for k, aliases in names.items()}
                try:
                    price = float(v["price"])
                except (TypeError, ValueError):
                    continue
                if None in v.values() or not 0 < price < float("inf"):
                    continue
                hits = len(wanted & set(re.findall(r"\w+", str(v["title"]).lower())))
                key = (str(v["url"]), price)
                if (not wanted or hits / len(wanted) >= 0.2) and key not in seen:
                    seen.add(key)
                    yield str(v["title"]), price, str(v["currency"]), str(v["url"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *o) for p, html in zip(pdf["page_id"], pdf["html"], strict=True) for o in found(html)]
            yield pd.DataFrame(rows, columns=["page_id", "title", "price", "currency", "url"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, price double, currency string, url string")


def recovery_links(links: DataFrame, answered: DataFrame, words: list[str], most: int = 2) -> DataFrame:
    """At most two links of each page without a direct offer: its own host's, those with most of the words first. answered: page_id."""
    score = sum((F.when(F.lower("link").contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    open_links = links.where("same_host and link like 'https://%'").join(answered.select("page_id").distinct(), "page_id", "left_anti")
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "link")
    return open_links.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


VARIANT_STATE = "id string, title string, vendor string, variants array<struct<id: string, sku: string, title: string, price: long, available: boolean>>"


def variant_state(pages: DataFrame) -> DataFrame:
    """page_id, variant_id, sku, title, price, availability of the variants that a hosted shop's page holds as JSON; prices come in hundredths."""
    text = F.regexp_extract("html", r'(?is)<script[^>]*id="ProductJson[^"]*"[^>]*>(.*?)</script>', 1)
    rows = pages.select("page_id", F.from_json(text, VARIANT_STATE).alias("p")).select("page_id", "p.title", F.explode("p.variants").alias("v")).where("v.id is not null and v.price > 0")
    named = F.when(F.coalesce("v.title", F.lit("Default Title")) == "Default Title", F.col("title")).otherwise(F.concat("title", F.lit(" · "), "v.title"))
    stock = F.when(F.col("v.available"), "in_stock").when(~F.col("v.available"), "out_of_stock").otherwise("unknown")
    return rows.select("page_id", F.col("v.id").alias("variant_id"), "v.sku", named.alias("title"), (F.col("v.price") / 100).alias("price"), stock.alias("availability"))
