"""Candidates of a page by every way of extraction, as a Python table function: a page in, a row for each way out, or why it gave none.

A way that finds more than one product, or more than one offer of it, refuses rather than picks; so does one whose product isn't the expected
one. Which way is believed is decided later, by `evidence.preferred`, or by `owner`, where the first tier that found something owns the price.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quaylens.operators.evidence import STRATEGY_CONFIDENCE
from quaylens.operators.pages import _is, _nodes

CANDIDATE = "strategy string, name string, sku string, brand string, price string, currency string, availability string, refused string"
#: How sure the visible text of a page is, and the tiers of which the first that found something owns a page's price.
VISIBLE_CONFIDENCE = 0.6
TIERS = (("jsonld", "domain_adapter", "embedded_json", "storefront_data", "hydrated_state"), ("meta",), ("visible_dom",))
#: How currencies are written.
CURRENCIES = {"ر.س": "SAR", "SAR": "SAR", "SR": "SAR", "AED": "AED", "د.إ": "AED", "USD": "USD", "$": "USD", "GBP": "GBP", "£": "GBP", "EUR": "EUR", "€": "EUR"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STATE = re.compile(r"__(?:INITIAL_STATE|NUXT|APOLLO_STATE|PRELOADED_STATE)__\s*=\s*(?=[{\[])")
#: What objects in embedded JSON may call a field
NAMES = {"name": ("name", "title", "productName"), "price": ("price", "salePrice", "sellingPrice"), "currency": ("currency", "priceCurrency"), "sku": ("sku", "productId", "id"), "brand": ("brand", "vendor"), "availability": ("availability", "stock")}


class Refused(Exception):
    """Why a way gives no candidate."""


class Page(HTMLParser):
    """What the ways read of a page: scripts by kind, meta properties, the first heading, and elements that show a price with their surroundings."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[str, str, str]] = []
        self.meta: dict[str, str] = {}
        self.heading, self.title = "", ""
        self.priced: list[tuple[str | None, list[str], list[str]]] = []  # what an attribute states, own text, the parent's text
        self._open: list[tuple[str, list[str]]] = []
        self._script: tuple[str, str] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            self._script = (a.get("type", "").lower(), a.get("id", ""))
            self.scripts.append((*self._script, ""))
            return
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a.get("name"), a.get("content", ""))
        text: list[str] = []
        shows = a.get("itemprop") == "price" or "data-price" in a or "data-product-price" in a or any("price" in a.get(k, "").lower() for k in ("class", "id", "aria-label"))
        if shows and tag != "meta":
            self.priced.append((a.get("data-price") or a.get("data-product-price") or a.get("content") or a.get("aria-label") or None, text, self._open[-1][1] if self._open else []))
        if tag not in _VOID:
            self._open.append((tag, text))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self._script = None
        elif any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            kind, name, held = self.scripts[-1]
            self.scripts[-1] = (kind, name, held + data)
            return
        for tag, text in self._open:
            text.append(data)
            if tag == "h1" and not self.heading.endswith("\0"):
                self.heading += data
            if tag == "title":
                self.title += data

    def json_of(self, wanted: Callable[[str, str], bool]) -> Iterator[object]:
        for kind, name, text in self.scripts:
            if wanted(kind, name):
                try:
                    yield json.loads(text)
                except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser reads
                    continue


def _text(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("name")
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return None
    return str(value).strip() or None


def _one(found: list[dict], sku: str | None, what: str) -> dict | None:
    """The one of equal finds, or of those with the expected sku; none if there is nothing; refuses several."""
    distinct = list({json.dumps(f, sort_keys=True, ensure_ascii=False): f for f in found}.values())
    if sku is not None and len(distinct) > 1:
        distinct = [f for f in distinct if f.get("sku") == sku]
        if not distinct:
            raise Refused(f"no {what} is the expected one")
    if len(distinct) > 1:
        raise Refused(f"several {what}s")
    if distinct and sku is not None and distinct[0].get("sku") not in (None, sku):
        raise Refused(f"another {what} than expected")
    return distinct[0] if distinct else None


def jsonld(page: Page, sku: str | None, _: dict) -> dict | None:
    nodes = [n for block in page.json_of(lambda kind, _: kind == "application/ld+json") for n in _nodes(block)]
    named = {n["@id"]: n for n in nodes if isinstance(n.get("@id"), str) and len(n) > 1}
    whole = lambda n: named.get(n.get("@id"), n) if isinstance(n, dict) and set(n) == {"@id"} else n
    found = [n | {"sku": _text(n.get("sku"))} for n in nodes if _is(n, "Product") and len(n) > 1 and n.get("name")]
    product = _one(found, sku, "product")
    if product is None:
        return None
    stated = product.get("offers")
    offers = [o for o in map(whole, stated if isinstance(stated, list) else [stated]) if isinstance(o, dict)]
    single = [o | {"sku": _text(o.get("sku"))} for o in offers if not _is(o, "AggregateOffer")]
    if not single:
        raise Refused("an aggregate isn't for sale" if offers else "no offer")
    if len(single) > 1 and sku is not None:
        single = [o for o in single if o["sku"] == sku] or single
    if len(single) > 1:
        raise Refused("several offers")
    offer = single[0]
    if offer["sku"] is not None and (offer["sku"] not in (product["sku"] or offer["sku"], sku) if sku is not None else offer["sku"] != (product["sku"] or offer["sku"])):
        raise Refused("the offer is another product's")
    return {"name": _text(product.get("name")), "sku": product["sku"] or offer["sku"], "brand": _text(product.get("brand")), "price": _text(offer.get("price")), "currency": _text(offer.get("priceCurrency")), "availability": _text(offer.get("availability"))}


def _stated(node: dict, names: dict[str, tuple[str, ...]]) -> dict | None:
    """A product as an object of embedded JSON states it, if it has name and price."""
    out = {k: next((t for a in aliases if (t := _text(node.get(a))) is not None), None) for k, aliases in names.items()}
    return out if out.get("name") and out.get("price") else None


def _among(values: Iterator[object], names: dict[str, tuple[str, ...]], sku: str | None) -> dict | None:
    return _one([s for v in values for n in _nodes(v) if (s := _stated(n, names)) is not None], sku, "product")


def embedded_json(page: Page, sku: str | None, _: dict) -> dict | None:
    return _among(page.json_of(lambda kind, name: kind == "application/json" and name != "__NEXT_DATA__" and not name.startswith("ProductJson")), NAMES, sku)


def hydrated_state(page: Page, sku: str | None, _: dict) -> dict | None:
    """The state that a page starts from: a script of its own, or what an inline script sets, read as far as its brackets go."""
    values = [*page.json_of(lambda _, name: name == "__NEXT_DATA__")]
    for kind, _, text in page.scripts:
        for m in _STATE.finditer(text) if kind in ("", "text/javascript") else ():
            try:
                values.append(json.JSONDecoder().raw_decode(text, m.end())[0])
            except (ValueError, RecursionError):
                continue
    return _among(iter(values), NAMES, sku)


def storefront_data(page: Page, sku: str | None, _: dict) -> dict | None:
    """A hosted shop's product with its variants, whose prices are in hundredths."""
    found = []
    for product in page.json_of(lambda _, name: name.startswith("ProductJson")):
        for v in product.get("variants") or () if isinstance(product, dict) else ():
            if isinstance(v, dict) and isinstance(v.get("price"), int):
                stock = {True: "in stock", False: "out of stock"}.get(v.get("available"))
                found.append({"name": _text(product.get("title")), "sku": _text(v.get("sku")), "brand": _text(product.get("vendor")), "price": f"{v['price'] // 100}.{v['price'] % 100:02d}", "currency": page.meta.get("product:price:currency") or None, "availability": stock})
    return _one(found, sku, "variant")


def domain_adapter(page: Page, sku: str | None, adapter: dict) -> dict | None:
    """What a merchant's own names for the fields find in any of a page's JSON."""
    if not adapter:
        return None
    names = {k: tuple(v.split(",")) for k, v in adapter.items()}
    return _among(page.json_of(lambda kind, _: kind in ("application/json", "application/ld+json")), names, sku)


def meta(page: Page, sku: str | None, _: dict) -> dict | None:
    price = page.meta.get("product:price:amount") or page.meta.get("og:price:amount")
    if not price:
        return None
    return {"name": page.meta.get("og:title") or page.heading or page.title, "sku": page.meta.get("product:retailer_item_id") or None, "brand": page.meta.get("product:brand") or None, "price": price, "currency": page.meta.get("product:price:currency") or page.meta.get("og:price:currency") or None, "availability": page.meta.get("product:availability") or None}


def _money(raw: str) -> str | None:
    m = re.search(r"[0-9][0-9,.]*", raw)
    number = m[0].replace(",", "").rstrip(".") if m else ""
    return number if re.fullmatch(r"\d+(\.\d+)?", number) and float(number) > 0 else None


def _currency(raw: str) -> str | None:
    return next((code for sign, code in CURRENCIES.items() if sign in raw.upper()), None)


def visible_dom(page: Page, sku: str | None, _: dict) -> dict | None:
    """The one price that a page shows, with a currency stated beside it; several different ones may be accessories or instalments."""
    named = page.meta.get("product:price:currency") or page.meta.get("og:price:currency") or ""
    found = set()
    for stated, own, around in page.priced:
        raw = stated or "".join(own)
        price, currency = _money(raw), _currency(raw) or _currency("".join(around)) or _currency(named)
        if price and currency:
            found.add((currency, float(price), price))
    distinct = {(c, v) for c, v, _ in found}
    name = " ".join((page.heading or page.meta.get("og:title") or page.title).split())
    if len(distinct) > 1:
        raise Refused("several prices")
    if not distinct or len(name) < 3:
        return None
    currency, _, price = min(found)
    return {"name": name, "sku": None, "brand": page.meta.get("product:brand") or None, "price": price, "currency": currency, "availability": None}


WAYS: dict[str, Callable[[Page, str | None, dict], dict | None]] = {w.__name__: w for w in (jsonld, domain_adapter, embedded_json, storefront_data, hydrated_state, meta, visible_dom)}
_FIELDS = ("name", "sku", "brand", "price", "currency", "availability")


@udtf(returnType=CANDIDATE)
class PageCandidates:
    """html, expected sku or null, the host's own field names or null."""

    def eval(self, html: str, sku: str, adapter: dict) -> Iterator[tuple]:
        page = Page(html or "")
        for strategy, way in WAYS.items():
            refused, found = None, None
            try:
                found = way(page, sku, adapter or {})
            except Refused as e:
                refused = str(e)
            if found is not None and not found["price"]:
                found, refused = None, "no price"
            if found is not None or refused is not None:
                found = found or {}
                yield (strategy, *(found.get(f) for f in _FIELDS), refused)


def page_candidates(pages: DataFrame, adapters: DataFrame | None = None) -> DataFrame:
    """page_id and a row for each way that found a product or refused one: CANDIDATE, and the confidence of the way (null where it refused).

    pages: page_id, html, and if there are such columns expected_sku and host; adapters: host, names (a map from field to names, by commas).
    """
    rows = pages.select("page_id", "html", *[F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("expected_sku", "host")])
    if adapters is None:
        rows = rows.withColumn("names", F.lit(None).cast("map<string,string>"))
    else:
        rows = rows.join(adapters.select(F.col("host").alias("_host"), "names"), F.col("host") == F.col("_host"), "left").drop("_host")
    found = rows.lateralJoin(PageCandidates(F.col("html").outer(), F.col("expected_sku").outer(), F.col("names").outer()))
    sure = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(c)) for s, c in (STRATEGY_CONFIDENCE | {"visible_dom": VISIBLE_CONFIDENCE}).items()])
    return found.drop("html", "expected_sku", "host", "names").withColumn("confidence", F.when(F.col("refused").isNull(), sure))


def owned(candidates: DataFrame) -> DataFrame:
    """Adds owns: whether a candidate is of the first tier of its page that found one. A page's candidates are few, and looked at in one pass, since each pass reads the pages anew."""
    tier = F.when(F.col("refused").isNull(), F.coalesce(*[F.when(F.col("strategy").isin(*names), F.lit(i)) for i, names in enumerate(TIERS)]))
    marked = candidates.withColumn("_tier", tier)
    first = F.min("_tier").over(Window.partitionBy("page_id"))
    return marked.withColumn("owns", F.col("page_id").isNotNull() & F.coalesce(F.col("_tier") == first, F.lit(False))).drop("_tier")


def owner(candidates: DataFrame) -> DataFrame:
    """Of each page the candidates of the first tier that found one; the others don't price the page."""
    return owned(candidates).where("owns").drop("owns")
