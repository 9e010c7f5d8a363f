"""Addresses of merchants: safe product addresses, what an address says of its product, whether it still leads there, and
retail variants that differ by a suffix.

Nothing is fetched here: the answers to requests are a table, written by whoever may ask the merchant.

Cases: a null, empty or malformed address is INVALID_URL or no variant, never an error. Repeated links are followed each; of
repeated answers to one address the least (by its fields) counts. Empty tables give empty results; extra columns of the links stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers by their status.
REDIRECTS = (301, 302, 303, 307, 308)
RETRYABLE = (408, 429, 500, 502, 503, 504)
HEAD_REFUSED = (403, 405, 501)
GONE = (404, 410)
MOST_REDIRECTS = 5

ANSWERS = "address string, head_status int, head_location string, get_status int, get_location string"


def _absolute(address: Column, base: Column) -> Column:
    """An address as a link on the page `base` is read: with a scheme, without one, from the root, or beside the page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    beside = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(base, r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), address)
        .when(address.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), address))
        .when(address.startswith("/"), F.concat(root, address))
        .otherwise(F.concat(beside, address))
    )


def store_address(raw: Column, hosts: tuple[str, ...], base: Column | None = None) -> Column:
    """A merchant's address in one form: https, one of its hosts, no credentials or other port, no hidden slash or line break; without fragment. Null for any other."""
    given = F.trim(raw)
    full = _absolute(given, base if base is not None else F.lit(f"https://{hosts[-1]}"))
    host = F.lower(F.regexp_extract(full, r"^(?i)https://([^/?#@:\\\\]+)(?::443)?(?:[/?#]|$)", 1))
    rest = F.regexp_extract(full, r"^(?i)https://[^/?#]+([^#]*)", 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    fine = host.isin(*[h.lower() for h in hosts]) & ~raw.rlike(r"[\r\n]") & ~path.rlike("(?i)%2f")
    return F.when((given != "") & fine, F.concat(F.lit("https://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def names_sku(address: Column, sku: Column) -> Column:
    """Whether an address's path names the SKU right behind a segment `p`: a hint, no proof of the page's product."""
    segments = F.filter(F.split(F.regexp_extract(address, r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.lower(F.try_url_decode(s)))
    place = F.array_position(plain, F.lower(sku))
    before = F.try_element_at(plain, (place - 1).cast("int"))
    named = sku.rlike("^[A-Za-z0-9_-]{4,64}$") & ~F.exists(plain, lambda s: s.isNull()) & (place > 1)
    return F.coalesce(F.when(named, before == "p"), F.lit(False))


def link_health(links: DataFrame, answers: DataFrame, hosts: tuple[str, ...], redirects: int = 3) -> DataFrame:
    """Adds link_status and final_url to links (address, sku): where each leads by the recorded answers (see ANSWERS), followed for at most `redirects` (5 at most).

    Each redirect is one equi-join with the answers, both sides by address: short texts that many rows share look small to the planner, so
    the answers are never sent whole to each task. A settled link goes where its address does, so that none gather under null. Every address on the way must be the merchant's and name the SKU. GET counts where HEAD is refused.
    """
    most = max(0, min(MOST_REDIRECTS, redirects))
    status = F.when(F.col("head_status").isin(*HEAD_REFUSED), F.struct(F.col("get_status").alias("code"), F.col("get_location").alias("location"))).otherwise(F.struct(F.col("head_status").alias("code"), F.col("head_location").alias("location")))
    known = answers.where("address is not null").groupBy(F.col("address").alias("_at")).agg(F.min(F.struct("head_status", "head_location", "get_status", "get_location")).alias("_a")).select("_at", "_a.*").select("_at", status.alias("_got"))
    rows = links.withColumns({"_now": store_address(F.col("address"), hosts), "_seen": F.array().cast("array<string>")})
    rows = rows.withColumn("link_status", F.when(F.col("_now").isNull(), "INVALID_URL"))
    for hop in range(most + 1):
        now, code = F.col("_now"), F.col("_got.code")
        rows = rows.withColumns({"_open": F.when(F.col("link_status").isNull(), now), "_by": F.coalesce(now, F.xxhash64(*links.columns).cast("string"))})
        rows = rows.join(known.hint("merge"), F.col("_by") == F.col("_at"), "left")
        target = store_address(F.col("_got.location"), hosts, now)
        moved = code.isin(*REDIRECTS)
        settled = (
            F.when(F.array_contains("_seen", now), "REDIRECT_LOOP")
            .when(~names_sku(now, F.col("sku")), "SKU_HINT_MISMATCH")
            .when(code.isNull(), "RETRYABLE_ERROR")
            .when(moved & target.isNull(), "UNSAFE_REDIRECT")
            .when(moved, F.lit("REDIRECT_LIMIT") if hop == most else F.lit(None))
            .when(code == 200, "OK")
            .when(code.isin(*GONE), "NOT_FOUND")
            .when(code.isin(*RETRYABLE), "RETRYABLE_ERROR")
            .otherwise("REJECTED")
        )
        rows = rows.withColumns(
            {
                "link_status": F.when(F.col("_open").isNull(), F.col("link_status")).otherwise(settled),
                "_seen": F.when(F.col("_open").isNull(), F.col("_seen")).otherwise(F.concat("_seen", F.array("_now"))),
                "_now": F.when(F.col("_open").isNotNull() & moved & settled.isNull(), target).otherwise(now),
            }
        ).drop("_open", "_by", "_at", "_got")
    return rows.withColumn("final_url", F.when(F.col("link_status") == "OK", F.col("_now"))).drop("_now", "_seen")


def first_healthy(products: DataFrame, answers: DataFrame, hosts: tuple[str, ...], key: str, addresses: list[str], redirects: int = 3) -> DataFrame:
    """key and resolved_url: the first of a product's addresses (columns, in order) that leads to it; null if none does, or without a sku.

    Addresses of one product are a bounded few, so a product's result is one aggregate over them.
    """
    tried = F.array_distinct(F.filter(F.array(*addresses), lambda a: F.trim(a) != ""))
    links = products.select(key, "sku", F.posexplode_outer(tried).alias("_place", "address"))
    out = link_health(links, answers, hosts, redirects)
    return out.groupBy(key).agg(F.min(F.when(F.col("link_status") == "OK", F.struct("_place", "final_url"))).getField("final_url").alias("resolved_url"))


@dataclass(frozen=True)
class VariantLine:
    """A model that is sold as retail variants which differ by one suffix, each on a page of its own at one merchant.

    An unknown suffix is never taken for the model without one.
    """

    brand: str
    model: str
    #: the model without its separators, as letters and a number
    parts: tuple[str, str]
    suffixes: tuple[str, ...]
    host: str
    #: the path before the suffix and behind it
    path: tuple[str, str]
    #: suffixes known to be others
    others: tuple[str, ...] = ("bk", "evo", "pro", r"mk\s*\d+")

    @property
    def _suffix(self) -> str:
        return "|".join(map(re.escape, self.suffixes))

    def page_variant(self, address: Column) -> Column:
        """The variant whose page an address is (BASE without suffix); null for other addresses."""
        whole = rf"(?i)^https://{re.escape(self.host)}(?::443)?{re.escape(self.path[0])}(?:_({self._suffix}))?{re.escape(self.path[1])}(?:[?#].*)?$"
        suffix = F.upper(F.regexp_extract(address, whole, 1))
        return F.when(address.rlike(whole), F.when(suffix == "", "BASE").otherwise(suffix))

    def title_variant(self, title: Column) -> Column:
        """The variant that a title names and nothing else; null for any further word."""
        plain = F.trim(F.regexp_replace(title, "[_–—]", " "))
        whole = rf"(?i)^{re.escape(self.brand)}\s+{self.parts[0]}[\s-]*{self.parts[1]}(?:[\s-]*({self._suffix}))?$"
        suffix = F.upper(F.regexp_extract(plain, whole, 1))
        return F.when(plain.rlike(whole), F.when(suffix == "", "BASE").otherwise(suffix))

    def variant(self, title: Column, address: Column) -> Column:
        """The variant that title and address agree on; null otherwise."""
        page = self.page_variant(address)
        return F.when(page == self.title_variant(title), page)

    def identity(self, title: Column, address: Column) -> Column:
        """The hash of merchant, brand, model and path of the variant that both agree on."""
        v = self.variant(title, address)
        model = F.lower(F.concat(F.lit(self.model), F.when(v == "BASE", "").otherwise(F.concat(F.lit(" "), v))))
        path = F.lower(F.regexp_extract(address, "^(?i)https://[^/?#]+([^?#]*)", 1))
        merchant = re.sub(r"^www\.", "", self.host)
        return F.when(v.isNotNull(), F.sha2(F.concat_ws("|", F.lit(merchant), F.lit(self.brand.lower()), model, path), 256))

    def asked(self, query: str) -> str | None:
        """The variant that a query asks for: BASE, a suffix, UNSUPPORTED for another, None if it doesn't name the model."""
        plain = re.sub("[_–—]", " ", query).strip()
        found = re.search(rf"\b{self.parts[0]}[\s_-]*{self.parts[1]}(?:[\s_-]*({self._suffix}))?(?=$|[^a-z0-9])", plain, re.IGNORECASE)
        if not found:
            return None
        if re.match(rf"\s*(?:{'|'.join(self.others)})\b", plain[found.end() :], re.IGNORECASE):
            return "UNSUPPORTED"
        return (found[1] or "base").upper()

    def fits(self, query: str, title: Column, address: Column) -> Column:
        """Whether an offer may answer a query: one that names a variant takes that variant's own page and title only."""
        return self.fitting(query, self.page_variant(address), self.variant(title, address))

    def fitting(self, query: str, page: Column, here: Column) -> Column:
        """`fits`, of an offer's page variant and of the variant that title and address agree on."""
        asked = self.asked(query)
        if asked == "UNSUPPORTED":
            return F.lit(False)
        on_page = here.isNotNull() if asked is None else F.coalesce(here == asked, F.lit(False))
        return F.when(page.isNull(), F.lit(asked is None)).otherwise(on_page)

    def parity(self, cards: DataFrame, pages: DataFrame, currency: str = "EUR") -> DataFrame:
        """Adds page_variant, variant and parity to search cards (title, source_url, price, currency): whether the product's page, joined by source_url, says the same; else why not.

        Of several pages of one address the least by its fields counts; a card without a page has a conflict of identity.
        """
        cents = lambda c: F.when(c > 0, F.floor(c * 100 + 0.5).cast("long"))
        page = F.struct(F.col("title").alias("title"), F.col("price").alias("price"), F.col("currency").alias("currency"))
        told = pages.where("source_url is not null").groupBy(F.col("source_url").alias("_url")).agg(F.min(page).alias("_page"))
        rows = cards.join(told, F.col("source_url") == F.col("_url"), "left")
        # card and page have one address, so their identities are equal where their variants are; one step a projection, so that nothing is worked out twice
        rows = rows.withColumns({"page_variant": self.page_variant(F.col("source_url")), "_title": self.title_variant(F.col("title")), "_told": self.title_variant(F.col("_page.title"))})
        rows = rows.withColumn("variant", F.when(F.col("page_variant") == F.col("_title"), F.col("page_variant")))
        euros = F.coalesce((F.col("currency") == currency) & (F.col("_page.currency") == currency), F.lit(False))
        a, b = cents(F.col("price")), cents(F.col("_page.price"))
        reason = (
            F.when(~F.coalesce(F.col("variant") == F.col("_told"), F.lit(False)), "VARIANT_IDENTITY_CONFLICT")
            .when(~euros, "CURRENCY_CONFLICT")
            .when(a.isNull() | b.isNull(), "PRICE_NOT_OBSERVED")
            .when(a != b, "SEARCH_PDP_PRICE_CONFLICT")
            .otherwise("PDP_PARITY_CONFIRMED")
        )
        return rows.withColumn("parity", reason).drop("_url", "_page", "_title", "_told")
