"""Gates that an offer passes on its way in and out: ingest, structure, exclusion, publication, identity, evidence of its parts.

All are column expressions over an offer's row; nothing here shuffles but where a gate counts rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.text import normalize_condition, plain_text
from quaylens.functions.urls import host
from quaylens.operators.evidence import PREPARED_COLUMNS, identity_verdict, prepared

# Bounds of an ingest batch, of a first limited ingest and of its sample, and how far ahead a clock may be.
INGEST_BATCH, LIMITED_BATCH, CANARY_SHARE, AHEAD_SECONDS = 500, 200, 0.99, 60
#: Fixed value: the merchant that no discovery source may show.
EXCLUDED_MERCHANT = "decathlon"
#: Fixed value: the market whose prices nobody has attested yet.
UNATTESTED_MARKETS = ("amazon-de",)
#: What a price's label says it is, in the order in which it is asked.
PRICE_KINDS = (
    ("installment", r"(?i)\bper\s*month\b|/\s*month\b|\bmonthly\b|\binstallments?\b|قسط|شهري"),
    ("trade-in", r"(?i)trade[- ]?in|استبدال"),
    ("member", r"(?i)\bmember|members?|عضو|أعضاء"),
    ("starting-from", r"(?i)\bstarting\s*(at|from)\b|\bfrom\b|ابتداء(ً|ا)?\s*من"),
    ("sale", r"(?i)sale|discount|offer|خصم|عرض"),
)
#: The names under which merchants give a field.
FIELD_ALIASES = {
    "sourceProductId": ("sourceProductId", "id", "productId"),
    "title": ("title", "name"),
    "price": ("price", "salePrice", "currentPrice"),
    "currency": ("currency", "priceCurrency"),
    "productUrl": ("productUrl", "url"),
    "brand": ("brand", "manufacturer"),
    "availability": ("availability", "stockStatus"),
    "imageUrl": ("imageUrl", "image", "thumbnail"),
}
CRITICAL_FIELDS = ("sourceProductId", "title", "price", "currency", "productUrl")
#: Countries of top-level domains and, where the domain says none, of currencies.
COUNTRY_OF_DOMAIN = {"sa": "SA", "ae": "AE", "uk": "GB", "de": "DE", "fr": "FR", "it": "IT", "es": "ES", "jp": "JP", "kr": "KR", "cn": "CN", "in": "IN", "sg": "SG", "au": "AU", "ca": "CA", "mx": "MX", "br": "BR", "eg": "EG", "za": "ZA", "nl": "NL", "pl": "PL", "ch": "CH", "at": "AT", "ie": "IE", "be": "BE"}
COUNTRY_OF_CURRENCY = {"SAR": "SA", "AED": "AE", "USD": "US", "GBP": "GB", "EUR": "EU", "JPY": "JP", "KRW": "KR", "CNY": "CN", "INR": "IN", "SGD": "SG", "AUD": "AU", "CAD": "CA"}
INFRASTRUCTURE_LABELS = ("app", "shop", "store", "mobile", "m", "web")
KNOWN_MERCHANTS = {"virginmegastore": "Virgin Megastore", "extra": "eXtra", "jarir": "Jarir"}


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def _seconds_ahead(observed: Column, now: str) -> Column:
    return (F.unix_micros(observed.cast("timestamp")) - F.unix_micros(F.lit(now).cast("timestamp"))) / F.lit(1e6)


def excluded_merchant(source_id: Column, name: Column, url: Column) -> Column:
    """True for the excluded merchant, by id, by name or by host (below any subdomain and domain)."""
    who = lambda c, gap: F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike(f"^{EXCLUDED_MERCHANT}($|{gap})")
    site = F.coalesce(host(F.lower(url)), F.lit("")).rlike(rf"(^|\.){EXCLUDED_MERCHANT}\.[a-z0-9-]+(\.[a-z0-9-]+)?$")
    return who(source_id, "-") | who(name, " ") | site


def structurally_valid() -> Column:
    """Whether an offer has a title, a positive price in riyal, a merchant of its own, an https address and a time."""
    price = F.col("product_price")
    fine = (price > 0) & ~F.isnan(price) & (price < float("inf")) & (F.col("currency") == "SAR")
    return _filled(F.col("title")) & F.coalesce(fine, F.lit(False)) & _filled(F.col("merchant")) & (F.col("merchant") != "App") & F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)) & F.col("observed_at").isNotNull()


def publishable(offers: DataFrame, market: str = "provider_market") -> DataFrame:
    """Offers whose market somebody has attested; by the market's name or the address's host."""
    named = F.lower(F.coalesce(F.col(market), F.lit(""))).isin(*UNATTESTED_MARKETS)
    hosts = [m.replace("-", r"\.") for m in UNATTESTED_MARKETS]
    sited = F.coalesce(host(F.lower(F.col("source_url"))), F.lit("")).rlike(rf"(^|\.)({'|'.join(hosts)})$")
    return offers.where(~(named | sited))


def coverage_after(offers: DataFrame, by: list[str]) -> DataFrame:
    """What a page may claim after the publication gate: offers and merchants that are really there."""
    return offers.groupBy(*by).agg(F.count("*").alias("returned_offers"), F.countDistinct(F.struct("provider", "merchant")).alias("returned_merchants"))


def ingest(offers: DataFrame, now: str, batch: list[str], order: list[str]) -> DataFrame:
    """The acceptable rows among the first 500 of each batch, in normal form: a title of three characters, an https address, a positive price, a time that isn't ahead of the clock.

    The limit is the contract of a request, which `batch` names; a table without one has no limit.
    """
    rows = offers
    if batch:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*batch).orderBy(*order))).where(F.col("_place") <= INGEST_BATCH).drop("_place")
    price, ahead = F.col("product_price"), _seconds_ahead(F.col("observed_at"), now)
    fine = (F.length(F.trim("title")) >= 3) & F.trim("source_url").rlike("(?i)^https://") & (price > 0) & ~F.isnan(price) & (price < float("inf")) & (ahead <= AHEAD_SECONDS)
    tidy = {c: F.trim(c) for c in ("title", "source_url", "merchant", "sku")} | {"currency": F.upper(F.trim("currency"))} | {c: F.lower(F.trim(c)) for c in ("condition", "availability")}
    return rows.where(fine).withColumns(tidy | {"data_kind": F.lit("ingested")})


def canary(offers: DataFrame, by: str, order: list[str], least: int = 1, most: int = LIMITED_BATCH) -> DataFrame:
    """For each source its first `most` offers: how many are valid, and whether 99 % are. A sample is what a canary is."""
    first = offers.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= most)
    valid = _filled(F.col("title")) & F.coalesce(F.col("product_price") > 0, F.lit(False)) & _filled(F.col("currency")) & _filled(F.col("source_url"))
    out = first.groupBy(by).agg(F.count("*").alias("sampled"), F.count_if(valid).alias("valid"))
    validity = F.col("valid") / F.col("sampled")
    return out.withColumn("validity", validity).withColumn("passed", (F.col("sampled") >= least) & (F.col("validity") >= CANARY_SHARE))


def limited_ingest(results: DataFrame, by: str) -> DataFrame:
    """attempted, saved, failed and passed of each source's first ingest. results: one row per offer tried, with `recorded` (null: it isn't)."""
    saved = F.coalesce("recorded", F.lit(False))
    out = results.groupBy(by).agg(F.count("*").alias("attempted"), F.count_if(saved).alias("saved"), F.count_if(~saved).alias("failed"))
    return out.withColumn("passed", (F.col("attempted") > 0) & (F.col("failed") == 0))


def condition_evidence(product: Column, offer: Column) -> tuple[Column, Column]:
    """The condition that a product and its one selected offer attest together, and who attests it."""
    declared = lambda c: F.coalesce(c != "", F.lit(False))
    p, o = normalize_condition(product), normalize_condition(offer)
    both, agree = declared(product) & declared(offer), (p == o) & (p != "unknown")
    condition = F.when(both, F.when(agree, p).otherwise("unknown")).when(declared(product), p).when(declared(offer), o).otherwise("unknown")
    evidence = (
        F.when(both, F.when(agree, "PRODUCT_AND_SELECTED_OFFER").otherwise("CONFLICTING_OR_UNVERIFIED"))
        .when(declared(product), F.when(p == "unknown", "UNVERIFIED").otherwise("PRODUCT"))
        .when(declared(offer), F.when(o == "unknown", "UNVERIFIED").otherwise("SELECTED_PRICED_OFFER"))
        .otherwise("ABSENT")
    )
    return condition, evidence


def price_kind(text: Column) -> Column:
    """installment, trade-in, member, starting-from, sale or regular, from a price's label and text."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in PRICE_KINDS], F.lit("regular"))


def is_product_price(text: Column) -> Column:
    return ~price_kind(text).isin("installment", "trade-in")


def map_fields(records: DataFrame, record: str) -> DataFrame:
    """A map column of names and values as canonical fields, by the first alias that has a value; with the share of critical fields that are there."""
    fields = {f: F.coalesce(*[F.try_element_at(F.col(record), F.lit(a)) for a in names]) for f, names in FIELD_ALIASES.items()}
    out = records.withColumns(fields)
    present = sum((F.when(F.coalesce(F.col(f) != "", F.lit(False)), 1).otherwise(0) for f in CRITICAL_FIELDS), F.lit(0))
    return out.withColumn("present", present).withColumn("coverage", F.col("present") / F.lit(float(len(CRITICAL_FIELDS))))


def display_value(key: str, value: Column) -> Column:
    """A specification's value as shown; null for placeholders, and for bare yes and no except where the field is a yes-or-no one."""
    v = F.trim(value)
    blank = (v == "") | v.rlike(r"(?i)^(n/?a|null|undefined|none|unknown|not available|-+)$")
    answer = F.when(v.rlike("(?i)^(yes|true)$"), "yes").otherwise("no")
    bare = v.rlike("(?i)^(yes|no|true|false)$")
    return F.when(v.isNull() | blank, F.lit(None)).when(bare, answer if key == "waterproof" else F.lit(None)).otherwise(v)


def merchant_key(provider: Column, merchant: Column, market: Column) -> Column:
    """A merchant's key: a hosted shop goes by its market first, any other by its name first."""
    hosted, other = F.coalesce(market, merchant, F.lit("unknown")), F.coalesce(merchant, market, F.lit("unknown"))
    return F.to_json(F.array(provider, F.when(provider == "shopify", hosted).otherwise(other)))


def merchant_name(url: Column) -> Column:
    """The merchant that a host's name says, without infrastructure labels before it."""
    site = host(F.lower(url))
    labels = F.split(site, r"\.")
    first = F.when((F.size(labels) >= 3) & labels[0].isin(*INFRASTRUCTURE_LABELS), labels[1]).otherwise(labels[0])
    known = [F.when(first == k, F.lit(v)) for k, v in KNOWN_MERCHANTS.items()]
    return F.coalesce(*known, F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2))))


def country_of(url: Column, currency: Column) -> Column:
    """The country of a host's top-level domain, else of the currency, else UN."""
    domain = F.regexp_extract(host(F.lower(url)), r"\.([a-z]+)$", 1)
    by_domain = [F.when(domain == d, F.lit(c)) for d, c in COUNTRY_OF_DOMAIN.items()]
    by_currency = [F.when(F.upper(currency) == m, F.lit(c)) for m, c in COUNTRY_OF_CURRENCY.items()]
    return F.coalesce(*by_domain, *by_currency, F.lit("UN"))


def buybox_parity(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Why a declared offer is or isn't the one in the observed buy box of its listing.

    declared: key, asin, seller, price, currency; observed: key, asin, seller, price, currency. One row per declared offer.
    """
    o = observed.select(F.col("key").alias("_k"), *[F.col(c).alias(f"seen_{c}") for c in ("asin", "seller", "price", "currency")])
    out = declared.join(o, F.col("key") == F.col("_k"), "left").drop("_k")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    asin = F.upper(F.coalesce("asin", F.lit("")))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5)
    reason = (
        F.when(~asin.rlike("^[A-Z0-9]{10}$"), "DECLARED_ASIN_MISSING")
        .when(~_filled(F.col("seller")) | ~F.coalesce(F.col("price") > 0, F.lit(False)) | ~same(F.col("currency"), F.lit("EUR")), "DECLARED_OFFER_INCOMPLETE")
        .when(~same(F.upper("seen_asin"), asin), "BUYBOX_ASIN_CONFLICT")
        .when(~same(F.trim("seen_seller"), F.trim("seller")), "BUYBOX_SELLER_CONFLICT")
        .when(~same(F.col("seen_currency"), F.lit("EUR")) | ~same(cents("seen_price"), cents("price")), "BUYBOX_PRICE_CONFLICT")
        .otherwise("SAME_OFFER_MATCH_NOT_ATTESTED")
    )
    return out.withColumn("reason", reason).withColumn("structural_match", F.col("reason") == "SAME_OFFER_MATCH_NOT_ATTESTED")


def shared_model_evidence(offers: DataFrame, by: list[str]) -> DataFrame:
    """Groups with two merchants or more whose offers all state one and the same model."""
    model = F.coalesce(F.trim("model_number"), F.lit(""))
    out = offers.groupBy(*by).agg(F.countDistinct("merchant").alias("merchants"), F.min(model).alias("_low"), F.max(model).alias("_high"))
    return out.withColumn("shared_model", (F.col("merchants") >= 2) & (F.col("_low") == F.col("_high")) & (F.col("_low") != "")).drop("_low", "_high")


def listing(candidates: DataFrame) -> DataFrame:
    """`candidates` prepared for pairs of listings: what `same_offer` reads of one side, once a candidate and not once a pair; site is null where the address isn't https or holds credentials."""
    url = F.col("source_url")
    site = F.concat(host(F.lower(url)), F.regexp_replace(F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1), "/+$", ""))
    out = prepared(candidates).withColumn("site", F.when(url.rlike("^https://[^/@]+(/|$)"), site))
    return out.withColumn("brand_plain", plain_text(F.col("brand")))


#: what `same_offer` needs of both sides
LISTING_COLUMNS = [*PREPARED_COLUMNS, "site", "brand_plain", "name_plain"]


def same_offer(pairs: DataFrame) -> DataFrame:
    """Adds same_offer to pairs of listings: one address (host and path), and identities that agree by an identifier or by the title.

    pairs: LISTING_COLUMNS of both sides, as `listing` makes them.
    """
    a, b = (lambda c: F.col(f"{c}_plain_a")), (lambda c: F.col(f"{c}_plain_b"))
    agrees = lambda c: F.coalesce((a(c) == b(c)) & (a(c) != ""), F.lit(False))
    differs = lambda c: F.coalesce((a(c) != b(c)) & (a(c) != "") & (b(c) != ""), F.lit(False))
    known = agrees("sku") | agrees("gtin") | agrees("model")
    conflict = differs("sku") | differs("gtin") | differs("model") | differs("brand")
    at_one = F.coalesce(F.col("site_a") == F.col("site_b"), F.lit(False))
    return identity_verdict(pairs).withColumn("same_offer", at_one & ~conflict & F.col("verdict").isin("same", "likely_same") & (known | agrees("name")))


def select_variant(offers: DataFrame, requests: DataFrame) -> DataFrame:
    """The one offer of each page whose address names the requested variant. A page with none, or with several, has no row.

    requests: page_id, url; offers: page_id, url and their own columns.
    """
    variant = lambda c: F.regexp_extract(c, r"[?&]variant=([^&#]*)", 1)
    place = lambda c: F.concat(host(F.lower(c)), F.regexp_replace(F.regexp_extract(c, r"^https://[^/?#]+([^?#]*)", 1), "/+$", ""))
    wanted = requests.select(F.col("page_id").alias("_p"), variant(F.col("url")).alias("variant_id"), place(F.col("url")).alias("_at")).where("variant_id <> ''")
    found = offers.join(wanted, F.col("page_id") == F.col("_p")).where((variant(F.col("url")) == F.col("variant_id")) & (place(F.col("url")) == F.col("_at")) & F.col("url").startswith("https://"))
    alone = F.count("*").over(Window.partitionBy("page_id"))
    return found.withColumn("_n", alone).where("_n = 1").drop("_n", "_p", "_at")


def european_issues(country: str, market_currency: str) -> Column:
    """What is wrong with the provenance of an offer of a European source; its columns are named by it (source_country, original_price, original_currency, fx_rate, fx_source, fx_observed_at, image)."""
    positive = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    rules = {
        "SOURCE_IDENTITY": ~F.coalesce((F.col("source_country") == F.col(country)) & (F.col("data_kind") == "live"), F.lit(False)),
        "TITLE_MISSING": ~F.coalesce(F.length(F.trim("title")) >= 3, F.lit(False)),
        "PRODUCT_URL_PROVENANCE": ~F.coalesce(F.col("source_url").rlike("^https://[^/@:]+(:443)?/"), F.lit(False)),
        "IMAGE_MISSING_OR_INVALID": ~F.coalesce(F.col("image").rlike("^https?://"), F.lit(False)),
        "SAR_PRICE_INVALID": ~(positive("product_price") & F.coalesce(F.col("currency") == "SAR", F.lit(False))),
        "ORIGINAL_PRICE_OR_CURRENCY_INVALID": ~(positive("original_price") & F.coalesce(F.col("original_currency") == F.col(market_currency), F.lit(False))),
        "FX_PROVENANCE_MISSING": ~(positive("fx_rate") & _filled(F.col("fx_source")) & F.col("fx_observed_at").isNotNull()),
        "UNSUPPORTED_SAUDI_DELIVERY_CLAIM": F.coalesce(F.col("can_ship_to_saudi"), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
