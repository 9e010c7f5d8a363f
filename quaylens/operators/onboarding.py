"""Taking a source on: its products verified, its profile's gaps, its certificate, its first offers tried, the stage it has reached.

All evidence is aggregated for each source before it is joined; no source's products meet in one task. Products are counted by
variant first, so a source with a third of all products is spread over its variants.

Cases: a source without products has no valid ones and no share of them; one without a profile's fact has that gap; sources that
only other tables name don't count. Repeated products are repeated variants. Empty tables give an empty result. Text fields that
are null or empty are absent. Extra columns of the sources stay; extra columns of the products aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.operators import audit, coverage, gates

# The score from which the fast way is strong enough, and what a registry entry must and may say.
STRONG_STRATEGY = 85
VARIANT_FIELDS = ("sku", "capacity", "size", "concentration", "edition", "condition")
PRODUCT_FIELDS = ("source_product_id", "title", "price", "currency", "product_url")
REQUIRED_ENTRY = ("source_id", "name", "country", "market", "currency", "platform", "profile_version", "primary_strategy", "adapter", "enabled", "health_status")
ENTRY_DEFAULTS: dict[str, object] = {"platform": "unknown", "priority": 100, "freshness_ttl": 3600, "health_status": "HEALTHY", "enabled": False}
VERIFIED = ("critical_field_coverage", "price_validity", "variant_accuracy", "semantic_critical_issues", "pagination_passed")


def _there(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") != "", F.lit(False))


def _share(part: str, whole: str, empty: float) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(empty))


def variant_key() -> Column:
    """The parts of a product that tell its variant, in lower case; empty without any."""
    return F.lower(F.array_join(F.filter(F.array(*[F.col(c).cast("string") for c in VARIANT_FIELDS]), lambda v: v != ""), "|"))


def checked(products: DataFrame) -> DataFrame:
    """Adds variant_key, field_coverage, price_model and valid to products (PRODUCT_FIELDS, VARIANT_FIELDS, price_label, price_text)."""
    price = F.col("price").cast("double")
    paid = F.coalesce((price > 0) & ~F.isnan(price), F.lit(False))
    told = F.concat_ws(" ", F.coalesce("price_label", F.lit("")), F.coalesce("price_text", F.lit("")))
    rows = products.withColumns({"variant_key": variant_key(), "field_coverage": sum((_there(c).cast("int") for c in PRODUCT_FIELDS), F.lit(0)) / F.lit(float(len(PRODUCT_FIELDS))), "price_model": gates.price_kind(told), "_paid": paid, "_own": gates.is_product_price(told)})
    return rows.withColumn("valid", (F.col("field_coverage") == 1) & F.col("_paid") & F.col("_own")).drop("_paid", "_own")


def product_issues(products: DataFrame, by: str) -> DataFrame:
    """by, source_product_id and issue: what is wrong with each product, one row an issue; repeated variants are in `repeated_variants`."""
    price = F.col("price").cast("double")
    wrong = {
        "field-coverage": F.col("field_coverage") < 1,
        "invalid-price": ~F.coalesce((price > 0) & ~F.isnan(price), F.lit(False)),
        "semantic-price": F.col("price_model").isin("installment", "trade-in"),
        "missing-identity": F.col("variant_key") == "",
        "missing-price": (F.col("variant_key") != "") & F.col("price").isNull(),
    }
    return checked(products).select(by, "source_product_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]))).alias("issue"))


def repeated_variants(products: DataFrame, by: str) -> DataFrame:
    """by, variant_key and products: variants that a source has more than once."""
    return products.select(by, variant_key().alias("variant_key")).where("variant_key <> ''").groupBy(by, "variant_key").agg(F.count("*").alias("products")).where("products > 1")


def verify_products(products: DataFrame, by: str) -> DataFrame:
    """products, valid, price_validity, semantic_issues, variant_issues, variant_accuracy and verified of each source."""
    per_variant = checked(products).groupBy(by, "variant_key").agg(
        F.count("*").alias("n"),
        F.count_if("valid").alias("valid"),
        F.count_if(F.col("price_model").isin("installment", "trade-in")).alias("semantic"),
        F.count_if(F.col("price").isNull()).alias("priceless"),
    )
    # without a key each product is an issue; with one each repetition, and each that lacks a price
    issues = F.when(F.col("variant_key") == "", F.col("n")).otherwise(F.col("n") - 1 + F.col("priceless"))
    out = per_variant.groupBy(by).agg(F.sum("n").alias("products"), F.sum("valid").alias("valid"), F.sum("semantic").alias("semantic_issues"), F.sum(issues).alias("variant_issues"))
    accuracy = F.greatest(F.lit(0.0), (F.col("products") - F.col("variant_issues")) / F.col("products"))
    return out.withColumns({"price_validity": _share("valid", "products", 0.0), "variant_accuracy": accuracy, "verified": (F.col("valid") == F.col("products")) & (F.col("variant_issues") == 0)})


def probe_reasons() -> Column:
    """Why a profile (strategy_score, javascript, search, search_endpoints, variants, pagination) calls for a deep probe; empty if it doesn't."""
    no_endpoint = ~F.coalesce(F.size("search_endpoints") > 0, F.lit(False))
    reasons = {
        "no-strong-fast-strategy": ~F.coalesce(F.col("strategy_score") >= STRONG_STRATEGY, F.lit(False)),
        "javascript-required": F.col("javascript") == "required",
        "network-endpoint-unknown": no_endpoint & (F.col("search") == "discovered"),
        "variant-interaction-required": F.col("variants") == "interactive",
        "pagination-unknown": ~_there("pagination"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]))


def onboard(sources: DataFrame, products: DataFrame, offers: DataFrame, stages: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds probe_reasons, failed (checks of the certificate), stage and production_eligible to sources.

    sources: a profile (see `probe_reasons`) and the evidence of a certificate (see `audit.certify`), of which VERIFIED may be
    null: then the products say it. products: see `checked`. offers: the first of each source by `order` are tried. stages: by,
    stage, passed from end to end. A source stops at the first gate that it doesn't pass.
    """
    verified = verify_products(products, by).select(by, F.struct("products", "valid", "price_validity", "variant_accuracy", "semantic_issues").alias("_v"))
    share = F.coalesce("_v.price_validity", F.lit(0.0))
    found = {"critical_field_coverage": share, "price_validity": share, "variant_accuracy": F.coalesce("_v.variant_accuracy", F.lit(1.0)), "semantic_critical_issues": F.coalesce("_v.semantic_issues", F.lit(0)), "pagination_passed": F.lit(False)}
    rows = sources.join(verified, by, "left").withColumns({c: F.coalesce(c, found[c]) for c in VERIFIED})
    certified = audit.certify(rows.withColumn("probe_reasons", probe_reasons())).withColumnRenamed("passed", "_certified").drop("_v")
    tried = gates.canary(offers, by, order).select(by, F.col("passed").alias("_tried"))
    through = coverage.end_to_end(stages, by).select(by, F.col("passed").alias("_through"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stage = (
        F.when(F.size("probe_reasons") > 0, "DEEP_PROBE_REQUIRED")
        .when(~yes("_certified"), "VERIFICATION_FAILED")
        .when(~yes("_tried"), "CANARY_FAILED")
        .when(~yes("_through"), "E2E_FAILED")
        .otherwise("READY_FOR_REGISTRY")
    )
    out = certified.join(tried, by, "left").join(through, by, "left").withColumn("stage", stage)
    return out.withColumn("production_eligible", F.col("stage") == "READY_FOR_REGISTRY").drop("_certified", "_tried", "_through")


def registry_entries(sources: DataFrame) -> DataFrame:
    """Fills what a registry entry may leave out, and adds missing: what it must say and doesn't; such an entry isn't to be written."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in sources.columns else F.lit(v) for c, v in ENTRY_DEFAULTS.items()}
    out = sources.withColumns(filled)
    lacking = [F.when(~_there(c), F.lit(c)) if c in out.columns else F.lit(c) for c in REQUIRED_ENTRY]
    return out.withColumn("missing", F.array_compact(F.array(*lacking)))
