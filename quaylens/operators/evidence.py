"""Operators on extraction candidates: freshness, preference, conflicts, identity, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.text import distinct_similarity, plain_text, token_similarity, tokens

# How far each way of extraction is trusted, in general and by field.
GENERAL = {"jsonld": 1.0, "domain_adapter": 0.99, "embedded_json": 0.97, "storefront_data": 0.96, "hydrated_state": 0.94, "meta": 0.75}
BY_FIELD = {
    "price": {"domain_adapter": 1.12, "storefront_data": 1.08, "embedded_json": 1.04, "jsonld": 1.0, "hydrated_state": 0.98, "meta": 0.72},
    "name": {"jsonld": 1.08, "domain_adapter": 1.05, "embedded_json": 1.02, "storefront_data": 1.0, "hydrated_state": 0.97, "meta": 0.72},
}
FIELD_TABLE = {"price": "price", "availability": "price", "name": "name", "identity": "name"}
FRESH_HOURS, STALE_HOURS = 6, 48


def age_seconds(observed: Column, now: str) -> Column:
    """At least 0; null for an unknown time."""
    at = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))
    return F.greatest(F.lit(0.0), at / F.lit(1e6)) + F.when(observed.isNull(), F.lit(None)).otherwise(0.0)


def freshness(observed: Column, now: str) -> tuple[Column, Column]:
    """Weight and status: 1 up to six hours, then falling from 0.85 to 0.3 until 48 hours, 0.2 beyond; 0.5 if unknown."""
    age, fresh, stale = age_seconds(observed, now), FRESH_HOURS * 3600.0, STALE_HOURS * 3600.0
    fading = F.floor((0.85 - (age - fresh) / (stale - fresh) * 0.55) * 1000 + 0.5) / 1000
    weight = F.when(age.isNull(), 0.5).when(age > stale, 0.2).when(age > fresh, fading).otherwise(1.0)
    status = F.when(age.isNull(), "unknown").when(age > stale, "stale").when(age > fresh, "aging").otherwise("fresh")
    return weight, status


def trust(field: str, now: str) -> Column:
    """Confidence times the weight of the strategy for the field times freshness."""
    table = BY_FIELD.get(FIELD_TABLE.get(field, ""), {})
    weight = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(table.get(s, w))) for s, w in GENERAL.items()], F.lit(0.8))
    fresh, _ = freshness(F.col("observed_at"), now)
    volatile = field in ("price", "availability")
    return F.coalesce("confidence", F.lit(0.0)) * weight * ((0.75 + fresh * 0.25) if volatile else (0.9 + fresh * 0.1))


def preferred(candidates: DataFrame, field: str, now: str) -> DataFrame:
    """The most trusted candidate of each product that has the field."""
    w = Window.partitionBy("product_id").orderBy(F.desc("trust"), "candidate_id")
    return candidates.where(F.col(field).isNotNull()).withColumn("trust", trust(field, now)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reconcile(candidates: DataFrame, fields: list[str], now: str) -> DataFrame:
    """For each product and field the value of the most trusted candidate, and which it was. One pass: each field's best is an aggregate."""
    best = [F.max_by(F.struct(F.col(f).cast("string").alias("value"), "candidate_id"), F.when(F.col(f).isNotNull(), F.struct(trust(f, now), F.col("candidate_id")))).alias(f) for f in fields]
    wide = candidates.groupBy("product_id").agg(*best)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["value"].alias("value"), F.col(f)["candidate_id"].alias("candidate_id")) for f in fields]))
    return wide.select("product_id", rows.alias("r")).select("product_id", "r.*").where("value is not null")


def pairs(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Each two candidates of a product, once: what the result is made of. A product has few candidates; the join is on the product, and a product with many is split by AQE."""
    a = candidates.select("product_id", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = candidates.select(F.col("product_id").alias("_p"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, (F.col("product_id") == F.col("_p")) & (F.col("candidate_id_a") < F.col("candidate_id_b"))).drop("_p")


def prepared(candidates: DataFrame) -> DataFrame:
    """`candidates` with the words of their names and the plain forms of their identifiers, once a candidate and not once a pair."""
    words = F.array_distinct(tokens(F.col("name")))
    plain = {f"{c}_plain": plain_text(F.col(c)) for c in ("name", "gtin", "sku", "model") if c in candidates.columns}
    return candidates.withColumns({"words": words, "long_words": F.filter(words, lambda t: F.length(t) > 1), **plain})


def conflicts(candidates: DataFrame) -> DataFrame:
    """Where two candidates of a product disagree: prices of one currency by 3 % or more, availabilities, names with less than 0.45 in common."""
    p = pairs(prepared(candidates), ["candidate_id", "price", "currency", "availability", "words"])
    one_currency = F.col("currency_a") == F.col("currency_b")
    gap = F.abs(F.col("price_a") - F.col("price_b")) / F.greatest(F.abs("price_a"), F.abs("price_b"), F.lit(1.0))
    # one step a projection, so that nothing is worked out twice; equal names have everything in common unless they have no word
    alike = (F.col("words_a") == F.col("words_b")) & (F.size("words_a") > 0)
    p = p.withColumns({"_gap": F.when(one_currency, gap), "_stock": one_currency & (F.col("availability_a") != F.col("availability_b")), "_shared": F.when(~alike, distinct_similarity(F.col("words_a"), F.col("words_b")))})
    p = p.where("_gap >= 0.03 or _stock or _shared < 0.45")
    price = F.when(F.col("_gap") >= 0.03, F.struct(F.lit("price").alias("field"), F.when(F.col("_gap") >= 0.15, "high").otherwise("medium").alias("severity"), F.col("_gap").alias("measure")))
    stock = F.when(F.col("_stock"), F.struct(F.lit("availability").alias("field"), F.lit("medium").alias("severity"), F.lit(1.0).alias("measure")))
    name = F.when(F.col("_shared") < 0.45, F.struct(F.lit("name").alias("field"), F.when(F.col("_shared") < 0.2, "high").otherwise("medium").alias("severity"), F.col("_shared").alias("measure")))
    return p.select("product_id", "candidate_id_a", "candidate_id_b", F.explode(F.array(price, stock, name)).alias("c")).where("c is not null").select("product_id", "candidate_id_a", "candidate_id_b", "c.*")


#: what `identity_verdict` needs of both sides
IDENTITY_COLUMNS = ["gtin", "sku", "model", "brand", "name"]
PREPARED_COLUMNS = ["candidate_id", "gtin_plain", "sku_plain", "model_plain", "brand", "long_words"]


def identity_verdict(p: DataFrame) -> DataFrame:
    """Adds score and verdict to pairs with gtin, sku, model, brand and name on both sides, or with these `prepared`."""

    def plain(c: str, side: str) -> Column:
        return F.col(f"{c}_plain_{side}") if f"{c}_plain_{side}" in p.columns else plain_text(F.col(f"{c}_{side}"))

    def evidence(c: str, weight: float) -> Column:
        a, b = plain(c, "a"), plain(c, "b")
        return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, weight).otherwise(-weight)

    def longer(side: str) -> Column:
        return F.col(f"long_words_{side}") if f"long_words_{side}" in p.columns else F.filter(tokens(F.col(f"name_{side}")), lambda t: F.length(t) > 1)

    alike = distinct_similarity if {"long_words_a", "long_words_b"} <= set(p.columns) else token_similarity
    shared = F.when(longer("a").isNotNull() & longer("b").isNotNull(), alike(longer("a"), longer("b")))
    out = p.withColumns({"_g": evidence("gtin", 0.45), "_s": evidence("sku", 0.35), "_m": evidence("model", 0.22), "_t": shared})
    out = out.withColumn("_b", F.when(F.col("brand_a") == F.col("brand_b"), 0.12).when(F.col("brand_a") != F.col("brand_b"), -0.22).otherwise(0.0))
    title = F.when(F.col("_t") >= 0.75, 0.16).when(F.col("_t") >= 0.45, 0.06).when(F.col("_t") < 0.2, -0.28).otherwise(0.0)
    raw = F.floor((F.lit(0.5) + F.col("_g") + F.col("_s") + F.col("_m") + F.col("_b") + title) * 1000 + 0.5) / 1000
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    same_title = F.coalesce(F.col("_t") >= 0.75, F.lit(False))
    no_match = ~((F.col("_g") > 0) | (F.col("_s") > 0) | (F.col("_m") > 0) | (F.col("_b") > 0) | same_title)
    strong = (F.col("_g") < 0) | ((F.col("_s") < 0) & no_match) | ((F.col("_m") < 0) & (F.col("_b") < 0))
    likely = (F.col("score") >= 0.58) | ((F.col("_b") > 0) & same_title & (F.col("_m") >= 0))
    verdict = F.when(strong | (F.col("score") < 0.3), "different").when((F.col("score") >= 0.78) | (F.col("_g") > 0) | (F.col("_s") > 0), "same").when(likely, "likely_same").otherwise("uncertain")
    return out.withColumn("verdict", verdict).drop("_g", "_s", "_m", "_b", "_t")


def identity_cluster(candidates: DataFrame) -> DataFrame:
    """Each candidate against its product's anchor, the most confident one; rejected if the verdict is that they differ."""
    raw = ["candidate_id", *IDENTITY_COLUMNS]
    anchor = candidates.groupBy("product_id").agg(F.min(F.struct(-F.coalesce("confidence", F.lit(0.0)), *raw)).alias("x")).select("product_id", *[F.col("x")[c].alias(c) for c in raw])
    a = prepared(anchor).select(F.col("product_id").alias("_p"), *[F.col(c).alias(f"{c}_a") for c in PREPARED_COLUMNS])
    b = prepared(candidates).select("product_id", *[F.col(c).alias(f"{c}_b") for c in PREPARED_COLUMNS])
    joined = b.join(a, (F.col("product_id") == F.col("_p")) & (F.col("candidate_id_a") != F.col("candidate_id_b"))).drop("_p")
    return identity_verdict(joined).withColumn("accepted", F.col("verdict") != "different")


def compare_expected(observed: DataFrame, fields: list[str]) -> DataFrame:
    """REJECT if a field contradicts expected_<field>, INSUFFICIENT if one is missing, else CANDIDATE; with the fields concerned."""
    wrong = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & F.col(f"expected_{f}").isNotNull() & (F.col(f) != F.col(f"expected_{f}")), f) for f in fields]))
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull() & F.col(f"expected_{f}").isNotNull(), f) for f in fields]))
    out = observed.withColumn("_w", wrong).withColumn("_n", absent)
    verdict = F.when(F.size("_w") > 0, "REJECT").when(F.size("_n") > 0, "INSUFFICIENT").otherwise("CANDIDATE")
    return out.withColumn("verdict", verdict).withColumn("fields", F.array_join(F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.col("_n")), ",")).drop("_w", "_n")


def enrich_with(base: DataFrame, found: DataFrame, key: str, price: str) -> DataFrame:
    """Takes a found price where one exists within half to twice the known one (or where none is known); otherwise keeps the row as it is."""
    f = found.select(F.col(key).alias("_k"), F.col("found_price"))
    out = base.join(f, F.col(key) == F.col("_k"), "left").drop("_k")
    fine = F.col("found_price").isNotNull() & (F.col(price).isNull() | F.col("found_price").between(F.col(price) * 0.5, F.col(price) * 2))
    return out.withColumn("admitted", fine).withColumn("final_price", F.when(fine, F.col("found_price")).otherwise(F.col(price)))


#: How sure each way of extraction is of a product that it found.
STRATEGY_CONFIDENCE = {"jsonld": 0.99, "embedded_json": 0.94, "hydrated_state": 0.9, "storefront_data": 0.92, "domain_adapter": 0.96, "meta": 0.72}


def extraction_candidates(found: DataFrame) -> DataFrame:
    """What six ways of extraction found, as candidates with the confidence of the way; unknown ways give none."""
    sure = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(c)) for s, c in STRATEGY_CONFIDENCE.items()])
    return found.withColumn("confidence", sure).where("confidence is not null")


def resolve(candidates: DataFrame, rates: DataFrame, now: str) -> DataFrame:
    """One offer of each product: the price, currency and availability of the candidate most trusted for a price, other fields reconciled, the price in riyal. A currency without a rate gives no offer."""
    from quaylens.functions.money import to_riyal

    priced = preferred(candidates, "price", now).select("product_id", "candidate_id", "strategy", "price", "currency", "availability")
    fields = reconcile(candidates, ["name", "brand"], now).groupBy("product_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("name", "brand")])
    return to_riyal(priced.join(fields, "product_id", "left"), rates, "price").where("price_sar is not null")


#: How many seconds older or newer than an offer its evidence may be.
EVIDENCE_BEFORE, EVIDENCE_AHEAD = 300, 60


def newest_in_time(offers: DataFrame, evidence: DataFrame, key: str, at: str, before: int = EVIDENCE_BEFORE, ahead: int = EVIDENCE_AHEAD) -> DataFrame:
    """`offers` with `found`: the newest evidence of their key, at most `before` seconds older and `ahead` seconds newer, both edges included; null without one.

    evidence: key, found_at, evidence_id and whatever else. Time is cut into buckets as wide as the window; a row of evidence is in
    its own and in the next, an offer looks in the bucket of its window's end. Within a key and bucket all rows go in order of time, so
    nothing is paired that isn't in the result, and a key with very many rows is many buckets. Equal times go to the largest evidence_id.
    """
    width = F.lit((before + ahead) * 1_000_000)
    fields = [c for c in evidence.columns if c != key]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    end = micros(at) + F.lit(ahead * 1_000_000)
    asked = offers.where(known).select(F.col(key).alias("_key"), F.floor(end / width).alias("_bucket"), end.alias("_time"), F.lit(1).alias("_side"), F.struct(*offers.columns).alias("_offer"))
    told = evidence.where(F.col(key).isNotNull() & F.col("found_at").isNotNull()).select(F.col(key).alias("_key"), micros("found_at").alias("_time"), F.lit(0).alias("_side"), F.struct(*fields).alias("_found"))
    own = F.floor(F.col("_time") / width)
    told = told.withColumn("_bucket", F.explode(F.array(own, own + 1)))
    so_far = Window.partitionBy("_key", "_bucket").orderBy("_time", "_side", F.col("_found.evidence_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("_last", F.last("_found", ignorenulls=True).over(so_far)).where("_side = 1")
    inside = F.unix_micros(F.col("_last.found_at").cast("timestamp")) >= F.col("_time") - width
    found = both.select("_offer.*", F.when(inside, F.col("_last")).alias("found"))
    return found.unionByName(offers.where(~known).withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))


def admit_evidence(joined: DataFrame, key: str, price: str) -> DataFrame:
    """Adds `reason` (admitted, or why not) and final_price: the evidence's price where it is admitted, else the offer's own.

    joined: an offer's sku, brand and model beside `found` with those, price and currency. What either side doesn't state is no conflict, but for a
    missing price. A price beyond half to twice the known one needs a review.
    """
    f = lambda c: F.col(f"found.{c}")
    differs = lambda c: F.coalesce(plain_text(F.col(c)) != plain_text(f(c)), F.lit(False))
    fair = F.col(price) > 0
    reason = (
        F.when(F.col("found").isNull(), "no_evidence")
        .when(~f("sku").eqNullSafe(F.col(key)) & f("sku").isNotNull(), "sku_mismatch")
        .when(f("price").isNull() | F.isnan(f("price")) | ~(f("price") > 0) | ~f("currency").eqNullSafe("SAR"), "price_invalid")
        .when(differs("brand") | differs("model"), "variant_conflict")
        .when(~F.coalesce(fair, F.lit(False)) | (f("price") < F.col(price) * 0.5) | (f("price") > F.col(price) * 2), "price_review")
        .otherwise("admitted")
    )
    out = joined.withColumn("reason", reason)
    return out.withColumn("final_price", F.when(F.col("reason") == "admitted", f("price")).otherwise(F.col(price)))
