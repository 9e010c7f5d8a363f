"""What a search has covered: failures by class, sources by state, routes, windows of recall, probes and walks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.operators.audit import SCORE_WEIGHTS

#: The classes of failures, in the order in which a message is asked for them.
STATUS_CLASSES = {403: "HTTP_403_ACCESS_DENIED", 404: "HTTP_404_RESOURCE_NOT_FOUND", 410: "HTTP_410_RESOURCE_GONE", 429: "HTTP_429_RATE_LIMITED"}
SERVER_FAILURE = "HTTP_5XX_SOURCE_FAILURE"
MESSAGE_CLASSES = (
    ("HTTP_403_ACCESS_DENIED", r"\b(access.denied|forbidden)\b"),
    ("HTTP_429_RATE_LIMITED", r"\b(rate.limit(ed)?|too.many.requests)\b"),
    ("HTTP_TIMEOUT", r"\b(timeout|timed.out|deadline.exceeded|etimedout)\b"),
    ("HTTP_ABORTED", r"\b(aborterror|aborted|abort_signal)\b"),
    ("PRODUCT_IDENTITY_MISMATCH", r"\b(identity.mismatch|variant.conflict|sku.mismatch)\b"),
    ("PRICE_EVIDENCE_INCOMPLETE", r"\b(price.missing|price.not.found|price.evidence)\b"),
    ("EXTRACTION_FAILURE", r"\b(json.parse|parse.error|invalid.json|extraction.failed)\b"),
    ("HTTP_200_JS_SHELL", r"\b(js.shell|javascript.shell)\b"),
    ("HTTP_200_EMPTY_CATALOG", r"\b(empty.catalog|no.candidates)\b"),
    ("HTTP_200_BLOCK_PAGE", r"\b(block.page|challenge.page)\b"),
    ("HTTP_REDIRECT_CHANGED", r"\b(redirect.changed|cross.origin.redirect)\b"),
    ("SOURCE_TRANSPORT_FAILURE", r"\b(dns|econnreset|enotfound|fetch.failed|network.error|socket.hang.up)\b"),
)
#: What a source's fit to a query counts for, and the neighbours of the Gulf.
ROUTE_POINTS = {"brand": 120, "category": 65, "adjacent": 24, "broad": 32, "saudi": 8, "gulf": 5, "elsewhere": 2, "general": 8, "local_general": 24, "unknown_broad": 30, "unknown_other": 12}
GULF = ("AE", "KW", "QA", "BH", "OM")
#: Offset and length of the windows of each depth, for the catalogue and for the index.
CATALOG_WINDOWS, INDEX_WINDOWS = ((0, 120), (120, 380), (500, 500)), ((80, 420), (500, 500))
#: The cases that a source's search must stand, and the share of repeats that it may show.
SEARCH_CASES, MOST_REPEATS = ("broad-brand", "popular-product", "exact-model", "exact-sku", "zero-result"), 0.05
#: The stages that a source passes end to end.
E2E_STAGES = ("profile", "adapter", "ingestion", "normalization", "validation", "database", "productResolution", "search", "api", "frontend")


def failure_class(status: Column, message: Column) -> Column:
    """The class of a failure: by its status, by a status that the message names as one, by the message's words; else UNKNOWN."""
    named = F.regexp_extract(F.lower(message), r"(?:^|[\s(:])(?:http(?:\s+status)?|status(?:code)?)\s*[:= ]\s*(403|404|410|429|5[0-9][0-9])\b", 1)
    code = F.coalesce(status, F.when(named != "", named.cast("int")))
    by_status = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in STATUS_CLASSES.items()], F.when(code.between(500, 599), F.lit(SERVER_FAILURE)))
    return F.coalesce(by_status, *[F.when(F.lower(message).rlike(p), F.lit(c)) for c, p in MESSAGE_CLASSES], F.lit("UNKNOWN"))


def failure_events(failures: DataFrame) -> DataFrame:
    """source_id, failure_class, events. failures: source_id, status, message."""
    return failures.groupBy("source_id", failure_class(F.col("status"), F.col("message")).alias("failure_class")).agg(F.count("*").alias("events"))


def failure_totals(matrix: DataFrame, core: list[str]) -> DataFrame:
    """One row: events in all, classified and not, sources, and how many of these are core and optional ones."""
    is_core = F.col("source_id").isin(*core)
    return matrix.agg(
        F.sum("events").alias("events"),
        F.coalesce(F.sum(F.when(F.col("failure_class") != "UNKNOWN", F.col("events"))), F.lit(0)).alias("classified"),
        F.countDistinct("source_id").alias("sources"),
        F.countDistinct(F.when(is_core, F.col("source_id"))).alias("core_sources"),
        F.countDistinct(F.when(~is_core, F.col("source_id"))).alias("optional_sources"),
    )


def source_summary(registry: DataFrame) -> DataFrame:
    """One row: sources by status, countries and regions. registry: source_id, status, country, region."""
    by = lambda s: F.count_if(F.col("status") == s)
    return registry.agg(F.count("*").alias("sources"), by("configured").alias("configured"), by("disabled").alias("disabled"), by("candidate").alias("candidate"), F.countDistinct("country").alias("countries"), F.countDistinct("region").alias("regions"))


def registry(static: DataFrame, adapters: DataFrame, configured: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The static sources with their adapters, configured where the adapter is; and dynamic sources that aren't among them.

    static: source_id, country, region; adapters: source_id, adapter; configured: adapter; dynamic: source_id, country, region.
    """
    on = configured.select(F.col("adapter").alias("_a")).distinct()
    known = static.join(adapters, "source_id", "left").join(on, F.col("adapter") == F.col("_a"), "left")
    status = F.when(F.col("_a").isNotNull(), "configured").when(F.col("adapter").isNotNull(), "disabled").otherwise("candidate")
    fixed = known.select("source_id", "country", "region", "adapter", status.alias("status"))
    more = dynamic.join(static.select("source_id"), "source_id", "left_anti").select("source_id", "country", "region", F.lit("dynamic").alias("adapter"), F.lit("configured").alias("status"))
    return fixed.unionByName(more)


def wave_evidence(reports: DataFrame, by: list[str]) -> DataFrame:
    """What connectors reported in a wave. reports: returned_offers, ok (null: outcome unknown)."""
    n = F.greatest(F.coalesce("returned_offers", F.lit(0)), F.lit(0))
    return reports.groupBy(*by).agg(F.count("*").alias("reports"), F.count_if(n > 0).alias("with_offers"), F.sum(n).alias("reported_offers"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("no_success"), F.count_if(F.col("ok").isNull()).alias("unknown"))


def audit_state(offers: Column, candidates: Column, failures: Column) -> Column:
    return F.when(offers > 0, "LIVE_VERIFIED").when((candidates > 0) & (failures >= candidates), "BLOCKED_OR_RESOLUTION_FAILED").when(candidates > 0, "CONNECTED_NO_VERIFIED_PRICE").otherwise("CONNECTED_NO_CANDIDATES")


def coverage_status(deadline: Column, pending: Column, reported: Column, core: Column, optional: Column) -> Column:
    """What to tell the shopper about a search's coverage, as a key of the texts."""
    return (
        F.when(deadline, "deadline")
        .when(pending > 0, "pending")
        .when(reported == 0, "complete")
        .when((core > 0) & (optional > 0), "partial_core_and_optional")
        .when(core > 0, "partial_core")
        .when(optional > 0, "partial_optional")
        .otherwise("partial")
    )


def recoverable(failures: DataFrame, by: str, core: list[str]) -> DataFrame:
    """Searches of which a core source failed in passing while none of the core sources denied access."""
    mine = failures.where(F.col("source_id").isin(*core))
    denied = F.col("failure_class").isin("HTTP_403_ACCESS_DENIED", "HTTP_429_RATE_LIMITED")
    passing = F.col("failure_class").isin("HTTP_TIMEOUT", "HTTP_ABORTED", "SOURCE_TRANSPORT_FAILURE", SERVER_FAILURE)
    return mine.groupBy(by).agg((F.bool_or(passing) & ~F.bool_or(denied)).alias("recoverable"))


def recall_evidence(hits: DataFrame, by: list[str], reason: Column) -> DataFrame:
    """How many hits of a recall were fetched, taken, and turned away for what. reason: null for hits to take."""
    marked = hits.withColumn("_why", F.coalesce(reason, F.lit("accepted")))
    count = lambda *names: F.count_if(F.col("_why").isin(*names))
    return marked.groupBy(*by).agg(F.count("*").alias("fetched"), count("accepted").alias("accepted"), count("stale", "future", "no_time").alias("rejected_stale"), count("excluded").alias("rejected_excluded"), count("malformed").alias("rejected_malformed"))


def windowed(hits: DataFrame, by: list[str], order: list[Column], windows: tuple[tuple[int, int], ...]) -> DataFrame:
    """The hits within the windows of a recall plan, with the depth of each. Spark keeps a task's first rows only, since the last window's end is a limit."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    depth = F.coalesce(*[F.when((F.col("_i") > at) & (F.col("_i") <= at + n), F.lit(d)) for d, (at, n) in enumerate(windows)])
    first = hits.withColumn("_i", i).where(F.col("_i") <= max(at + n for at, n in windows))
    return first.withColumn("depth", depth).where("depth is not null").drop("_i")


def catalog_text(html: Column) -> dict[str, Column]:
    """Range, total, page size and price range that the text of a listing page states."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")
    part = lambda p, g=1: F.regexp_extract(text, p, g)
    number = lambda c: F.when(c != "", F.regexp_replace(c, ",", "").try_cast("long"))
    span = r"(?i)\b(\d+)\s*-\s*(\d+)\s+of\s+(\d+)\s+products?\b"
    start, end = number(part(span, 1)), number(part(span, 2))
    total = F.coalesce(number(part(span, 3)), number(part(r"(?i)\b(\d+)\s+products?\s+Sort\b")))
    size = F.coalesce(number(part(r"(?i)Item\s+per\s+page\s+(\d+)")), end - start + 1)
    prices = r"(?i)(\d[\d,]*)\s*SAR\s*-\s*(\d[\d,]*)\s*SAR"
    return {"total": total, "current_start": start, "current_end": end, "page_size": size, "price_min": number(part(prices, 1)), "price_max": number(part(prices, 2)), "has_more": F.coalesce(end < total, F.lit(False)), "passed": F.coalesce((total > 0) & (total >= F.coalesce(end, F.lit(0))), F.lit(False))}


def route(stores: DataFrame, query: Column, category: Column, neighbours: DataFrame, adjustment: Column) -> DataFrame:
    """Stores in the order in which to ask them for a query, with score and place; stores that don't fit have no row.

    stores: query_id, store_id, country, categories, brands, general, and what the columns `query`, `category` (null: unknown)
    and `adjustment` (of reliability, at most 20 either way) say. neighbours: category, near. A named brand comes first, then
    the category's own stores, then the general ones at home, then the score.
    """
    p = ROUTE_POINTS
    marked = stores.withColumn("_category", F.coalesce(category, F.lit("other")))
    near = neighbours.groupBy(F.col("category").alias("_n")).agg(F.collect_set("near").alias("_near"))  # a few per category
    marked = marked.join(near, F.col("_category") == F.col("_n"), "left")
    brand = F.exists("brands", lambda b: F.concat(F.lit(" "), query, F.lit(" ")).contains(F.concat(F.lit(" "), b, F.lit(" "))))
    exact, broad = F.array_contains("categories", F.col("_category")), F.array_contains("categories", "*")
    adjacent = ~exact & F.coalesce(F.arrays_overlap("categories", "_near"), F.lit(False))
    home = F.col("country") == "SA"
    unknown = (F.col("_category") == "other") & ~brand
    when = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = when(brand, p["brand"]) + when(exact, p["category"]) + when(adjacent, p["adjacent"]) + when(broad, p["broad"])
    score = score + F.when(home, p["saudi"]).when(F.col("country").isin(*GULF), p["gulf"]).otherwise(p["elsewhere"])
    score = score + when(F.col("general"), p["general"]) + when(F.col("general") & home, p["local_general"])
    score = score + when(unknown & broad, p["unknown_broad"]) + when(unknown & ~broad & F.array_contains("categories", "other"), p["unknown_other"])
    fits = F.when(category.isNotNull(), exact | broad | brand | adjacent).otherwise(broad | brand | F.array_contains("categories", "other"))
    out = marked.withColumns({"score": score + F.greatest(F.lit(-20), F.least(F.lit(20), adjustment)), "_brand": brand, "_exact": exact, "_home": F.col("general") & home}).where(fits & (F.col("score") > 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("_brand"), F.desc("_exact"), F.desc("_home"), F.desc("score"), "store_id")
    return out.withColumn("place", F.row_number().over(order)).drop("_category", "_n", "_near", "_brand", "_exact", "_home")


def search_runs(runs: DataFrame, by: str) -> DataFrame:
    """Whether a source's search stands all five cases: results where there should be some, none where none, few repeats. runs: case_type, result_count, duplicate_rate."""
    fine = F.when(F.col("case_type") == "zero-result", F.col("result_count") == 0).otherwise(F.col("result_count") > 0) & (F.col("duplicate_rate") <= MOST_REPEATS)
    good = F.count_distinct(F.when(fine & F.col("case_type").isin(*SEARCH_CASES), F.col("case_type")))
    return runs.groupBy(by).agg(F.sum("result_count").alias("results"), good.alias("cases_passed")).withColumn("passed", F.col("cases_passed") == len(SEARCH_CASES))


def end_to_end(stages: DataFrame, by: str) -> DataFrame:
    """The stages that a source hasn't passed yet. stages: stage, passed."""
    done = stages.where("passed").groupBy(by).agg(F.collect_set("stage").alias("_done"))
    all_of = stages.select(by).distinct().join(done, by, "left")
    missing = F.array_except(F.array(*[F.lit(s) for s in E2E_STAGES]), F.coalesce("_done", F.array().cast("array<string>")))
    return all_of.select(by, F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("passed"))


def rank_probes(metrics: DataFrame, by: str) -> DataFrame:
    """The strategies of each source by score (seven weighted shares, out of 100), and whether its best calls for a deep probe (below 85)."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    raw = sum((clamp(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    out = metrics.withColumn("score", F.floor(raw * 10000 + 0.5) / 100)
    w = Window.partitionBy(by)
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "strategy"))).withColumn("deep_probe", F.max("score").over(w) < 85)


def differential(candidates: DataFrame, by: str, fields: tuple[str, ...] = ("price", "currency", "sku", "availability")) -> DataFrame:
    """Where the strategies of a product disagree with its base, the first by `turn`: base and other strategy, field, values."""
    base = candidates.groupBy(by).agg(F.min(F.struct("turn", "strategy", *fields)).alias("_b"))
    joined = candidates.join(base, by).where(F.col("turn") > F.col("_b.turn"))
    text = lambda c: c.cast("string")
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(F.col(f"_b.{f}")).alias("left_value"), text(F.col(f)).alias("right_value")) for f in fields]))
    rows = joined.select(by, F.col("_b.strategy").alias("left_strategy"), F.col("strategy").alias("right_strategy"), found.alias("d"))
    return rows.select(by, "left_strategy", "right_strategy", "d.*").where("left_value <> right_value")


def walk(spark: SparkSession, links: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """Follows next links from each start over at most `most` pages: start, pages, last, termination (natural-end, cycle, max-pages).

    links: page, next (at most one per page). Each step is one join; all starts go in step.
    """
    now = starts.select(F.col("page").alias("start"), F.col("page").alias("last"), F.array("page").alias("seen"), F.lit(None).cast("string").alias("termination"))
    step = links.select(F.col("page").alias("_page"), F.col("next").alias("_next"))
    for _ in range(most - 1):
        met = now.join(step, F.col("last") == F.col("_page"), "left")
        ended = F.col("termination").isNotNull()
        again = F.array_contains("seen", F.col("_next"))
        state = F.when(ended, F.col("termination")).when(F.col("_next").isNull(), "natural-end").when(again, "cycle")
        goes = ~ended & F.col("_next").isNotNull() & ~F.coalesce(again, F.lit(False))
        now = met.select("start", F.when(goes, F.col("_next")).otherwise(F.col("last")).alias("last"), F.when(goes, F.array_append("seen", F.col("_next"))).otherwise(F.col("seen")).alias("seen"), state.alias("termination"))
    met = now.join(step, F.col("last") == F.col("_page"), "left")
    final = F.coalesce("termination", F.when(F.col("_next").isNull(), "natural-end").when(F.array_contains("seen", F.col("_next")), "cycle").otherwise("max-pages"))
    return met.select("start", F.size("seen").alias("pages"), "last", final.alias("termination"))


def sitemap_urls(sitemaps: DataFrame, most: int = 50_000) -> DataFrame:
    """merchant_host, complete, reason and urls of sitemap texts (merchant_host, xml): https addresses of the host itself, each once.

    A text that declares a document type or entities isn't trusted; an index of sitemaps isn't a catalogue; more than `most`
    entries make it incomplete, as the format's own limit says.
    """
    xml = F.coalesce("xml", F.lit(""))
    entries = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?url(?:\s[^>]*)?>(.*?)</(?:\w+:)?url\s*>"), F.lit(1))
    reason = (
        F.when(xml.rlike(r"(?i)<!DOCTYPE\b|<!ENTITY\b") | ~F.col("merchant_host").rlike(r"^[a-z0-9.-]+\.[a-z]+$"), "INVALID_OR_UNTRUSTED_SITEMAP")
        .when(xml.rlike(r"(?i)<(?:\w+:)?sitemapindex\b"), "SITEMAP_INDEX_REQUIRES_CHILDREN")
        .when(~xml.rlike(r"(?i)<(?:\w+:)?urlset(?:\s|>)"), "NOT_A_URL_SITEMAP")
        .when(F.size(entries) > most, "SITEMAP_LIMIT_EXCEEDED")
        .otherwise("SITEMAP_URLSET_PARSED")
    )
    found = F.transform(entries, lambda e: F.regexp_replace(F.replace(F.trim(F.regexp_extract(e, r"(?is)<(?:\w+:)?loc\s*>(.*?)</(?:\w+:)?loc\s*>", 1)), F.lit("&amp;"), F.lit("&")), "#.*$", ""))
    own = F.filter(found, lambda u: F.regexp_extract(F.lower(u), r"^https://([^/@:?]+)(?::443)?(?:/|\?|$)", 1) == F.col("merchant_host"))
    out = sitemaps.withColumn("reason", reason).withColumn("complete", F.col("reason") == "SITEMAP_URLSET_PARSED")
    return out.withColumn("urls", F.when(F.col("complete"), F.array_distinct(own)).otherwise(F.array().cast("array<string>"))).drop("xml")


#: How many sources the first and the second wave ask; the third asks the rest.
WAVES = (16, 12)


def acquisition_waves(stores: DataFrame) -> DataFrame:
    """The wave in which each ranked store of a query is asked. stores: query_id, place."""
    first, second = WAVES[0], WAVES[0] + WAVES[1]
    return stores.withColumn("wave", F.when(F.col("place") <= first, 0).when(F.col("place") <= second, 1).otherwise(2))


def arabic_plural(n: Column) -> Column:
    """The plural class of a number in Arabic: zero, one, two, few, many or other."""
    rest = n % 100
    return F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(rest.between(3, 10), "few").when(rest.between(11, 99), "many").otherwise("other")


def counted_label(n: Column, one: str, two: str, few: str, many: str, other: str) -> Column:
    """A number with its noun: alone for one and two, else the number before the form of its class."""
    kind = arabic_plural(n)
    with_number = lambda form: F.concat(n.cast("string"), F.lit(f" {form}"))
    return F.when(kind == "one", one).when(kind == "two", two).when(kind.isin("few", "zero"), with_number(few)).when(kind == "many", with_number(many)).otherwise(with_number(other))


def profile_versions(stored: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The profiles after a new inspection: a version more where a field differs, version 1 where there was none, else as stored."""
    s = stored.select(F.col(key).alias("_k"), F.col("version").alias("_v"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = found.select(key, *fields).join(s, F.col(key) == F.col("_k"), "full")
    changed = F.greatest(F.lit(False), *[~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    gone, new = F.col(key).isNull(), F.col("_k").isNull()
    version = F.when(new, 1).when(gone | ~changed, F.col("_v")).otherwise(F.col("_v") + 1)
    return both.select(F.coalesce(key, "_k").alias(key), *[F.when(gone, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], version.cast("int").alias("version"))


def ranking_metrics(ranked: DataFrame, by: str, relevant: int = 3, depth: int = 10) -> DataFrame:
    """Mean reciprocal rank's term and price regret of each query: one over the place of the first fully relevant row, and how much dearer than the cheapest relevant row it is. ranked: place, grade, price."""
    hit = F.col("grade") >= relevant
    first = F.min(F.when(hit & (F.col("place") <= depth), F.struct("place", "price")))
    out = ranked.groupBy(by).agg(first.alias("_f"), F.min(F.when(hit, F.col("price"))).alias("_low"))
    return out.select(by, F.coalesce(1.0 / F.col("_f.place"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("_f.price") - F.col("_low")).alias("regret"))


#: What a market's prices are in.
MARKET_CURRENCY = {"KSA": "SAR", "SA": "SAR", "UAE": "AED", "AE": "AED", "KW": "KWD", "QA": "QAR", "BH": "BHD", "OM": "OMR"}


def market_issues(market: Column, currency: Column, host: Column) -> Column:
    """What is wrong with the market that a source states: market-missing, currency-missing, currency-market-mismatch, host-market-mismatch."""
    m, c = F.upper(F.coalesce(market, F.lit(""))), F.upper(F.coalesce(currency, F.lit("")))
    expected = F.coalesce(*[F.when(m == k, F.lit(v)) for k, v in MARKET_CURRENCY.items()])
    hint = F.when(host.rlike(r"(?i)\.sa$"), "KSA").when(host.rlike(r"(?i)\.ae$"), "UAE")
    return F.array_compact(F.array(F.when(m == "", "market-missing"), F.when(c == "", "currency-missing"), F.when((c != "") & (expected != c), "currency-market-mismatch"), F.when((m != "") & (hint != m), "host-market-mismatch")))


def absent_from_sitemap(indexed: DataFrame, observed: DataFrame, url: str, complete: bool, most: int = 10_000) -> DataFrame:
    """Indexed addresses that a source's complete sitemap lacks, to be looked at anew: nothing is removed, and nothing follows for a price.

    A source whose sitemap wasn't read whole, or that has more than `most` entries on either side, says nothing. Both: source_id and the address.
    """
    if not complete:
        return indexed.limit(0).select("source_id", url, F.lit("").alias("status"))
    count = lambda df: df.groupBy("source_id").agg(F.count("*").alias("n"))
    sound = count(observed).where(F.col("n") <= most).join(count(indexed).where(F.col("n") <= most), "source_id", "left_semi").select("source_id")
    asked = indexed.where(F.col(url).isNotNull()).join(sound, "source_id", "left_semi")
    return asked.join(observed.select("source_id", url).distinct(), ["source_id", url], "left_anti").select("source_id", url, F.lit("reverify").alias("status"))
