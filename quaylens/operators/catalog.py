"""Operators on the stored catalogue: recall, guarded reads, newest-wins writes, outbox and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.text import plain_text, tokens

FRESH_SECONDS, AHEAD_SECONDS = 45, 60


def reject_reason(now: str, seconds: float = FRESH_SECONDS):  # noqa: ANN201
    """Why a stored observation can't be shown at `now`: no time, from the future, stale; null if it can."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / F.lit(1e6)
    return F.when(F.col("observed_at").isNull(), "no_time").when(age < -AHEAD_SECONDS, "future").when(age > seconds, "stale")


def recall(offers: DataFrame, query: str, now: str, seconds: float, limit: int) -> DataFrame:
    """The first `limit` fresh offers whose title has all words of the query or contains it; their scores start anew."""
    wanted = [w for w in query.lower().split() if w]
    words = tokens(F.concat_ws(" ", "title", "brand"))
    hits = F.size(F.filter(words, lambda t: t.isin(wanted)))
    all_in = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), words)) == 0
    inside = plain_text(F.concat_ws(" ", "title", "brand")).contains(" ".join(wanted))
    rows = offers.where(reject_reason(now, seconds).isNull() & (all_in | inside)).withColumn("exact_match", F.lit(False)).withColumn("match_confidence", F.lit(0.0))
    return rows.withColumn("text_rank", hits / F.size(words)).orderBy(F.desc("text_rank"), F.desc("observed_at"), "offer_id").limit(limit)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The table after the incoming rows: of each key the newest; a stored row stays among equals."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("observed_at").desc_nulls_last(), "_side", "offer_id")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def guarded(hits: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Index hits with the canonical row's revision; lagging where the index is behind. Hits without a canonical row go."""
    c = canonical.select(F.col(key).alias("_k"), F.col("revision").alias("canonical_revision"))
    return hits.join(c, F.col(key) == F.col("_k")).drop("_k").withColumn("lagging", F.col("revision") < F.col("canonical_revision"))


def drain(outbox: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """What becomes of each outbox entry: published if it carries the current revision, else superseded."""
    c = canonical.select(F.col(key).alias("_k"), F.col("revision").alias("current"))
    return outbox.join(c, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("status", F.when(F.col("current").isNull(), "orphan").when(F.col("revision") == F.col("current"), "published").otherwise("superseded"))


def reconcile_index(canonical: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """What the index needs: repair where it lacks or lags a canonical row, prune where it has one too many."""
    c = canonical.select(F.col(key), F.col("revision").alias("rc"))
    i = index.select(F.col(key).alias("_k"), F.col("revision").alias("ri"))
    out = c.join(i, F.col(key) == F.col("_k"), "full")
    action = F.when(F.col("rc").isNull(), "prune").when(F.col("ri").isNull() | (F.col("ri") < F.col("rc")), "repair").otherwise("keep")
    return out.select(F.coalesce(key, "_k").alias(key), action.alias("action"))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after for every field that differs between two versions, rows on one side only included."""
    o = old.select(F.col(key), *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    n = new.select(F.col(key).alias("_k"), *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    both = o.join(n, F.col(key) == F.col("_k"), "full")
    rows = both.select(F.coalesce(key, "_k").alias(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"n_{f}").alias("after")) for f in fields])).alias("d"))
    return rows.select(key, "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


def hit_reason(now: str, seconds: float, name):  # noqa: ANN001, ANN201
    """Why an index hit can't be shown: malformed (no title or address), excluded (its merchant), or its time; null if it can."""
    from quaylens.operators.gates import excluded_merchant

    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    malformed = blank | (F.coalesce(F.trim("source_url"), F.lit("")) == "")
    return F.when(malformed, "malformed").when(excluded_merchant(F.lit(None).cast("string"), name, F.col("source_url")), "excluded").otherwise(reject_reason(now, seconds))


def read_by_key(canonical: DataFrame, keys: DataFrame, key: str, now: str, seconds: float) -> DataFrame:
    """The fresh canonical rows of a table of keys; a key that comes twice reads its rows once."""
    wanted = keys.select(F.col(key).alias("_k")).distinct()
    return canonical.where(reject_reason(now, seconds).isNull()).join(wanted, F.col(key) == F.col("_k"), "left_semi")


def index_writes(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What an index does with incoming documents, one per key: add, replace an older one, or skip."""
    return planned_writes(current, incoming, key).select(key, "action")


def planned_writes(current: DataFrame, incoming: DataFrame, key: str, of_old: list[str] = ()) -> DataFrame:
    """The incoming documents with their action, and with the columns `of_old` of the ones they meet."""
    c = current.select(F.col(key).alias("_k"), F.col("observed_at").alias("_t"), *of_old)
    action = F.when(F.col("_k").isNull(), "add").when(F.col("observed_at") > F.col("_t"), "replace").otherwise("skip")
    return incoming.join(c, F.col(key) == F.col("_k"), "left").withColumn("action", action).drop("_k", "_t")


def record(log: DataFrame, current: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The log with the incoming observations behind it, whatever they say, and the canonical table after them, the newest of each key."""
    return log.unionByName(incoming), upsert(current, incoming, key)
