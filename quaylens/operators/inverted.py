"""An inverted index of offers as tables: postings by term, counts by term, the documents, and what later writes replaced.

    commits/segment=S                one row for each write that is complete: how many documents it added
    docs/segment=S/bucket=B          the documents of a write with the digest of their text, by a hash of that digest
    dead/segment=S                   documents of earlier segments that no longer count, with the text they had
    postings/segment=S/bucket=B      term, tier, text, tf, length, n (documents of the text); by a hash of the term, sorted by term and tier
    stats/segment=S/bucket=B         term, tier, df (negative for replaced documents), impact (the largest tf / length)

A write changes no file of an earlier one; it counts once its commit is there, so a job that dies halfway leaves the index as it
was. Documents that say the same share their postings: a text is split into words once, however many documents have it. A query
reads the buckets of its terms, then the documents of the texts that have them. Documents of about one length are a tier; the counts say what a document of a
tier can reach at best, so tiers are read from the most promising on, until the next can't bring anything among the first k.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylens.functions.text import tokens
from quaylens.operators.catalog import planned_writes, reject_reason


def words_of(query: str) -> list[str]:
    """A query's distinct words in the form that `tokens` gives a text's."""
    return sorted(set("".join(c if c.isalnum() else " " for c in query.lower()).split()))


#: what the index notes on its documents
_OWN = ("_text", "_was")


def digest(said: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(said))


def tier(length: Column) -> Column:
    """The length itself below 16, then one tier for each doubling."""
    return F.when(length < 16, length).otherwise(F.length(F.bin(length.cast("long"))) + 11).cast("int")


@dataclass
class OfferIndex:
    """The index in the folder `path`. key: the column that names a document; text: the columns whose words are indexed. Rows have observed_at."""

    spark: SparkSession
    path: str
    key: str = "offer_id"
    text: tuple[str, ...] = ("title", "brand")
    buckets: int = 64

    def __post_init__(self) -> None:
        self._known = self.commits()

    # reading

    def commits(self) -> dict[int, int]:
        """Complete segments, and how many documents each added."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/commits").collect()  # a row for each write
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return {r.segment: r.added for r in rows}

    def _table(self, name: str) -> DataFrame:
        """The rows of a table in complete segments."""
        paths = [f"{self.path}/{name}/segment={s}" for s in sorted(self._known)]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _alive(self, rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Those of the documents that no later write replaced. texts: the only ones that the rows have (a column _text)."""
        if len(self._known) < 2:
            return rows
        dead = self._table("dead")
        if texts is not None:
            dead = dead.join(texts.select("_text"), "_text", "left_semi")
        dead = dead.select(F.col("doc").alias("_doc"), F.col("segment").alias("_since"))
        return rows.join(dead, (F.col(self.key) == F.col("_doc")) & (F.col("segment") < F.col("_since")), "left_anti")

    def documents(self) -> DataFrame:
        """The documents as they are now."""
        return self._alive(self._table("docs")).drop(*_OWN)

    def postings(self, terms: list[str], tiers: list[int] | None = None) -> DataFrame:
        """The postings of these terms; partitions of other buckets aren't listed, row groups of other terms and tiers aren't read."""
        rows = self._table("postings").where(F.col("bucket").isin(self._buckets_of(terms)) & F.col("term").isin(terms))
        return rows if tiers is None else rows.where(F.col("tier").isin(tiers))

    def _buckets_of(self, values: list[str]) -> list[int]:
        return sorted({zlib.crc32(v.encode()) % self.buckets for v in values})

    def stats(self, terms: list[str]) -> dict[str, dict[int, tuple[int, float]]]:
        """For each term and tier the number of documents and the largest share of a document's words."""
        rows = self._table("stats").where(F.col("bucket").isin(self._buckets_of(terms)) & F.col("term").isin(terms))
        out: dict[str, dict[int, tuple[int, float]]] = {t: {} for t in terms}
        for r in rows.groupBy("term", "tier").agg(F.sum("df").alias("df"), F.max("impact").alias("impact")).where("df > 0").collect():  # terms x tiers
            out[r.term][r.tier] = (r.df, r.impact)
        return out

    # writing

    def _bucket(self, value: Column) -> Column:
        return (F.crc32(value.cast("string").cast("binary")) % self.buckets).cast("int")

    def _said(self) -> Column:
        return F.concat_ws(" ", *self.text)

    def _postings_of(self, docs: DataFrame) -> DataFrame:
        """term, tier, text, tf, length, n of the documents' texts."""
        rows = docs.groupBy(self._said().alias("said")).agg(F.count("*").alias("n"))
        rows = rows.select(digest(F.col("said")).alias("_text"), "n", tokens(F.col("said")).alias("words")).withColumn("length", F.size("words"))
        rows = rows.select("_text", "n", "length", F.explode("words").alias("term"))
        counted = rows.groupBy("_text", "n", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        return counted.withColumn("tier", tier(F.col("length"))).withColumn("bucket", self._bucket(F.col("term")))

    def _write(self, rows: DataFrame, name: str, segment: int, order: list[str]) -> DataFrame:
        """Rows by bucket; AQE splits a bucket that is large."""
        path = f"{self.path}/{name}/segment={segment}"
        return self._stored(rows.hint("rebalance", "bucket"), path, order)

    def _stored(self, rows: DataFrame, path: str, order: list[str]) -> DataFrame:
        rows.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _current(self) -> DataFrame:
        """Key, time and text of the documents as they are now: of each key the last segment's."""
        rows = self._table("docs").select(self.key, "observed_at", "_text", "segment")
        if len(self._known) > 1:
            later = Window.partitionBy(self.key).orderBy(F.desc("segment"))
            rows = rows.withColumn("_after", F.lag(F.lit(1)).over(later)).where("_after is null").drop("_after")
        return rows.drop("segment")

    def write(self, incoming: DataFrame) -> int:
        """Takes in new documents and newer observations of known ones, and skips the rest. Gives the number of the segment."""
        known = self._known = self.commits()
        segment = max(known, default=-1) + 1
        newest = Window.partitionBy(self.key).orderBy(F.col("observed_at").desc_nulls_last(), *self.text)
        # a row without one before it is its key's newest; told this way, rows are sorted once, behind the shuffle
        rows = incoming.where(F.col(self.key).isNotNull()).withColumn("_before", F.lag(F.lit(1)).over(newest)).where("_before is null").drop("_before")
        if known:
            rows = planned_writes(self._current(), rows, self.key, ["_text"]).where("action <> 'skip'").withColumnRenamed("_text", "_was")
        else:
            rows = rows.withColumns({"_was": F.lit(None).cast("binary"), "action": F.lit("add")})
        rows = rows.withColumn("_text", digest(self._said()))
        # as they come, by key: each task writes a file to each bucket, so that they aren't shuffled twice
        docs = self._stored(rows.withColumn("bucket", self._bucket(F.hex("_text"))), f"{self.path}/docs/segment={segment}", ["_text", self.key])
        replaced = docs.where("action = 'replace'").select(F.col(self.key).cast("string").alias("doc"), F.col("_was").alias("_text"))
        replaced.write.mode("overwrite").parquet(f"{self.path}/dead/segment={segment}")
        postings = self._write(self._postings_of(docs), "postings", segment, ["term", "tier", "_text"])
        stats = postings.select("term", "tier", "bucket", F.col("n").alias("more"), (F.col("tf") / F.col("length")).alias("share"))
        if known:
            gone = replaced.groupBy("_text").agg(F.count("*").alias("gone"))
            of = self._table("postings").select("_text", "term", "tier", "bucket").distinct()
            stats = stats.unionByName(of.join(gone, "_text").select("term", "tier", "bucket", (-F.col("gone")).alias("more"), F.lit(0.0).alias("share")))
        self._write(stats.groupBy("term", "tier", "bucket").agg(F.sum("more").alias("df"), F.max("share").alias("impact")), "stats", segment, ["term", "tier"])
        added = docs.where("action = 'add'").agg(F.count("*").alias("added"))
        added.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/segment={segment}")
        self._known = self.commits()
        return segment

    # searching

    def search(self, query: str, now: str, seconds: float, limit: int) -> DataFrame:
        """The first `limit` fresh documents that have all words of the query: by the words' share of theirs, weighted by how rare a word is, then the newest, then by key.

        Adds text_rank and place; exact_match and match_confidence start anew. limit bounds what passes through the driver.
        """
        terms, stats = words_of(query), {}
        self._known = self.commits()
        if not self._known:
            raise ValueError(f"there is no index in {self.path}")
        total = sum(self._known.values())
        if terms and total:
            stats = self.stats(terms)
        weights = {t: math.floor(1000 * math.log(1 + total / n)) for t, of in stats.items() if (n := sum(df for df, _ in of.values()))}
        found: list[tuple] = []
        if stats and len(weights) == len(terms):
            shared = set.intersection(*[set(of) for of in stats.values()])
            at_best = {k: sum(weights[t] * stats[t][k][1] for t in terms) * (1 + 1e-9) for k in shared}
            waiting = sorted(shared, key=lambda k: (-at_best[k], k))
            while waiting and not (len(found) >= limit and found[limit - 1][1] > at_best[waiting[0]]):
                now_read, expected = [], 0
                while waiting and (expected < limit or not now_read):
                    now_read.append(waiting.pop(0))
                    expected += min(stats[t][now_read[-1]][0] for t in terms)
                rows = self.scored(terms, weights, now_read).where(reject_reason(now, seconds).isNull())
                rows = rows.orderBy(F.desc("text_rank"), F.col("observed_at").desc_nulls_last(), "doc").limit(limit).collect()
                newest_first = lambda r: -r[2].timestamp() if r[2] is not None else math.inf
                found = sorted([*found, *[(r.doc, r.text_rank, r.observed_at, r.bucket) for r in rows]], key=lambda r: (-r[1], newest_first(r), r[0]))[:limit]
        places = self.spark.createDataFrame([(doc, rank, i) for i, (doc, rank, *_) in enumerate(found)], "_doc string, text_rank double, place int")
        docs = self._table("docs").where(F.col("bucket").isin(sorted({b for *_, b in found})) & F.col(self.key).isin([d for d, *_ in found]))
        hits = self._alive(docs).join(F.broadcast(places), F.col(self.key) == F.col("_doc"))  # `limit` rows at most
        return hits.drop("_doc", "action", "bucket", "segment", *_OWN).withColumns({"exact_match": F.lit(False), "match_confidence": F.lit(0.0)})

    def scored(self, terms: list[str], weights: dict[str, int], tiers: list[int]) -> DataFrame:
        """doc, observed_at, bucket, text_rank of the documents of these tiers that have all terms: a rank for each text, then the texts' documents."""
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()])
        rows = self.postings(terms, tiers).select("_text", "length", "term", "tf")
        rows = (rows.distinct() if len(self._known) > 1 else rows).groupBy("_text", "length").agg(F.count("*").alias("n"), F.sum(F.col("tf") * weight).alias("points"))
        texts = rows.where(F.col("n") == len(terms)).select("_text", (F.col("points") / F.col("length")).alias("text_rank"))
        buckets = [r.bucket for r in texts.select(self._bucket(F.hex("_text")).alias("bucket")).distinct().collect()]  # `buckets` numbers at most
        docs = self._alive(self._table("docs").where(F.col("bucket").isin(buckets)).select(self.key, "observed_at", "_text", "segment", "bucket"), texts)
        return docs.join(texts, "_text").select(F.col(self.key).cast("string").alias("doc"), "observed_at", "bucket", "text_rank")

    def compact(self, path: str) -> OfferIndex:
        """The same documents as an index of one segment in another folder."""
        out = OfferIndex(self.spark, path, self.key, self.text, self.buckets)
        out.write(self.documents().drop("action", "bucket", "segment"))
        return out
