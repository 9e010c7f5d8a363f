"""The whole way from rows to a result page: what a user of the library calls, in terms of its operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.operators import audit as au
from quaylens.operators import extraction, gates, groups, matching
from quaylens.operators import offers as op
from quaylens.operators.inverted import OfferIndex

#: Fixed value: hits of one recall.
RECALLED = 1000


@dataclass
class Found:
    """What a search found: the offers that fit, newest of each identity, with query_score and exact."""

    intent: matching.Intent
    offers: DataFrame

    def page(self, number: int, size: int = 20) -> DataFrame:
        """A page of offers: the best score first, then the lowest price."""
        ordered = self.offers.orderBy(F.desc("query_score"), F.col("product_price").asc_nulls_last(), "offer_id")
        return ordered.offset(number * size).limit(size)

    def groups(self) -> DataFrame:
        """What may be compared, by `groups.comparable`, over offers scored for this query."""
        return groups.comparable(self.offers.withColumns({"exact_match": F.col("exact"), "match_confidence": F.col("query_score")}))

    def facets(self, column: str) -> DataFrame:
        return op.facets(self.offers, column)


@dataclass
class Catalogue:
    """Offers in a folder that all executors see, kept newest by key and found by their words."""

    spark: SparkSession
    path: str
    categories: tuple[str, ...] | None = None
    colors: tuple[str, ...] = ()
    identity: list[str] = field(default_factory=lambda: ["product_id", "merchant", "condition"])
    buckets: int = 64

    def __post_init__(self) -> None:
        self.index = OfferIndex(self.spark, f"{self.path}/index", buckets=self.buckets)

    def ingest(self, offers: DataFrame, now: str) -> int:
        """Takes in the acceptable rows in normal form, of each offer_id the newest; older ones than those that are there are skipped."""
        return self.index.write(gates.ingest(offers, now, [], []))

    def extract(self, pages: DataFrame, adapters: DataFrame | None = None) -> DataFrame:
        """Candidates of pages, of each page those of the first tier that found one."""
        return extraction.owner(extraction.page_candidates(pages, adapters))

    def search(self, query: str, now: str, seconds: float, limit: int = RECALLED) -> Found:
        """Recalls fresh offers that have the query's words, and keeps those that fit what it asks for."""
        intent = matching.parse_intent(query, self.categories, self.colors)
        hits = self.index.search(query, now, seconds, min(limit, RECALLED)).drop("text_rank", "place")
        # few rows, so each is read by itself
        return Found(intent, matching.assess(op.newest(hits, self.identity, ["offer_id"]), intent).where(matching.admitted(intent)))

    def audit(self, by: str = "provider") -> DataFrame:
        """raw = accepted + rejected + duplicates of each source, over the catalogue as it is."""
        return au.account(self.index.documents(), by, self.identity)
