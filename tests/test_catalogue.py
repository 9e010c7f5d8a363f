"""From rows to a result page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylens.catalogue import Catalogue
from quaylens.plans.catalog_queries import CATEGORIES, COLORS
from quaylens.schema import OFFERS_NOW
from quaylens.sources.views import offers


def test_the_whole_way(spark, data, tmp_path):  # noqa: ANN001
    catalogue = Catalogue(spark, str(tmp_path / "c"), CATEGORIES, COLORS, buckets=4)
    rows = offers(spark, data)
    catalogue.ingest(rows.where("currency = 'SAR'"), OFFERS_NOW)
    found = catalogue.search("red widget", OFFERS_NOW, 1e9)
    every = found.offers.collect()
    assert every and all("red" in r.title and "widget" in r.title and r.product_price > 0 for r in every)
    assert len({(r.product_id, r.merchant, r.condition) for r in every}) == len(every)
    pages = [r.offer_id for n in range(3) for r in found.page(n, 7).collect()]
    best = sorted(every, key=lambda r: (-r.query_score, r.product_price, r.offer_id))
    assert pages == [r.offer_id for r in best[:21]]
    assert found.groups().agg(F.sum("offers")).first()[0] == len(every)
    assert {r.facet for r in found.facets("color").collect()} == {"red"}
    # a dearer, newer observation of the first takes its place; an older one doesn't
    first = rows.where(F.col("offer_id") == pages[0])
    for days, price in ((1, 1e6), (-9, 1.0)):
        catalogue.ingest(first.withColumns({"product_price": F.lit(price), "observed_at": F.col("observed_at") + F.expr(f"INTERVAL {days} DAYS")}), OFFERS_NOW)
    again = {r.offer_id: r.product_price for r in catalogue.search("red widget", OFFERS_NOW, 1e9).offers.collect()}
    assert again.get(pages[0], 1e6) == 1e6
    audit = catalogue.audit().collect()
    assert sum(r.raw for r in audit) == catalogue.index.documents().count() and all(r.raw == r.accepted + r.rejected + r.duplicates for r in audit)
    assert catalogue.search("nothing like it", OFFERS_NOW, 1e9).page(0).count() == 0
