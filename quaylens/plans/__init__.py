"""All registered queries but those of the corpus operators."""

from quaylens.plans import catalog_queries, console_queries, evidence_queries, gate_queries, offer_queries, shop_queries, source_queries, store_queries
from quaylens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog_queries", "console_queries", "evidence_queries", "gate_queries", "offer_queries", "shop_queries", "source_queries", "store_queries"]
