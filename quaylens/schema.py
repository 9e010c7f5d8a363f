"""The offer, its enumerations and the fixed clocks of the registered queries."""

from __future__ import annotations

OFFER_DDL = """
offer_id STRING, provider STRING, provider_market STRING, source_listing_id STRING, merchant STRING, merchant_country STRING,
source_url STRING, title STRING, brand STRING, category STRING, sku STRING, condition STRING, availability STRING,
can_ship_to_saudi BOOLEAN, is_local BOOLEAN, delivery_days INT, product_price DOUBLE, shipping DOUBLE, import_cost DOUBLE,
tax DOUBLE, mandatory_fees DOUBLE, discount DOUBLE, currency STRING, exact_match BOOLEAN, match_confidence DOUBLE,
price_confidence STRING, data_kind STRING, observed_at TIMESTAMP
"""
#: How certain an offer is, from the most to the least
BUCKETS = ("confirmed", "estimated", "probable", "incomplete", "ineligible")
#: The specifications that a profile holds
SPEC_FIELDS = ("brand", "color", "storage", "model_number")
#: the moment at which queries look at the tables
OFFERS_NOW, EVENTS_NOW = "2000-06-01 00:00:00", "2024-01-30 00:00:00"
