"""Offers around game consoles, described by their titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.operators import described as ds
from quaylens.plans.registry import query
from quaylens.sources.views import OFFERS_SQL, offers

#: how the offers of the tables are titled: by product, and every other time with the product's colour behind
_TITLES = (
    "Sony PlayStation 5 Slim Disc with Extra DualSense Controller + Racing Game",
    "Sony PS5 Slim Digital with Additional DualSense Controller",
    "PS5 Slim Disc Drive with Extra DualSense Controller",
    "Protective case for PS5 Slim Disc with controller",
    "PS5 Slim Console Hub with Controller",
    "PS5 Console White + DualSense Controller",
    "PS5 Console Cover + Controller",
    "PS5 Console Hub Bundle with Charger",
    "PS5 Console with Disc Drive",
    "NVMe SSD heatsink for PS5",
    "Sony PS5 Slim 825 GB Bundle DualSense Controller",
    "Sony PS5 Pro",
    "PS4 Digital Edition 1 TB",
    "Spider Stories PS5",
    "Xbox Series X console stories, video game",
    "Racing 1TB PS4",
    "Nintendo Switch 2 console",
    "غطاء ps5",
    "Cordless drill",
)
_MADE = {
    "offer_id": "offer_id",
    "title": "concat(case product_id % 19 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_TITLES)) + " end, case when delivery_days % 2 = 0 then concat(' ', color) else '' end)",
    "model_number": "case when product_id % 5 = 0 then 'CFI-2016' else model_number end",
    "storage": "case when product_id % 3 = 0 then storage end",
    "source_url": "case when product_id % 7 = 0 then concat('https://shop.example.com/playstation-games/', product_id) else source_url end",
}


def _twin() -> str:
    has = lambda x, *patterns: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"
    normal = lambda x: rf"regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '([0-9]+) (gb|tb|mb)( |$)', '\1\2\3', 'g'), '\b(?:playstation|play station|ps) ?([45])\b', 'ps\1', 'g')"
    arabic = ds.ARABIC_ACCESSORY.replace("(?= |$)", "(?: |$)")  # the other engine can't look ahead
    sized = r"\b\d+(?:gb|tb)\b"
    behind = lambda x: f"substr({x}, length(subj) + 1)"
    part = f"({has('t', ds.STORAGE_PART)} AND NOT {has('t', ds.SSD_WITH_COOLING)})"
    return rf"""{OFFERS_SQL}, made AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM offers),
a AS (SELECT *, {normal("title")} AS t, regexp_replace(coalesce(model_number, ''), '[^A-Za-z0-9]', '', 'g') AS sku FROM made),
b AS (SELECT *, regexp_extract(t, '{ds.CONSOLE_SUBJECT}', 0) AS subj, {has("title", r"\s\+\s")} AS plus, regexp_extract(t, '{ds.PACKAGE}', 1) AS head, regexp_extract(t, '{ds.PACKAGE}', 2) AS tail,
 {normal(r"regexp_split_to_array(title, '\s+\+\s+')[1]")} AS base, regexp_split_to_array(t, '\bbundle\b')[1] AS pre FROM a),
c AS (SELECT *, subj <> '' AND ((plus AND NOT {has(behind("base"), ds.ACCESSORY, arabic)}) OR ({has(behind("t"), ds.CONSOLE_LINK)} AND NOT {has("t", ds.CONSOLE_HUB)})) AND {has("t", ds.ACCESSORY, arabic, ds.STORAGE_ACCESSORY)} AS inc,
 {has("head", ds.EDITION_SUBJECT)} AND {has("tail", ds.CONTROLLER)} AND NOT {has("tail", ds.CONTROLLER_PART)} AS pack, {has("sku", "(?i)" + ds.CHASSIS)} AND {has("t", r"^sony ps[45]\b")} AND NOT {part} AS chas FROM b),
d AS (SELECT *, chas AND {has("t", sized)} AND ({has("t", r"\b(?:digital|dig|disc)\b")} OR ({has("pre", r"\b(?:slim|pro)\b")} AND NOT {has("pre", ds.ACCESSORY, arabic, ds.STORAGE_ACCESSORY)})) AND (plus OR {has("t", r"\b(?:bundle|including|includes|with)\b")}) AS proven FROM c),
e AS (SELECT *, {has("t", r"\bbundle\b")} OR inc OR proven OR pack AS is_bundle, nullif(regexp_extract(t, '{ds.PLATFORM}', 0), '') AS platform FROM d)
SELECT offer_id, CASE WHEN platform IS NULL THEN 'product'
 WHEN {has("t", ds.STORAGE_ACCESSORY)} AND NOT ({has("t", ds.CONSOLE_FIRST)} OR chas OR inc) THEN 'accessory'
 WHEN {has("t", ds.ACCESSORY, arabic)} AND NOT (({has("t", r"\bbundle\b")} AND {has("t", r"\bconsole\b")} AND NOT {has("t", ds.CONSOLE_HUB)}) OR proven OR pack OR inc OR ({has("t", ds.DISC_DRIVE)} AND {has("t", ds.CONSOLE_WITH_DRIVE)})) THEN 'accessory'
 WHEN ({has("t", ds.GAME, ds.GAME_ALONE)} OR {has("source_url", "(?i)" + ds.GAME_ADDRESS)}) AND NOT (is_bundle AND ({has("t", r"\bconsole\b")} OR pack)) THEN 'game'
 WHEN pack OR {has("sku", "(?i)" + ds.CHASSIS)} OR {has("t", r"\bconsole\b", r"\b(?:digital|disc) edition\b", r"\b(?:825gb|1tb|2tb)\b", r"^(?:sony )?ps[45](?: slim| pro)?$")} THEN 'console' ELSE 'game' END AS kind,
 platform, CASE WHEN {has("t", r"\b(?:digital|dig)\b")} THEN 'digital' WHEN {has("t", r"\b(?:disc|blu ray)\b")} THEN 'disc' END AS edition,
 coalesce(nullif(regexp_extract({normal("storage")}, '{sized}', 0), ''), nullif(regexp_extract(t, '{sized}', 0), '')) AS size,
 CASE WHEN {has("t", r"\bpro\b")} THEN 'Pro' WHEN {has("t", r"\bslim\b")} THEN 'Slim' ELSE '' END AS form, is_bundle FROM e"""


@query("q_describe_product", _twin())
def describe_product(spark: SparkSession, d: str) -> DataFrame:
    titled = offers(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in _MADE.items()])
    return ds.describe(titled).select("offer_id", *[F.col(c) for c in ds.COLUMNS])
