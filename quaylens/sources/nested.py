"""Payloads of any form as VARIANT: what is looked for is found at whatever depth it lies."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.functions.money import parse_money
from quaylens.functions.text import normalize_availability
from quaylens.sources.storage import work_folder, written

#: Levels that one pass goes down
LEVELS = 6


def descend(payloads: DataFrame, stop: Callable[[Column, Column], Column], levels: int = LEVELS) -> DataFrame:
    """Every outermost node of the payloads for which stop(key, node) holds: the other columns, key, node (variant), and `at`, its place.

    payloads: a column `payload` of JSON text; text that isn't JSON has no nodes. A level is one step down: nodes that are found stay as they are, others
    give way to their children, so a payload is never copied whole. What still has children after some levels is written and goes on, however deep it is.
    """
    spark = payloads.sparkSession
    rows = payloads.withColumns({"key": F.lit(None).cast("string"), "node": F.try_parse_json("payload"), "at": F.array().cast("array<int>")}).drop("payload")
    rows, done = rows.where(F.col("node").isNotNull()), None
    holds = lambda: F.coalesce(stop(F.col("key"), F.col("node")), F.lit(False))
    rows = rows.withColumn("_found", holds())
    while True:
        for _ in range(levels):
            inside = F.when(~F.col("_found").outer(), F.col("node").outer())
            down = rows.lateralJoin(spark.tvf.variant_explode_outer(inside).toDF("_pos", "_key", "_value"))
            down = down.where(F.col("_found") | F.col("_value").isNotNull())
            down = down.withColumns({"key": F.when(F.col("_found"), F.col("key")).otherwise(F.coalesce("_key", "key")), "node": F.when(F.col("_found"), F.col("node")).otherwise(F.col("_value")), "at": F.when(F.col("_found"), F.col("at")).otherwise(F.array_append("at", F.col("_pos")))})
            rows = down.drop("_pos", "_key", "_value").withColumn("_found", F.col("_found") | holds())
        rows = written(rows, work_folder(spark, "nodes"))
        found = rows.where("_found").drop("_found")
        done = found if done is None else done.unionByName(found)
        rows = rows.where("not _found")
        if rows.isEmpty():
            return done


def values_named(payloads: DataFrame, names: list[str]) -> DataFrame:
    """The other columns, key, value (text) and `at` of every value under one of the names, at any depth, without regard to case; outermost first."""
    wanted = [n.lower() for n in names]
    found = descend(payloads, lambda key, node: F.lower(key).isin(wanted))
    return found.withColumn("value", F.try_variant_get("node", "$", "string")).drop("node")


CARD = "master-product-card"
#: what a card's attributes say, in texts
_SAID = ("productId", "offerId", "shopName", "productName", "sellingPrice", "markedPrice", "productUrl")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


#: numbers stay the text they are
_READER = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=_no_constant)


def _text(value: Any) -> str | None:
    """What a cast of a value to text says."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _number(value: Any) -> str | None:
    """The text of a number; truth counts as 1."""
    return str(int(value)) if isinstance(value, bool) else value if isinstance(value, str) else None


def _inside(value: Any, *names: str) -> Any:
    for n in names:
        if not isinstance(value, dict):
            return None
        value = value.get(n)
    return value


def card_fields(payload: str | None) -> Iterable[tuple]:
    """What each outermost card of a payload says, by place; cards that say the same once. Of a name that an object has twice the last counts."""
    try:
        open_ = [_READER.decode(payload or "")]
    except (ValueError, RecursionError):
        return ()
    out: dict[tuple, None] = {}
    while open_:  # the last is the next in place, so nodes go on it from behind
        node = open_.pop()
        if type(node) is dict:
            if node.get("uid") == CARD and type(content := node.get("componentDTO")) is dict and "additionalAttributes" in content:
                own, parts = content["additionalAttributes"], content.get("productCardComponents")
                said = [v if type(v) is str else _text(v) for v in map(own.get, _SAID)] if type(own) is dict else [None] * len(_SAID)
                stock = _inside(own, "stock")
                prices = tuple([_number(_inside(p, "componentDTO", "priceDTO", "finalPrice")) for p in parts]) if type(parts) is list else ()
                out[(*said, _text(_inside(stock, "stockLevelStatus")), _number(_inside(stock, "value")), prices)] = None
                continue
            node = list(node.values())
        open_ += [v for v in reversed(node) if type(v) is dict or type(v) is list] if type(node) is list else ()
    return out


_FOUND = ", ".join(f"{n} string" for n in (*_SAID, "status", "amount")) + ", prices array<string>, place int"


def _found_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cards of batches of payloads: source_id and what is found."""
    kinds = [pa.string()] * (len(_SAID) + 2) + [pa.list_(pa.string())]
    for batch in batches:
        owner, places, rows = [], [], []
        for i, payload in enumerate(batch.column("payload")):
            found = card_fields(payload.as_py())
            owner += [i] * len(found)
            places += range(len(found))
            rows += found
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        said = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("source_id").take(pa.array(owner, pa.int32())), *said, pa.array(places, pa.int32())], names=["source_id", *_SAID, "status", "amount", "prices", "place"])


def _cards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of JSON have no cycles, and to look for them takes a third of the time; the worker's next task may have some."""
    gc.disable()
    try:
        yield from _found_cards(batches)
    finally:
        gc.enable()


def product_cards(payloads: DataFrame) -> DataFrame:
    """Offers from the product cards of search payloads (source_id, payload): source_id, listing_id, title, price, list_price, availability, seller, url.

    A card is a node that says so and has attributes. Its price is the one it sells for, else the first positive one of its parts; cards without product,
    title or price are none. Equal product, offer, shop and price come once, the first in place. A payload is read once, in a task's Arrow batches, since a
    card takes a step of `descend` for each level that it lies deep; cards of one payload that say the same leave as one.
    """
    kind = payloads.schema["source_id"].dataType.simpleString()
    cards = payloads.select("source_id", "payload").mapInArrow(_cards_of, f"source_id {kind}, {_FOUND}")
    text = lambda name: F.trim(F.col(name))
    prices = F.filter(F.transform("prices", lambda p: p.try_cast("double")), lambda p: p > 0)
    positive = lambda c: F.when(c > 0, c)
    status, left = F.lower(F.coalesce(text("status"), F.lit(""))), F.col("amount").try_cast("double")
    joined = F.regexp_replace(status, "[_ ]", "")
    stock = F.when(joined.contains("outofstock"), "out_of_stock").when(joined.rlike("instock|lowstock"), "in_stock").when(left == 0, "out_of_stock").when(left > 0, "in_stock").otherwise(normalize_availability(status))
    rows = cards.select(
        "source_id",
        "place",
        text("productId").alias("product"),
        text("offerId").alias("offer"),
        text("shopName").alias("shop"),
        text("productName").alias("title"),
        F.coalesce(positive(parse_money(text("sellingPrice"))), F.get(prices, 0)).alias("price"),
        positive(parse_money(text("markedPrice"))).alias("list_price"),
        stock.alias("availability"),
        text("productUrl").alias("url"),
    )
    rows = rows.where("product <> '' and title <> '' and price is not null")
    same = ["source_id", "product", "offer", "shop", "price"]
    # groups of texts are sorted: a hash in front, and most rows are told apart by a number
    rows = rows.groupBy(F.xxhash64(*same).alias("_hash"), *same).agg(F.min(F.struct("place", "title", "list_price", "availability", "url")).alias("c")).select(*same, "c.*")
    return rows.select("source_id", F.concat_ws("|", "product", F.coalesce("offer", F.lit("")), F.coalesce("shop", F.lit("")), F.col("price").cast("decimal(18,2)").cast("string")).alias("listing_id"), "title", "price", "list_price", "availability", F.col("shop").alias("seller"), "url")
