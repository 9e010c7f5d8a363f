"""The selection of a product's variant: a cascade over dimensions in order, each among what the ones before leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("model", "edition", "storage", "condition", "color", "sku")


def _key(name: str) -> Column:
    """A dimension's key; blank is none."""
    return F.when(F.trim(name) != "", F.col(name))


def cascade(entries: DataFrame, by: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """The selected entry of each product with picked_<dimension>, and the options: by, dimension, option, groups, min_price.

    entries: a product's comparable groups, with place (their order), value, exact, condition, the dimensions as strings, and requested_<dimension> where the
    shopper asked for one. At each dimension the wanted value is taken if it is there, else that of the fallback (the first exact new group, or the first), else the
    one with the least price, by name among equals. Every window is over one product, so products are shuffled once.
    """
    product = Window.partitionBy(*by)
    fall = F.struct(~(F.coalesce("exact", F.lit(False)) & F.col("condition").eqNullSafe("new")), "place")
    rows = entries.withColumns({f"_key_{d}": _key(d) for d in dimensions})
    rows = rows.withColumn("_fallback", F.min_by(F.struct(*[F.col(f"_key_{d}") for d in dimensions]), fall).over(product))
    options = []
    for d in dimensions:
        key, asked = F.col(f"_key_{d}"), F.col(f"requested_{d}") if f"requested_{d}" in entries.columns else F.lit(None).cast("string")
        price = F.coalesce("value", F.lit(float("inf")))
        known = rows.where(key.isNotNull()).groupBy(*by, key.alias("option")).agg(F.count("*").alias("groups"), F.min("value").alias("min_price"))
        options.append(known.select(*by, F.lit(d).alias("dimension"), "option", "groups", "min_price"))
        there = lambda wanted: F.max(key == wanted).over(product)
        back = F.col("_fallback")[f"_key_{d}"]
        least = F.min(F.when(key.isNotNull(), F.struct(price, key.alias("k")))).over(product)["k"]
        picked = F.when(F.coalesce(there(asked), F.lit(False)), asked).when(F.coalesce(there(back), F.lit(False)), back).otherwise(least)
        rows = rows.withColumn(f"picked_{d}", picked).where(key.eqNullSafe(F.col(f"picked_{d}")))
    first = rows.withColumn("_rn", F.row_number().over(product.orderBy("place"))).where("_rn = 1")
    every = options[0]
    for o in options[1:]:
        every = every.unionByName(o)
    return first.drop("_rn", "_fallback", *[f"_key_{d}" for d in dimensions]), every
