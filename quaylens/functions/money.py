"""Money: parsing, conversion, rounding and the comparable total of an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED_COSTS = ("shipping", "import_cost", "tax", "mandatory_fees")


def finite(x: Column) -> Column:
    """The number, or null for NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity, on the binary value."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


#: Texts that say that there is no price.
NO_PRICE = ("n/a", "na", "null", "undefined", "unknown", "--", "-", "not available")


def parse_money(text: Column) -> Column:
    """A non-negative amount from a text in either decimal style; null where there is none.

    The last comma or dot is the decimal mark, unless it is the only kind and parts off groups of three.
    """
    said = F.lower(F.trim(text))
    raw = F.regexp_replace(said, "[^0-9.,+-]", "")
    mark = F.regexp_extract(raw, "([.,])[^.,]*$", 1)
    other = F.when(mark == ",", ".").otherwise(",")
    grouped = raw.rlike(r"^[-+]?\d{1,3}(,\d{3})+$") | raw.rlike(r"^[-+]?\d{1,3}(\.\d{3})+$")
    number = F.when(grouped, F.translate(raw, ",.", "")).otherwise(F.replace(F.replace(raw, other, F.lit("")), mark, F.lit(".")))
    amount = F.when(mark == "", raw).otherwise(number).try_cast("double")
    # a plain number, as most are, needs none of this
    return F.when(text.rlike(r"^\d+(\.\d{1,2})?$"), text.try_cast("double")).when(~said.isin(*NO_PRICE) & raw.rlike("[0-9]") & (amount >= 0), amount)


def strict_price(text: Column) -> Column:
    """A decimal with two places from a text that is just that; never a zero that isn't there."""
    return F.when(text.rlike(r"^\d{1,12}(\.\d{1,2})?$"), text.try_cast("decimal(18,2)"))


def to_riyal(df: DataFrame, rates: DataFrame, price: str = "product_price") -> DataFrame:
    """Adds price_sar and fx_rate. rates: currency, rate; a currency without a rate has no price. The table of rates is small by nature, one row a currency."""
    joined = df.join(rates.select(F.col("currency").alias("_c"), "rate"), F.upper(F.trim("currency")) == F.col("_c"), "left").drop("_c")
    rate = F.when(F.upper(F.trim("currency")) == "SAR", F.lit(1.0)).otherwise(F.col("rate"))
    return joined.withColumn("fx_rate", rate).withColumn("price_sar", half_up(F.col(price) * rate, 2)).drop("rate")


def comparable_total() -> Column:
    """Price and all mandatory costs less the discount; null if one is unknown or the currency is foreign."""
    code = F.upper(F.trim(F.coalesce("currency", F.lit(""))))
    total = finite(F.col("product_price"))
    for c in REQUIRED_COSTS:
        total = total + finite(F.col(c))
    total = total - F.coalesce(finite(F.col("discount")), F.lit(0.0))
    return F.when(code.isin("", "SAR") & total.isNotNull(), F.greatest(F.lit(0.0), total))
