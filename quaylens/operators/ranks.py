"""Places in an order of many rows: by range partitions, so that a group of any share of the rows is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.sources.storage import work_folder, written

#: Bits that `monotonically_increasing_id` leaves to the rows of a partition
ROW_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their place, from 1, within the columns `by`. The order must be total.

    Rows are sorted in ranges of group and order, numbered where they lie and written; what is gathered are the counts of each group in each range. Select
    what is needed before.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    # a partition's rows are numbered in the order in which they were sorted
    laid = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    laid = written(laid.withColumn("_range", F.shiftright("_row", ROW_BITS)), work_folder(rows.sparkSession, "ranks"))
    counts = laid.groupBy(*by, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group has
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], F.col("_range").alias("_in"), "_first", "_before")
    same = F.col("_range") == F.col("_in")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    out = laid.join(starts, same).withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_row", "_range", "_in", "_first", "_before", *[f"_of_{i}" for i in range(len(by))])
