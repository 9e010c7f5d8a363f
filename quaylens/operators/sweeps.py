"""Long passes over stored tables in bounded pages, each of which can be the last before a job dies: the cursor is stored, and wraps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.operators.catalog import drain


@dataclass
class Cursor:
    """Where a pass has come to, in a folder: one small file for each step, of which the newest counts; a step that isn't complete has none."""

    spark: SparkSession
    path: str

    def get(self) -> tuple[object, object] | None:
        """after and upper of the pass under way; None where one begins."""
        try:
            last = self.spark.read.parquet(f"{self.path}/steps").orderBy(F.desc("step")).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return (last[0].after, last[0].upper) if last and last[0].upper is not None else None

    def put(self, after: object, upper: object, kind: str) -> None:
        """Stores a step; None for both ends the pass."""
        try:
            step = self.spark.read.parquet(f"{self.path}/steps").agg(F.max("step")).first()[0] + 1
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            step = 0
        self.spark.createDataFrame([(step, after, upper)], f"step int, after {kind}, upper {kind}").coalesce(1).write.mode("append").parquet(f"{self.path}/steps")


def _page(rows: DataFrame, key: str, cursor: Cursor, size: int) -> tuple[DataFrame, object, object] | None:
    """The next `size` rows in order of the key, the last key, and where the pass ends: keys that come later are the next pass's."""
    at = cursor.get()
    after, upper = at if at is not None else (None, rows.agg(F.max(key)).first()[0])
    if upper is None:
        return None
    rows = rows.where(F.col(key) <= upper)
    page = (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)
    return page, page.agg(F.max(key)).first()[0], upper


def reconcile_page(canonical: DataFrame, index: DataFrame, key: str, cursor: Cursor, size: int, stale: Column | None = None) -> tuple[DataFrame, object, object]:
    """What the index needs for the next `size` canonical keys: repair (absent, of another revision or fingerprint), remove (stale but there), skip (stale, not there) or keep.

    Gives the actions and what `advance` takes once they are done; a page that isn't advanced comes again. Both tables: key (unique), revision, fingerprint if they have one.
    """
    found = _page(canonical, key, cursor, size)
    if found is None:
        return canonical.limit(0).select(key, F.lit("").alias("action")), None, None
    page, last, upper = found
    printed = "fingerprint" in canonical.columns and "fingerprint" in index.columns
    i = index.select(F.col(key).alias("_k"), F.col("revision").alias("_r"), (F.col("fingerprint") if printed else F.lit(None)).alias("_f"))
    over = F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False)
    other = F.col("_r").isNull() | ~F.col("_r").eqNullSafe(F.col("revision"))
    if printed:
        other = other | ~F.col("_f").eqNullSafe(F.col("fingerprint"))
    action = F.when(over & F.col("_k").isNotNull(), "remove").when(over, "skip").when(F.col("_k").isNull() | other, "repair").otherwise("keep")
    return page.join(i, F.col(key) == F.col("_k"), "left").select(key, action.alias("action")), last, upper


def outbox_page(outbox: DataFrame, canonical: DataFrame, key: str, cursor: Cursor, size: int) -> tuple[DataFrame, object, object]:
    """What becomes of the next `size` entries in order of their id, as `drain` has it. outbox: id, key, revision."""
    found = _page(outbox, "id", cursor, size)
    if found is None:
        return drain(outbox.limit(0), canonical, key), None, None
    page, last, upper = found
    return drain(page, canonical, key), last, upper


def advance(cursor: Cursor, last: object, upper: object, kind: str) -> bool:
    """Stores that a page is done. True if the pass is at its end; the next page is then the first of a new one."""
    ended = last is None or last == upper
    cursor.put(None if ended else last, None if ended else upper, kind)
    return ended
