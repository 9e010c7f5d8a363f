"""Folders and written tables that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, with its file system; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.mkdtemp(prefix="spark-work-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if "://" not in root and not root.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return root.rstrip("/")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run within lose their shuffle files when they end, so that steps don't pile them up."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` as a table that was written and is read back: its lineage ends there, and its shuffle files go."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: bytes of a table, as written, that may be broadcast
BROADCAST_BYTES = 8 << 20


def small(table: DataFrame) -> DataFrame:
    """`table`, marked to be broadcast if its files hold at most BROADCAST_BYTES; for tables that `written` gave, whose size Spark knows."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
