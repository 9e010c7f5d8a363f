"""Small helpers shared by the corpus operators: work tables, column checks, blocks of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D. `bytes.split()` splits on the same six bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


_local_root: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, below `spark.checkpoint.dir`.

    Where that is unset a local session gets a temporary folder, any other a folder of the warehouse, which all executors
    see. A path without a scheme is one of Spark's default file system; the result says which that is.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            if not _local_root:
                _local_root.append(tempfile.mkdtemp(prefix="spark-work-"))
            root = _local_root[0]
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if "://" not in root and not root.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def materialise(df: DataFrame, purpose: str, outlives: int = 0) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: its lineage ends there, and lost executors cost no more than a read.

    The table goes with the innermost `scratch`, or with the one `outlives` levels further out; without any it stays.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    if len(_scratch) > outlives:
        _scratch[-1 - outlives].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables that are written within are removed at its end."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A join's hot keys are split even where the step after it would use the join's partitioning.
SPLIT_JOINS = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
#: Queries lose their shuffle files when they end, so that rounds don't pile them up.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runs what is within under these settings of the session."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lowered."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def block_words(block: pa.RecordBatch, column: str = "text") -> tuple[pa.Array, np.ndarray]:
    """The same for a whole block: all words one after another (binary), and where each text's words start and end. A null text has none."""
    texts = pc.fill_null(block.column(column), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # with an empty word where a text starts or ends in white space
    words, edges = parts.flatten(), np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]
    filled = pc.binary_length(words).to_numpy() > 0
    if not filled.all():
        edges = np.r_[0, np.cumsum(filled)][edges]
        words = words.filter(pa.array(filled))
    return words.cast(pa.binary()), edges


def give_back_memory() -> None:
    """Returns to the system what this worker has freed: workers live on between tasks and would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into row blocks of about `max_bytes` of text (at least one row), so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += int(size) + 64
        if len(sizes) > first:
            yield batch.slice(first, len(sizes) - first)
    give_back_memory()


def texts_of(block: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a block; null is the empty text."""
    return [t or "" for t in block.column(column).to_pylist()]


#: bytes of a table, as written, that may be broadcast
BROADCAST_BYTES = 8 << 20


def small(table: DataFrame) -> DataFrame:
    """`table`, marked to be broadcast if its files hold at most BROADCAST_BYTES; for tables that `materialise` gave, whose size Spark knows."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def semi_join(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on a nullable id, whatever columns `docs` has. `ids`, read from a table, is broadcast if that is small; else both sides are shuffled by the id."""
    wanted = fresh("wanted", docs)
    return docs.join(small(ids.select(F.col(key).alias(wanted))), docs[key].eqNullSafe(F.col(wanted)), how)
