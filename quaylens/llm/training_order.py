"""Training-order materialisation of token sequences.

1. Every task joins the ids of its documents, each with an end id, into one stream and cuts it into sequences of exactly
   `length` ids; the task's last one is filled up with end ids. The sequences are written down once, compressed, with the
   task and the number within it, so that a second attempt of anything later meets the same numbers.
2. Sequences are numbered densely (a task's first number is the count of those of the tasks before it). A keyed Feistel
   permutation of the numbers, walked along its cycles until it falls below the number of sequences, gives each its global
   slot.
3. Sequences are dealt to tasks by ranges of slots, several shards to a task where there are many, and written in slot
   order. A shard holds `shard_sequences` slots and nothing but ids (of 16 bits if the vocabulary allows it, else of 32), so
   slot s starts at byte (s mod shard_sequences) * length * id bytes of shard s div shard_sequences: reading goes on from
   any slot, without an index.

The manifest says what each slot holds: the pieces of documents, in order, with their places.

Cases: a null or empty text is the end id alone. A text of any length runs over as many sequences as it needs. Repeated rows
are documents of their own; ties don't arise (slots differ). Columns other than doc_id and text aren't read. An empty table
gives an empty manifest and no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quaylens.llm.common import DROP_SHUFFLES, materialise, scratch, session_settings, shared_folder, text_blocks, texts_of
from quaylens.llm.files import AtomicFile, open_input
from quaylens.llm.tokens import default_vocabulary, encoder, read_vocabulary

END_ID, LENGTH, SHARD_SEQUENCES, MOST_TASKS, ROUNDS = 50_256, 2_048, 4_096, 8_192, 4
BOOK_BYTES, SAMPLE_TEXTS, SAMPLE_CHARS = 112_640, 1_000, 20_000


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 .. size - 1, chosen by the key."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.Philox(key)).integers(0, 2**63, ROUNDS).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            y = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((y >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():  # the domain is less than four times as large
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def id_type(vocabulary: str) -> str:
    """The narrowest type that holds every id of the vocabulary."""
    ordinary, added = read_vocabulary(vocabulary)
    return "<u2" if max([END_ID, *ordinary.values(), *added.values()]) < 1 << 16 else "<u4"


def _press(book: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(book)) if book else zstandard.ZstdCompressor(level=6)


def _unpack(book: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book)) if book else zstandard.ZstdDecompressor()


def shared_book(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> bytes:
    """A compression dictionary for sequences, from the start of up to SAMPLE_TEXTS texts. It makes what tasks send one another smaller and has no other effect; empty where there is too little to train on."""
    kind_of_id, enc = np.dtype(id_type(vocabulary)), encoder(vocabulary)
    rows = docs.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_TEXTS).collect()
    ids = np.concatenate([np.zeros(0, kind_of_id), *(enc.ids(r.text).astype(kind_of_id) for r in rows)])
    try:
        return zstandard.train_dictionary(BOOK_BYTES, [ids[i : i + length].tobytes() for i in range(0, len(ids), length)], d=8, k=256, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH, book: bytes = b"") -> DataFrame:
    """task, number, packed (`length` ids, compressed for their way to the shard), pieces: doc_id, start (the document's ids before it), length and offset (in the sequence)."""
    kind_of_id = np.dtype(id_type(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"task int, number long, packed binary, pieces array<struct<doc_id: {kind}, start: long, length: long, offset: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, number, press = encoder(vocabulary), TaskContext.get().partitionId(), 0, _press(book)
        open_ids: list[np.ndarray] = []
        open_pieces: list[dict] = []
        filled = 0
        for block in text_blocks(batches):
            rows: list[tuple[bytes, list[dict]]] = []
            id_kind = block.schema.field("doc_id").type
            for doc_id, text in zip(block.column("doc_id").to_pylist(), texts_of(block), strict=True):
                ids = np.append(enc.ids(text), np.uint32(END_ID)).astype(kind_of_id)
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - filled]
                    open_ids.append(part)
                    open_pieces.append({"doc_id": doc_id, "start": start, "length": len(part), "offset": filled})
                    start, filled = start + len(part), filled + len(part)
                    if filled == length:
                        rows.append((np.concatenate(open_ids).tobytes(), open_pieces))
                        open_ids, open_pieces, filled = [], [], 0
            if rows:
                yield _batch(task, number, rows, id_kind, press)
                number += len(rows)
        if filled:
            rest = np.full(length - filled, END_ID, dtype=kind_of_id)
            yield _batch(task, number, [(np.concatenate([*open_ids, rest]).tobytes(), open_pieces)], id_kind, press)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _batch(task: int, number: int, rows: list[tuple[bytes, list[dict]]], id_kind: pa.DataType, press: zstandard.ZstdCompressor) -> pa.RecordBatch:
    pieces = pa.list_(pa.struct([("doc_id", id_kind), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]))
    columns = [pa.array([task] * len(rows), pa.int32()), pa.array(range(number, number + len(rows)), pa.int64()), pa.array([press.compress(r[0]) for r in rows], pa.binary()), pa.array([r[1] for r in rows], pieces)]
    return pa.RecordBatch.from_arrays(columns, names=["task", "number", "packed", "pieces"])


def place(cut: DataFrame, key: int) -> tuple[int, DataFrame]:
    """The number of sequences, and `cut` with the slot of each in place of task and number."""
    counts = cut.groupBy("task").agg(F.max("number").alias("last")).collect()  # a row per task that cut texts
    start, total = {}, 0
    for task, last in sorted(counts):
        start[task] = total
        total += last + 1

    @F.pandas_udf(LongType())
    def slot_of(task: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(feistel(task.map(start).to_numpy() + number.to_numpy(), total, key))

    return total, cut.withColumn("slot", slot_of("task", "number")).drop("task", "number")


def write(docs: DataFrame, key: int = 20_24, vocabulary: str | None = None, folder: str | None = None, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and the manifest: slot, shard, position (in the shard), ids_crc32, pieces."""
    spark = docs.sparkSession
    path, out = vocabulary or default_vocabulary(), folder or shared_folder(spark, "shards")
    with session_settings(spark, DROP_SHUFFLES), scratch(spark):
        book = shared_book(docs, path, length)
        return out, _write(materialise(sequences(docs, path, length, book), "sequences"), key, out, shard_sequences, book)


def _write(cut: DataFrame, key: int, out: str, shard_sequences: int, book: bytes) -> DataFrame:
    total, placed = place(cut, key)
    shards = max(1, -(-total // shard_sequences))
    dealt = placed.withColumn("shard", F.expr(f"slot div {shard_sequences}L")).repartitionByRange(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, unpack = None, None, _unpack(book)
        for batch in batches:
            crcs = []
            for packed, shard in zip(batch.column("packed").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                ids = unpack.decompress(packed)
                if shard != at:
                    if file is not None:
                        file.close()
                    file, at = AtomicFile(out, f"shard-{shard:08d}.bin"), shard
                file.write(ids)
                crcs.append(zlib.crc32(ids))
            position = pa.array([s % shard_sequences for s in batch.column("slot").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), position, pa.array(crcs, pa.int64()), batch.column("pieces")], names=["slot", "shard", "position", "ids_crc32", "pieces"])
        if file is not None:
            file.close()

    kind = placed.schema["pieces"].dataType.simpleString()
    return materialise(dealt.mapInArrow(run, f"slot long, shard long, position long, ids_crc32 long, pieces {kind}"), "shard-manifest", outlives=1)


def read(spark: SparkSession, folder: str, total: int, first_slot: int = 0, vocabulary: str | None = None, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """slot, ids (binary) from the shards alone, from `first_slot` on: a task reads its shards from front to back, by stride."""
    stride = length * np.dtype(id_type(vocabulary or default_vocabulary())).itemsize
    shards = range(first_slot // shard_sequences, max(first_slot // shard_sequences, -(-total // shard_sequences)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                slot, end = max(first_slot, shard * shard_sequences), min(total, (shard + 1) * shard_sequences)
                with open_input(folder, f"shard-{shard:08d}.bin") as source:
                    source.seek((slot - shard * shard_sequences) * stride)
                    while slot < end:
                        n = min(end - slot, max(1, (4 << 20) // stride))
                        data = source.read(n * stride)
                        if len(data) != n * stride:
                            raise ValueError(f"shard {shard} of {folder} ends early")
                        yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + n), pa.int64()), pa.array([data[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())], names=["slot", "ids"])
                        slot += n

    return spark.range(shards.start, shards.stop, 1, max(1, min(len(shards), MOST_TASKS))).mapInArrow(run, "slot long, ids binary")


def read_back(folder: str, manifest: DataFrame, vocabulary: str | None = None, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, slot, offset, shard, position, ids_crc32, and read_crc32 of the sequence as read from its shard."""
    total = manifest.count()
    found = read(manifest.sparkSession, folder, total, 0, vocabulary, length, shard_sequences).select("slot", F.crc32("ids").alias("read_crc32"))
    rows = manifest.join(found, "slot", "left").select("slot", "shard", "position", "ids_crc32", "read_crc32", F.explode("pieces").alias("piece"))
    return rows.select("piece.doc_id", "piece.start", "piece.length", "slot", "piece.offset", "shard", "position", "ids_crc32", "read_crc32")
