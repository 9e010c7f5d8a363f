"""Byte-level BPE by ranks for texts of any length: overlapping chunks are cut into pre-tokens in parallel and stitched.

A text up to one chunk is cut and encoded where it is read. A longer one becomes chunk rows that are spread over the tasks;
each has `overlap` characters of the next chunk, and some more to look ahead to. Every chunk is cut into pre-tokens from its first
character on, which need not start one. Two cuts of the same characters that both have a boundary at some place agree from there
on, since the pattern looks ahead only; so a chunk hands over to the next at the first place in their overlap where both have a
boundary. Then each chunk encodes what lies between its two places. Where two chunks don't agree (one pre-token over the whole
overlap, or digits out of step), whether later places are right isn't known either: the text from the last place that is known
is put together again and cut as one.

A pre-token's bytes are merged by rank, the least first, the leftmost of equals. Decoding concatenates the tokens' bytes.

Cases: a null or empty text has no ids and decodes to no bytes. Texts of any length are encoded whole. Rows are encoded one by
one, so repeated rows and ids, ties and null ids need nothing. Only doc_id and text are read by `encode`; `decode` keeps other
columns (its own replace those named decoded and decimal). An empty table gives an empty one. The pattern must not look behind, and
not further ahead than AHEAD characters but for a run of one class (as white space before a word).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylens.llm.common import materialise, text_blocks, texts_of
from quaylens.llm.tokens import PIECE_PATTERN

#: Characters of a chunk, of its overlap with the next, and of what follows that for looking ahead
CHUNK, OVERLAP, AHEAD = 32_768, 512, 64
#: Pre-tokens that a worker remembers, and the longest that it does
CACHE_PIECES, CACHE_CHARS = 500_000, 64
#: Bytes up to which pairs are searched through anew after each merge
SHORT = 48


def default_ranks() -> str:
    """The path of the public multilingual ranks, which the operators take as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Ranks:
    """One file of ranks: a token in base64 and its rank, which is its id, in each line."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.bytes}
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return self._merged_short(raw) if len(raw) <= SHORT else self._merged_long(raw)

    def _merged_short(self, raw: bytes) -> list[int]:
        rank_of = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank_of(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i])
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1])

    def _merged_long(self, raw: bytes) -> list[int]:
        """The same with a heap of pairs: n log n for n bytes. A part starts at a byte; `after` and `before` link the parts."""
        n, rank_of = len(raw), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or after[j] != end:
                continue  # one of the two has been merged meanwhile
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank_of(raw[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            h = before[i]
            if h >= 0 and (r := rank_of(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [self.ranks[raw[i : after[i]]] for i in range(n) if not gone[i]]

    def packed(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.merged(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
            if len(piece) <= CACHE_CHARS:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed, self.pieces.findall(text)))

    def encode_from(self, text: str, start: int, stop: int) -> bytes:
        """The ids of the pre-tokens that start at `start` or later and before `stop`; the pattern sees the text after that too."""
        out = []
        for m in self.pieces.finditer(text, start):
            if m.start() >= stop:
                break
            out.append(self.packed(m[0]))
        return b"".join(out)

    def starts(self, text: str) -> np.ndarray:
        """Where pre-tokens start."""
        return np.array([m.start() for m in self.pieces.finditer(text)], dtype=np.int64)


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One set of tables per worker, file and pattern."""
    return Ranks(path, pattern)


def chunks_of(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc (a number for each row), doc_id, place, last, text: the overlapping chunks of every text, `place` is where one starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 40
        for block in text_blocks(batches):
            for doc_id, text in zip(block.column("doc_id"), texts_of(block), strict=True):
                for first in range(0, len(text), 64 * chunk):  # 64 chunks a batch
                    places = [*range(first, min(len(text), first + 64 * chunk), chunk)]
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * n, pa.int64()),
                            pa.array([doc_id.as_py()] * n, block.column("doc_id").type),
                            pa.array(places, pa.int64()),
                            pa.array([p + chunk >= len(text) for p in places]),
                            pa.array([text[p : p + chunk + overlap + AHEAD] for p in places]),
                        ],
                        names=["doc", "doc_id", "place", "last", "text"],
                    )
                doc += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc long, doc_id {kind}, place long, last boolean, text string")


def with_boundaries(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Adds head and tail: where pre-tokens start in the overlaps with the chunk before and the one after, as places of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for block in text_blocks(batches):
            heads, tails = [], []
            for place, text in zip(block.column("place").to_pylist(), texts_of(block), strict=True):
                at = r.starts(text)
                heads.append(at[at <= overlap] + place)
                tails.append(at[(at >= chunk) & (at <= chunk + overlap)] + place)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*block.schema.names, "head", "tail"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"doc long, doc_id {kind}, place long, last boolean, text string, head array<long>, tail array<long>")


def stitched(chunks: DataFrame) -> DataFrame:
    """doc, place, run, start, stop: chunks with the same run are encoded as one text, from start to before stop.

    Only the boundaries in the overlaps are shuffled; a text has one short row for each of its chunks.
    """
    order = Window.partitionBy("doc").orderBy("place")
    meets = F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    found = chunks.select("doc", "place", "last", "head", "tail").withColumn("meets", meets).withColumn("start", F.lag("meets").over(order))
    met = ((F.col("place") == 0) | F.col("start").isNotNull()).cast("int")
    found = found.withColumn("all_met", F.min(met).over(order))
    return found.select("doc", "place", F.sum("all_met").over(order).alias("run"), F.when(F.col("place") == 0, 0).otherwise(F.col("start")).alias("start"), F.col("meets").alias("stop"))


def encode_chunks(chunks: DataFrame, path: str, pattern: str, chunk: int) -> DataFrame:
    """doc_id and ids of every text of `chunks`, which has the boundaries."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    parts = chunks.select("doc", "doc_id", "place", "text").join(stitched(chunks), ["doc", "place"])
    # a run's chunks, which are those of one text at most
    runs = parts.groupBy("doc", "doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("place", "text", "start", "stop"))).alias("parts"))

    def encode_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = row.column("parts")[0].as_py()
                text = "".join([p["text"][:chunk] for p in held[:-1]] + [held[-1]["text"]])
                base, stop = held[0]["place"], held[-1]["stop"]
                ids = r.encode_from(text, held[0]["start"] - base, len(text) if stop is None else stop - base)
                yield pa.RecordBatch.from_arrays([row.column("doc"), row.column("doc_id"), row.column("run"), pa.array([ids], pa.binary())], names=["doc", "doc_id", "run", "ids"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = b"".join(p["ids"] for p in row.column("parts")[0].as_py())
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.array([ids], pa.binary()), pa.array([len(ids) // 4], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    encoded = runs.mapInArrow(encode_run, f"doc long, doc_id {kind}, run long, ids binary")
    whole = encoded.groupBy("doc", "doc_id").agg(F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("parts"))
    return whole.select("doc_id", "parts").mapInArrow(put_together, f"doc_id {kind}, ids binary, n_tokens long")


def encode(docs: DataFrame, path: str | None = None, pattern: str = PIECE_PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens of every text."""
    path = path or default_ranks()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, pattern)
        for block in text_blocks(batches):
            ids = [r.encode(t) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    several = F.length("text") > chunk + overlap
    short = docs.where(~several).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")
    cut = chunks_of(docs.where(several), chunk, overlap).repartition("doc", "place")
    chunks = materialise(with_boundaries(cut, path, pattern, chunk, overlap), "text-chunks")
    return short.unionByName(encode_chunks(chunks, path, pattern, chunk))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` with the bytes of its ids (decoded, binary) and the ids in decimal, joined by commas (decimal). Ids that the file doesn't have raise an error."""
    path = path or default_ranks()
    kept = encoded.select(*[c for c in encoded.columns if c not in ("decoded", "decimal")])
    schema = kept.withColumns({"decoded": F.lit(b""), "decimal": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path, PIECE_PATTERN)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                block = batch.slice(i, 64)
                ids = [np.frombuffer(x or b"", dtype="<u4").tolist() for x in block.column("ids").to_pylist()]
                raw = [b"".join([r.bytes[k] for k in row]) for row in ids]
                decimal = [",".join([r.names[k] for k in row]) for row in ids]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(raw, pa.binary()), pa.array(decimal, pa.string())], names=[*block.schema.names, "decoded", "decimal"])

    return kept.mapInArrow(run, schema)
