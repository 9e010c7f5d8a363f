"""Packing of token sequences as a cutting-stock problem, solved by column generation.

A document's ids, with an end id, are cut into full pieces of the sequence length, which need no packing, and one
remainder. The remainders are counted by length class (the length rounded up to a multiple of `grain`). A linear program
over patterns (how many pieces of each class share a sequence) is solved by column generation: an unbounded knapsack by
dynamic programming prices new patterns against the duals. The rounded patterns say how many sequences of each kind there
are; the pieces of a class, ranked by bucket and id, fill the class's places in that order.

Only the histogram, the patterns and the rank offsets meet on the driver, all bounded by the number of classes; pieces are
ranked in buckets of bounded size, whose offsets come from a window over counts.

Cases: a null or empty text is the end id alone. Repeated rows and ties are packed row by row (a row number that is
written down with the pieces tells them apart). A text of any length is cut into as many pieces as it needs, however long its
runs of one kind of character. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylens.llm.common import materialise, text_blocks, texts_of
from quaylens.llm.tokens import default_vocabulary, encoder

LENGTH, END_ID, GRAIN = 2048, 1, 8
#: pieces in a bucket of the ranking, about
BUCKET = 100_000


def cut(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for block in text_blocks(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(texts_of(block)):
                ids = enc.ids(text).tobytes() + end
                n = len(ids) // 4
                rows += [(k, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            at, *columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(values: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The most valuable multiset of classes (class i takes i + 1 units of room), by dynamic programming over the room."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        got = values[:r] + best[r - 1 :: -1][: len(values[:r])]
        k = int(np.argmax(got))
        if got[k] > best[r - 1] + 1e-12:
            best[r], choice[r] = got[k], k
        else:
            best[r] = best[r - 1]
    picked, r = [], room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            picked.append(int(choice[r]))
            r -= int(choice[r]) + 1
    return float(best[room]), picked


def solve(demand: np.ndarray, room: int, rounds: int = 4000, tolerance: float = 1e-3) -> Counter[tuple[int, ...]]:
    """Patterns (sorted tuples of class numbers) with how often each is used, covering the demand exactly."""
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return Counter()
    need = demand[classes].astype(float)
    row_of = {int(c): i for i, c in enumerate(classes)}
    # start: each class alone, as often as it fits; the basis is kept as its inverse
    columns = [Counter({i: room // (int(c) + 1)}) for i, c in enumerate(classes)]
    inverse = np.diag([1.0 / room_for[i] for i, room_for in enumerate(columns)])
    amount = inverse @ need
    for _ in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(room)
        values[classes] = dual
        gain, picked = best_pattern(values, room)
        if gain <= 1 + tolerance:  # no cover is cheaper than this one divided by the gain
            break
        column = Counter(row_of[k] for k in picked if k in row_of)
        entering = inverse @ np.array([column[i] for i in range(m)], dtype=float)
        ratio = np.full(m, np.inf)
        ratio[entering > 1e-9] = amount[entering > 1e-9] / entering[entering > 1e-9]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / entering[out]
        inverse -= np.outer(entering, pivot)
        inverse[out] = pivot
        amount = np.maximum(0.0, amount - entering * ratio[out])
        amount[out] = ratio[out]
        columns[out] = column
    used: Counter[tuple[int, ...]] = Counter()
    left = demand.astype(np.int64).copy()
    for column, x in sorted(zip(columns, amount, strict=True), key=lambda p: -p[1]):
        times = min([int(x + 1e-9), *(int(left[classes[i]]) // n for i, n in column.items())])
        if times > 0:
            used[tuple(sorted((int(classes[i]) for i in column.elements()), reverse=True))] += times
            for i, n in column.items():
                left[classes[i]] -= times * n
    # what rounding leaves, less than a few pieces of each class, goes largest first into the fullest sequence that has room
    open_rooms: list[tuple[int, list[int]]] = []
    for k in np.repeat(np.arange(len(left)), left)[::-1].tolist():
        fits = [i for i, (r, _) in enumerate(open_rooms) if r >= k + 1]
        if fits:
            i = min(fits, key=lambda j: open_rooms[j][0])
            open_rooms[i] = (open_rooms[i][0] - k - 1, [*open_rooms[i][1], k])
        else:
            open_rooms.append((room - k - 1, [k]))
    used.update(tuple(sorted(p, reverse=True)) for _, p in open_rooms)
    return used


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and sequence_length (tokens in the sequence).

    A sequence is padded to `length` unless the number of its tokens is a power of two.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, vocabulary or default_vocabulary(), length).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    room = length // grain
    kind = F.when(F.col("length") == length, F.lit(-1)).otherwise(F.expr(f"cast((length + {grain - 1}) div {grain} - 1 as int)"))
    pieces = pieces.withColumn("_class", kind)
    histogram = dict(pieces.groupBy("_class").count().collect())  # at most as many rows as there are classes
    full = histogram.pop(-1, 0)
    demand = np.zeros(room, dtype=np.int64)
    for c, n in histogram.items():
        demand[c] = n
    patterns = solve(demand, room)
    # the places of each class: pattern by pattern, `held` of them in each of its `times` sequences
    places, base = [], full
    seen: Counter[int] = Counter()
    for pattern, times in sorted(patterns.items(), reverse=True):
        before = 0
        for c, held in sorted(Counter(pattern).items(), reverse=True):
            places.append((c, seen[c], seen[c] + held * times, held, base, before))
            seen[c] += held * times
            before += held
        base += times
    table = spark.createDataFrame(places, "_class int, _from long, _to long, _held long, _base long, _before long")

    buckets = max(1, -(-(full + int(demand.sum())) // BUCKET))
    ranked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    sizes = ranked.groupBy("_class", "_bucket").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("_start", F.sum("n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_class", "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(F.col("length").desc(), F.col("doc_id"), F.col("_row"))) - 1
    ranked = ranked.withColumn("_rank", within.cast("long")).join(offsets, ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_start")).drop("_start", "_bucket")

    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = ranked.where("_class = -1").select(*own, F.col("_rank").alias("sequence_id"), F.lit(0).cast("long").alias("_place"))
    # a join on the class alone, with the range as its condition: the table has a row for each class of each pattern, at most a few thousand
    rest = ranked.where("_class >= 0").join(F.broadcast(table), (ranked["_class"] == table["_class"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    turn = F.col("_rank") - F.col("_from")
    rest = rest.select(*own, (F.col("_base") + F.floor(turn / F.col("_held"))).cast("long").alias("sequence_id"), (F.col("_before") + turn % F.col("_held")).alias("_place"))
    in_order = Window.partitionBy("sequence_id").orderBy("_place")
    filled = F.coalesce(F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = rest.withColumn("offset", filled).withColumn("sequence_length", F.sum("length").over(Window.partitionBy("sequence_id")))
    whole = whole.withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_length", F.col("length"))
    return whole.unionByName(rest).drop("_place")
