"""Centroid clustering on bit planes: exact squared distances by AND and popcount.

A vector of 64 components becomes integers, floor(scale * x). Bit j of all 64 integers, in two's complement, is packed into one
unsigned 64-bit word, the plane j. The dot product of a vector and a centroid is the sum over pairs of their planes of
2^j * 2^k * popcount(plane j AND plane k), where the highest plane of either counts negative; squared distances follow from it
and the two squared lengths, all in integers. The planes are written once; each round reads them, and a task adds up what its
vectors bring to their centroids, so a round shuffles k rows a task at most, whatever share of the vectors one centroid has.
Only the centroids (k x 64 integers) pass through the driver.

Cases: a vector that is null, doesn't have exactly 64 components, or has a component that is null, NaN or infinite isn't kept
and isn't in the result. Repeated rows are vectors of their own. A null vec_id has the empty text for its decimal; equal hashes
(repeated ids) go by the planes. With fewer kept vectors than k there are as many centroids as vectors; with none the result
is empty. Integers beyond +-2^27 count as +-2^27, since a squared distance beyond that doesn't fit a long; sums that don't fit
one are the largest long. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import materialise, scratch

#: One plane is one unsigned 64-bit word.
COMPONENTS = 64
#: Rows that a task compares with all centroids at once
ROWS_AT_ONCE = 4096
LIMIT, LONGEST = 1 << 27, (1 << 63) - 1


@dataclass
class Centroids:
    """k centroids as integers, with their planes and squared lengths."""

    values: np.ndarray

    def __post_init__(self) -> None:
        self.planes = planes_of(self.values)
        self.lengths = (self.values**2).sum(axis=1)


def planes_of(values: np.ndarray) -> np.ndarray:
    """[rows, planes] unsigned 64-bit words of [rows, 64] integers; as many planes as the largest needs, the last one the sign's."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    bits = (values[:, None, :] >> np.arange(most.bit_length() + 1)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights_of(n: int) -> np.ndarray:
    """What a bit of each plane counts."""
    out = np.int64(1) << np.arange(n, dtype=np.int64)
    out[-1] *= -1
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The [rows, 64] integers of [rows, planes] words."""
    bits = np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.einsum("p,rpc->rc", weights_of(planes.shape[1]), bits)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all vectors of `a` with all of `b`, both as planes."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for j, w in enumerate(weights_of(a.shape[1])):
        inner = np.zeros_like(out)
        for k, v in enumerate(weights_of(b.shape[1])):
            inner += v * np.bitwise_count(a[:, j, None] & b[None, :, k]).astype(np.int64)
        out += w * inner
    return out


def nearest(planes: np.ndarray, lengths: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller one of equals) and the squared distance to it."""
    distance = lengths[:, None] + centroids.lengths[None, :] - 2 * dots(planes, centroids.planes)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def kept_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v: Column = F.col(column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & (F.size(v) == COMPONENTS)).where(sound)


def pack(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, planes (binary, 8 bytes a plane), length2 (long) of every kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                block = batch.slice(i, ROWS_AT_ONCE)
                x = block.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
                values = np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)
                packed = planes_of(values)
                yield pa.RecordBatch.from_arrays(
                    [block.column("vec_id"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array((values**2).sum(axis=1))],
                    names=["vec_id", "planes", "length2"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return kept_vectors(vectors).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"vec_id {kind}, planes binary, length2 long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of packed vectors with their planes, those of a shorter row filled up with its sign, and their squared lengths."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            block = batch.slice(i, ROWS_AT_ONCE)
            rows = block.column("planes").to_pylist()
            n = max(map(len, rows))
            planes = np.frombuffer(b"".join(r + r[-8:] * ((n - len(r)) // 8) for r in rows), dtype="<u8").reshape(len(rows), n // 8)
            yield block, planes, block.column("length2").to_numpy()


def first_centroids(packed: DataFrame, k: int, seed: int) -> Centroids | None:
    """The k vectors with the smallest hashes of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = packed.select(name.alias("name"), "planes").orderBy("name", "planes").limit(k).collect()
    if not chosen:
        return None
    return Centroids(np.concatenate([values_of(np.frombuffer(r.planes, dtype="<u8")[None, :]) for r in chosen]))


def moved(packed: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after a round: floor(sum / count) of the vectors nearest to each, or as they were where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids.values), COMPONENTS + 1), dtype=np.int64)  # the last column counts
        for _, planes, lengths in _blocks(batches):
            best, _ = nearest(planes, lengths, centroids)
            order = np.argsort(best, kind="stable")
            held, first = np.unique(best[order], return_index=True)
            values = np.column_stack([values_of(planes), np.ones(len(planes), dtype=np.int64)])
            sums[held] += np.add.reduceat(values[order], first, axis=0)
        held = np.flatnonzero(sums[:, COMPONENTS])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = packed.mapInArrow(run, "cluster long, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "part"))
    totals: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        totals.setdefault(r.cluster, {})[r.place] = int(r.total)
    values = centroids.values.copy()
    for c, by_place in totals.items():
        values[c] = [by_place[i] // by_place[COMPONENTS] for i in range(COMPONENTS)]
    return Centroids(values)


def assigned(packed: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance of every packed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, planes, lengths in _blocks(batches):
            best, distance = nearest(planes, lengths, centroids)
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = packed.schema["vec_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: float = 256.0) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of 64 longs) of every kept vector."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    with scratch(spark):
        packed = materialise(pack(vectors, scale), "vector-planes")
        centroids = first_centroids(packed, k, seed)
        if centroids is None:
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
        for _ in range(rounds):
            centroids = moved(packed, centroids)
        found = materialise(assigned(packed, centroids), "vector-clusters", outlives=1)
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = min(LONGEST, sum(sums.values()))
    about = [(c, min(LONGEST, total), every, [int(x) for x in centroids.values[c]]) for c, total in sorted(sums.items())]
    # k rows at most
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
