"""Clusters against plain integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from quaylens.llm import centroids

DDL = "vec_id long, embedding array<float>, label int, planes string, length2 string, cluster string, distance string, centroid string"


def plain(rows, k, rounds, scale=256.0):  # noqa: ANN001, ANN201
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=name)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in set(of):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums: dict[int, int] = {}
    for _, d, n in found:
        sums[n] = sums.get(n, 0) + d
    return sorted(repr((i, n, d, sums[n], sum(sums.values()), centres[n])) for i, d, n in found)


def rows_of(df):  # noqa: ANN001, ANN201
    return [(r.vec_id, r.embedding) for r in df.collect()]


def got(df, **settings):  # noqa: ANN001, ANN003, ANN201
    return sorted(repr(tuple(r)) for r in centroids.cluster(df, **settings).collect())


def test_the_given_vectors(spark, data):  # noqa: ANN001
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    assert got(df) == plain(rows_of(df), 40, 5)


@pytest.fixture(scope="module")
def odd_vectors(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    near = [[rng.gauss(c, 0.3) for _ in range(64)] for c in (0.0, 1.0, -2.0) for _ in range(20)]
    vectors = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, [0.0] * 64, [-0.001] * 64, [-1000.0] * 64, [3000.0] * 64, *near, *[near[0]] * 30]
    ids = [None if i % 17 == 5 else i % 50 for i in range(len(vectors))]
    clash = (1, "a", "b", "c", "d", "e")
    return spark.createDataFrame([(i, v, *clash) for i, v in zip(ids, vectors, strict=True)], DDL).repartition(3)


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (5, 5), (7, 0)])
def test_odd_vectors(spark, odd_vectors, k, rounds):  # noqa: ANN001
    rows = {repr(r): r for r in rows_of(odd_vectors) if r[0] is not None}.values()  # one of each id, so that no hash is shared
    df = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "vec_id long, embedding array<float>")
    assert got(df, k=k, rounds=rounds) == plain(rows_of(df), k, rounds)


def test_equal_hashes_and_repeated_rows(odd_vectors):  # noqa: ANN001
    first = got(odd_vectors, k=9)
    assert len(first) == len([r for r in rows_of(odd_vectors) if r[1] and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])])
    assert first == got(odd_vectors.repartition(7), k=9)


def test_few_and_no_vectors(spark, odd_vectors):  # noqa: ANN001
    few = odd_vectors.where("vec_id in (7, 8, 9)").select("vec_id", "embedding")
    assert {r.cluster for r in centroids.cluster(few).collect()} <= set(range(few.count()))
    none = centroids.cluster(odd_vectors.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_huge_components_are_bounded(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    rows = centroids.cluster(df, k=1, rounds=0).collect()
    assert max(r.distance for r in rows) in (64 << 54, 64 << 56 if 64 << 56 < 1 << 63 else 0)


def test_dot_products_of_planes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-5000, 300, (30, 64)), rng.integers(-3, 90_000, (11, 64))
    pa, pb = centroids.planes_of(a), centroids.planes_of(b)
    assert (centroids.dots(pa, pb) == a @ b.T).all() and (centroids.values_of(pa) == a).all()
    zero = np.zeros((2, 64), dtype=np.int64)
    assert (centroids.dots(centroids.planes_of(zero), pb) == 0).all() and (centroids.values_of(centroids.planes_of(zero - 1)) == -1).all()
