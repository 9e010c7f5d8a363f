"""Fixtures with the cases that every corpus operator must bear."""

from __future__ import annotations

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, node long, word string, score double, label string, slot long, _id long, gram long, _gone long, _doc long, _lines long, n_lines long, n_removed long, _own_n_lines long, _wanted long, _best long, _own_score double, _kept long, _of long, check long, owner long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    out = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + 12]) for i in range(0, n, 12))


def rows():  # noqa: ANN201
    long = prose(1, 30_000)
    near = prose(2, 300)
    texts = [
        (1, None, "s1"),
        (2, "", "s1"),
        (3, " \n\t ", "s2"),
        (4, "one", "s1"),
        (5, "one two", None),
        (6, long, "s2"),
        (7, prose(3, 200), "s1"),
        (8, prose(3, 200), "s2"),
        (8, prose(3, 200), "s2"),
        (9, near, "s3"),
        (10, near + " tail", "s4"),
        (11, near.replace("alpha", "ALPHA"), "s5"),
        (None, prose(4, 100), "s1"),
        (None, None, None),
        (12, "é ü 漢字 \U0001f600 " * 20, "s1"),
        (12, "other text under one id", "s1"),
        (13, "word " * 500, "s1"),
        (14, "x" * 60_000, "s3"),
    ]
    return [(i, t, "en", s, -1, 7, "w", 0.5, "l", 3, 4, 5, 1, 2, 3, 777, 888, 4, 5, 6, 0.25, 7, 8, 9, 10) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: ANN001, ANN201
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows(), DDL).repartition(3)


@pytest.fixture(scope="session")
def none(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def documents(spark, data):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{data}/labels.parquet")
