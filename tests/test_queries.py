"""Every registered query of the engine against its twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from quaylens import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):  # noqa: ANN001, ANN201
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, data, name):  # noqa: ANN001
    df = plans.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(([repr(plain(r[c])) for c in columns] for r in df.collect()))
    assert rows or name == "q_recall_scan", "no rows"
    if name in plans.ORACLE:
        found = duck.execute(plans.ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        expected = sorted([repr(plain(r[names.index(c)])) for c in columns] for r in found.fetchall())
        assert rows == expected


def test_every_twin_has_its_query():
    assert set(plans.ORACLE) <= set(plans.QUERIES)
