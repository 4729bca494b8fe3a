"""Each query with an oracle against DuckDB on the smallest tables."""

import os

import pytest

from pathfold.plans import more, queries  # noqa: F401  more adds to the registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=key)
