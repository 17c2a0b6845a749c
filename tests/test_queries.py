"""Every query with SQL gives what DuckDB gives on the small tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from haploom.plans.queries import REGISTRY

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    run, sql = REGISTRY[name]
    df = run(spark, DATA)
    got = df.collect()
    if not sql:
        assert got
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(tuple(map(shown, r)) for r in got) == sorted(tuple(shown(r[i]) for i in at) for r in want)
