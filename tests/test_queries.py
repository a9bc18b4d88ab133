"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from ledgerlynx import plans

SF = "/root/testdata/sf0.001"


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    found = duck.sql(plans.ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert [found.columns[i] for i in order] == columns
    assert got == sorted(tuple(shown(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in found.fetchall())
