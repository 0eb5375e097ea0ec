"""Every registered query of the engine against its SQL twin in DuckDB, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quercus import queries as engine

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: [(x is None, str(type(x)), x if x is not None else 0) for x in t])


@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_same_rows(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in engine.SQL:
        return
    found = duck.execute(engine.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, found.fetchall())
