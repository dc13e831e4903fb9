"""Every query that has SQL gives the rows DuckDB gives, on the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from notegrid.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = {n: f for m in registry.MODULES for n, f in m.QUERIES.items()}
ORACLE = {n: q for m in registry.MODULES for n, q in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = Counter(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    places = [rel.columns.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in places]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and len(df.collect()) >= 0
