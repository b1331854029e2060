"""Every query held against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from grafonda.plans import catalogue

TABLES = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(TABLES):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, TABLES)
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    got = Counter(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    assert not catalogue.queries()[name](spark, TABLES).isEmpty()
