"""Every query with SQL gives the rows of that SQL on the smallest data."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    order = [r.columns.index(c) for c in df.columns]
    want = sorted(tuple(_plain(x[i]) for i in order) for x in r.fetchall())
    assert sorted(tuple(map(_plain, x)) for x in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
