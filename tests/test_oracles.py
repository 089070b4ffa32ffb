"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUILLGRAPH_TESTDATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
SLOW = {"communities"}


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(repr(tuple(plain(x) for x in r)) for r in duck.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
