"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridscope.plans import kernels, ordered  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return f"{float(v) + 0.0:.9g}" if not isinstance(v, (list, dict)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ordered.SQL))
def test_query_equals_sql(spark, duck, name):
    got = ordered.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    r = duck.execute(ordered.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    ours = sorted(tuple(norm(row[c]) for c in cols) for row in got.collect())
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
