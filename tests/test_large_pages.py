"""Queries on tables with longer pages and groups than the smallest ones have, against their SQL in DuckDB."""

import duckdb
import pytest
from test_queries import norm

from gridscope.plans import ordered


def same_as_sql(spark, name, folder, *tables):
    duck = duckdb.connect()
    for x in tables:
        duck.execute(f"CREATE VIEW {x} AS SELECT * FROM '{folder}/{x}.parquet'")
    got = ordered.QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted(tuple(map(norm, row)) for row in duck.execute(f"SELECT {quoted} FROM ({ordered.SQL[name]})").fetchall())
    assert theirs == sorted(tuple(norm(row[c]) for c in cols) for row in got.collect())


@pytest.fixture
def embeddings(tmp_path):
    def make(rows, wide):
        value = f"[(hash(i, k) % 1000 / 1400 - 0.3)::FLOAT for k in range({wide})]"
        duckdb.execute(f"COPY (SELECT i AS vec_id, {value} AS embedding, (i % 11 = 10)::INT AS label FROM range({rows}) t(i)) TO '{tmp_path}/embeddings.parquet'")
        return tmp_path

    return make


def test_shifted_pages_have_any_height(spark, embeddings):
    same_as_sql(spark, "q8_apply_shift", embeddings(11_100, 5), "embeddings")


def test_average_hole_on_pages_of_over_a_thousand_rows(spark, embeddings):
    same_as_sql(spark, "e26_o4_average_hole", embeddings(1_300, 5), "embeddings")
