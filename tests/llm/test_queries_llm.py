import os

import duckdb
import pytest

from gridscope.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(key(row[n]) for n in names) for row in got.collect()) == sorted(tuple(map(key, row)) for row in r.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encode":
            assert out.columns == docs.columns
        assert out.count() > 0
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0
        docs = out
