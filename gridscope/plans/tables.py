"""The driver's tables as points, pixels, measurements and timings: each input as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per order line: x along, y across, g a page."""
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rows.agg(
        (F.min("l_extendedprice") / 1000).alias("x"), F.min("l_quantity").alias("y"), (F.min("l_suppkey") % 7).alias("g"),
        F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"),
        F.min("l_partkey").alias("p"),
    )


POINTS = """pts AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_extendedprice) / 1000 AS x, min(l_quantity) AS y, min(l_suppkey) % 7 AS g,
  min(l_discount) AS d, min(l_tax) AS t, min(l_returnflag) AS rf, min(l_linestatus) AS ls, min(l_partkey) AS p FROM lineitem GROUP BY 1)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered points of customers: few enough for a brute-force oracle on the whole table."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 7919 % 1009 / 10).alias("y"), F.col("c_nationkey").cast("long").alias("nation"), F.lit(0).alias("page"))


SEEDS = "seeds AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey * 7919 % 1009) / 10 AS y, c_nationkey::BIGINT AS nation, 0 AS page FROM customer)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 6007 % 1009 / 10).alias("y"), F.lit(0).alias("page"))


TRUTH = "truth AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey * 6007 % 1009) / 10 AS y, 0 AS page FROM supplier)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per label: x is the place in the vector, y the rank of vec_id in its label, v a grey level."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").withColumn("y", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    p = e.select(F.col("label").alias("page"), "y", F.posexplode("embedding").alias("x", "e"))
    return p.select("page", F.col("x").cast("long").alias("x"), "y", F.rint(F.col("e").cast("double") * 200 + 100).alias("v"))


PIXELS = """e0 AS (SELECT label AS page, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS y, embedding FROM embeddings),
px AS (SELECT page, y, i::BIGINT AS x, round_even(embedding[i + 1]::DOUBLE * 200 + 100, 0) AS v FROM (SELECT page, y, embedding, unnest(range(len(embedding))) AS i FROM e0))"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three methods' values of each point: (page, cell_id, method, valid, status, value, x, y)."""
    p = points(spark, sf_dir)
    rows = [("a", F.col("x"), F.col("rf") != "R"), ("b", F.col("x") * (F.col("d") + 1), F.col("ls") == "O"), ("c", F.col("y") + F.col("t"), F.col("d") < 0.09)]
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), v.alias("value"), ok.alias("valid")) for n, v, ok in rows])).alias("m")
    m = p.select(F.col("g").alias("page"), F.col("id").alias("cell_id"), "x", "y", m).select("page", "cell_id", "x", "y", "m.method", "m.value", "m.valid")
    return m.withColumn("status", F.when(F.col("valid"), "ok").when(F.col("value") > 50, "no_signal").otherwise("singular_fit"))


MEASUREMENTS = POINTS + """, meas AS (SELECT *, CASE WHEN valid THEN 'ok' WHEN value > 50 THEN 'no_signal' ELSE 'singular_fit' END AS status FROM (
  SELECT g AS page, id AS cell_id, x, y, 'a' AS method, x AS value, rf <> 'R' AS valid FROM pts
  UNION ALL SELECT g, id, x, y, 'b', x * (d + 1), ls = 'O' FROM pts UNION ALL SELECT g, id, x, y, 'c', y + t, d < 0.09 FROM pts))"""


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points snapped to (rint y, rint x), one (the smallest id) per cell and page."""
    p = points(spark, sf_dir).withColumn("row", F.rint("y").cast("long")).withColumn("col", F.rint("x").cast("long"))
    best = F.min_by(F.struct("id", "x", "y"), "id").alias("b")
    return p.groupBy("g", "row", "col").agg(best).select("g", "row", "col", "b.id", "b.x", (F.col("b.y") + F.col("b.id") % 10 / 100).alias("y"))


LATTICE = POINTS + """, lat AS (SELECT g, r AS "row", c AS col, arg_min(id, id) AS id, arg_min(x, id) AS x, arg_min(y, id) + arg_min(id, id) % 10 / 100 AS y
  FROM (SELECT *, round_even(y, 0)::BIGINT AS r, round_even(x, 0)::BIGINT AS c FROM pts) GROUP BY ALL)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page timings of runs from events: a page per user, the last event counts."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("f").alias("file"), F.col("user_id").alias("page"), F.col("value").alias("measure_s"), F.col("event_id").alias("run_id"), F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("event_id") % 3).alias("gpu"), (F.col("event_id") % 5).alias("worker"),
    )


TIMINGS = """tm AS (SELECT 'f' AS file, user_id AS page, value AS measure_s, event_id AS run_id, event_type AS stage,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, event_id % 3 AS gpu, event_id % 5 AS worker FROM events)"""
