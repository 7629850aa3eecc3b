"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import clean, finite


def top_k(df: DataFrame, value: str, k: int, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The k rows with the largest finite values of each group, ranked; ties by the given columns."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), *tie)
    return df.where(finite(F.col(value))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def table_rank(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """Rank for display: missing numbers last both ways, ties by id."""
    key = clean(F.col(value))
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, tie)))


def top_mean(df: DataFrame, value: str, n: int, group: Sequence[str]) -> DataFrame:
    """Mean of the n largest finite values of each group."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc())
    some = df.where(finite(F.col(value))).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    return some.groupBy(*group).agg(F.avg(value).alias("top_mean"))


def quantile_pages(timings: DataFrame, count: int, group: Sequence[str] = ("file",)) -> DataFrame:
    """``count`` pages at evenly spaced places of the run times, extremes included; the last timing of a page counts."""
    ok = timings.where((F.col("status") == "ok") & finite(F.col("measure_s")) & (F.col("measure_s") >= 0) & (F.col("page") >= 0))
    last = ok.groupBy(*group, "page").agg(F.max_by("measure_s", "run_id").alias("measure_s"))
    w = Window.partitionBy(*group)
    placed = last.withColumn("at", F.row_number().over(w.orderBy("measure_s", "page")) - 1).withColumn("n", F.count("*").over(w))
    k = F.least(F.lit(count), F.col("n"))
    picks = F.when(k == 1, F.array(F.lit(0.0))).otherwise(
        F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.rint(F.try_divide(i * (F.col("n") - 1), (k - 1)).cast("double")))
    )
    return placed.where(F.array_contains(picks, F.col("at").cast("double"))).select(*group, "page", "measure_s")


def median_and_slowest(timings: DataFrame, group: Sequence[str] = ("file",)) -> DataFrame:
    """The page at place n div 2 of the run times, and the last."""
    w = Window.partitionBy(*group)
    t = timings.withColumn("__k", F.row_number().over(w.orderBy("measure_s", "page")) - 1).withColumn("__n", F.count("*").over(w))
    kind = F.when(F.col("__k") == F.floor(F.col("__n") / 2), "median").when(F.col("__k") == F.col("__n") - 1, "slowest")
    return t.withColumn("pick", kind).where("pick IS NOT NULL").drop("__k", "__n")


def first_pages_among_slowest(timings: DataFrame, count: int = 4) -> DataFrame:
    """How many of the slowest pages were some worker's first."""
    firsts = timings.groupBy("gpu", "worker").agg(F.min("page").alias("page")).select("page").distinct()
    slow = timings.orderBy(F.col("measure_s").desc(), F.col("page").desc()).limit(count)
    return slow.join(firsts, "page", "left_semi").agg(F.count("*").alias("first_pages"))


def best_of(results: DataFrame, group: str, need: str, noise: str, name: str) -> DataFrame:
    """The method of each group that needs least, then has the least noise, missing last."""
    big = F.lit(float("inf"))
    key = F.struct(F.coalesce(F.col(need).cast("double"), big), F.coalesce(clean(F.col(noise)), big), F.col(name))
    return results.groupBy(group).agg(F.min_by(name, key).alias("best"))


def reference_hole(lattice: DataFrame, group: Sequence[str]) -> DataFrame:
    """The indexed hole with the smallest (row, col)."""
    return lattice.where("row >= 0 AND col >= 0").groupBy(*group).agg(F.min_by("id", F.struct("row", "col", "id")).alias("reference"))


def nearest_hole(points: DataFrame, x: float, y: float, group: Sequence[str]) -> DataFrame:
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.groupBy(*group).agg(F.min_by("id", F.struct(d, F.col("id"))).alias("nearest"))


def settings_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose values differ between two (key, value) tables, missing ones too."""
    return (
        a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "key", "full_outer")
        .where(~F.col("a").eqNullSafe(F.col("b")))
    )
