"""Joins on keys: lattice neighbours, lookups, semi and anti joins, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lattice_neighbours(lattice: DataFrame, axis: str, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Pairs (row, col) -> (row, col + 1) for axis x or (row + 1, col) for y; a missing hole never makes a double pitch."""
    step = "col" if axis == "x" else "row"
    nxt = lattice.select(*group, *[(F.col(c) - 1).alias(c) if c == step else F.col(c) for c in ("row", "col")], *[F.col(c).alias(f"next_{c}") for c in columns])
    return lattice.join(nxt, [*group, "row", "col"])


def cell_values_to_pixels(labels: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Each labelled pixel gets its cell's value; label -1 and cells without one get null."""
    return labels.join(values.select("page", F.col("cell_id").alias("label"), value), ["page", "label"], "left")


def in_band(lattice: DataFrame, index: str, low: int, high: int) -> DataFrame:
    return lattice.where(F.col(index).between(low, high))


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("file", "page")) -> DataFrame:
    """What a finished run doesn't have yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def positional_zip(left: DataFrame, right: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The i-th row of one with the i-th of the other, as far as the shorter goes."""
    number = lambda d: d.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    a = number(left).withColumnsRenamed({c: f"ref_{c}" for c in left.columns if c not in group})
    b = number(right).withColumnsRenamed({c: f"mov_{c}" for c in right.columns if c not in group})
    return a.join(b, [*group, "position"])


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Counts by side of a full outer join: both, only one side, valid on one side only (column valid)."""
    a = left.select(*keys, F.col("valid").alias("__va"), F.lit(True).alias("__a"))
    b = right.select(*keys, F.col("valid").alias("__vb"), F.lit(True).alias("__b"))
    j = a.join(b, list(keys), "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.groupBy(*group).agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("__b").isNull()).alias("only_left"),
        F.count_if(F.col("__a").isNull()).alias("only_right"),
        F.count_if(both & F.col("__va") & F.col("__vb")).alias("both_valid"),
        F.count_if(both & F.col("__va") & ~F.col("__vb")).alias("only_left_valid"),
        F.count_if(both & ~F.col("__va") & F.col("__vb")).alias("only_right_valid"),
    )


def method_axis_rows(wide: DataFrame, keys: Sequence[str], axes: dict[str, str]) -> DataFrame:
    """One row per axis: (keys, axis, value) of columns that hold one axis each."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("value")) for a, c in axes.items()])).alias("r")
    return wide.select(*keys, rows).select(*keys, "r.axis", "r.value")


def method_pairs(measurements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every two methods of a cell, (method_a < method_b), with both values."""
    a = measurements.select(*keys, F.col("method").alias("method_a"), F.col("value").alias("value_a"))
    b = measurements.select(*keys, F.col("method").alias("method_b"), F.col("value").alias("value_b"))
    return a.join(b, list(keys)).where("method_a < method_b")


def numbered_pages(files: DataFrame, reverse: bool = False, group: Sequence[str] = ("stripe", "board")) -> DataFrame:
    """Pages of ordered files with a running index k; reversed, each file's pages count down."""
    page: Column = F.col("page").desc() if reverse else F.col("page")
    return files.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("vertical", page)) - 1)
