"""Ordered sequences: gap clusters, running means, runs, prefix sums, smoothing, crossings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope import ship
from gridscope.functions import clean, finite


def gap_clusters(df: DataFrame, value: str, threshold: float, group: Sequence[str] = (), out: str = "cluster") -> DataFrame:
    """A new cluster where a sorted value is more than the threshold above the one before.

    Equal values share a cluster: the running count has a RANGE frame.  Distinct values
    are numbered first, so that only they, not all rows, go through one window.
    """
    keys = [*group, value]
    w = Window.partitionBy(*group).orderBy(value)
    steps = df.where(F.col(value).isNotNull()).select(*keys).distinct()
    jump = (F.col(value) - F.lag(value).over(w) > threshold).cast("int")
    steps = steps.withColumn("__new", F.coalesce(jump, F.lit(0)))
    run = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(steps.withColumn(out, F.sum("__new").over(run)).drop("__new"), keys)


def cluster_bounds(clustered: DataFrame, value: str, group: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Half-open index bounds [start, stop) of each cluster in the sorted values, its size and mean."""
    w = Window.partitionBy(*group).orderBy(cluster)
    got = clustered.groupBy(*group, cluster).agg(F.count("*").alias("n"), F.avg(value).alias("center"))
    stop = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n"))


def running_mean_lines(df: DataFrame, value: str, tol: float, group: Sequence[str] = ()) -> DataFrame:
    """Lines of sorted values: a value joins while it is within tol of the line's running mean, else begins the next.

    One row per (group, distinct value): n, line.  Each group's distinct values pass in
    order through one task, which holds a batch of them and the running line, nothing else.
    Of n equal values each sees the mean that those before it left: all join, or the
    first begins a line.
    """
    ship(df.sparkSession)
    counted = df.where(finite(F.col(value))).groupBy(*group, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))
    rows = counted.select(*group, value, "n")
    near = (rows.repartition(*group) if group else rows.repartition(1)).sortWithinPartitions(*group, value)
    kind = T.StructType([*rows.schema.fields, T.StructField("line", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, total, count = object(), 0, 0.0, 0
        for b in batches:
            keys = list(zip(*[c.to_pylist() for c in b.columns[:-2]])) if group else [()] * b.num_rows
            out = []
            for k, v, n in zip(keys, b.columns[-2].to_pylist(), b.columns[-1].to_pylist()):
                if k != key:
                    key, line, total, count = k, 0, 0.0, 0
                elif not abs(v - total / count) <= tol:
                    line, total, count = line + 1, 0.0, 0
                total, count = total + v * n, count + n
                out.append(line)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=kind.names)

    return near.mapInArrow(fold, kind)


def adjacent_differences(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def integrate(df: DataFrame, value: str, node: str, reference: str, group: Sequence[str] = ()) -> DataFrame:
    """Signed sums outward from a reference node: value at node i is the step from i to i + 1.

    distance(reference) = 0, forward steps add, backward steps subtract; a missing step
    interrupts everything beyond it.  Rows are nodes 0..m-1 of m steps.
    """
    f, b = [Window.partitionBy(*group).orderBy(o).rowsBetween(Window.unboundedPreceding, e) for o, e in ((F.col(node), -1), (F.col(node).desc(), 0))]
    ok = clean(F.col(value))
    after, before = F.col(node) >= F.col(reference), F.col(node) < F.col(reference)
    add = F.sum(F.when(after, ok)).over(f)
    gone = F.coalesce(F.max(F.when(after, ok.isNull())).over(f), F.lit(False))
    back = F.sum(F.when(before, ok)).over(b)
    lost = F.coalesce(F.max(F.when(before, ok.isNull())).over(b), F.lit(False))
    out = F.when(F.col(node) == F.col(reference), 0.0).when(after, F.when(~gone, add)).otherwise(F.when(~lost, -back))
    return df.withColumn("distance", out)


def true_runs(df: DataFrame, flag: str, position: str, group: Sequence[str] = ()) -> DataFrame:
    """Half-open runs [start, stop) of neighbouring positions where the flag holds."""
    w = Window.partitionBy(*group).orderBy(position)
    on = df.where(F.col(flag)).withColumn("__island", F.col(position) - F.row_number().over(w))
    return on.groupBy(*group, "__island").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop")).drop("__island")


def runs_to_rectangles(runs: DataFrame, cell: float, top: float, bottom: float, limit: float) -> DataFrame:
    """Runs of cells as rectangles (x0, y0, x1, y1), clipped to the limit; empty ones go."""
    x0, x1 = F.col("start") * cell, F.least(F.col("stop") * cell, F.lit(float(limit)))
    out = runs.withColumn("x0", x0.cast("double")).withColumn("y0", F.lit(float(top))).withColumn("x1", x1.cast("double")).withColumn("y1", F.lit(float(bottom)))
    return out.where("x1 > x0 AND y1 > y0")


def gaussian_smooth(df: DataFrame, value: str, position: str, sigma: float, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Normalised convolution along an integer position that passes over missing values; radius round(3 sigma).

    Every row goes to the places within the radius (a bounded fan-out), weighed by the
    kernel and, if given, by a support column; empty places stay empty only if nothing is near.
    """
    radius = max(1, round(3 * sigma))
    places = df.select(*group, position)
    k = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(pow(2.718281828459045, -d * d / (2 * sigma * sigma))).alias("k")) for d in range(-radius, radius + 1)]))
    src = df.where(finite(F.col(value))).select(*group, position, clean(F.col(value)).alias("__v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), k.alias("__k"))
    src = src.select(*group, (F.col(position) + F.col("__k.d")).alias(position), (F.col("__k.k") * F.col("__w")).alias("__kw"), "__v")
    sums = src.groupBy(*group, position).agg(F.sum(F.col("__kw") * F.col("__v")).alias("__a"), F.sum("__kw").alias("__b"))
    return places.join(sums, [*group, position], "left").select(*group, position, F.try_divide("__a", "__b").alias("smooth"))


def binomial5(df: DataFrame, value: str, group: Sequence[str], order: str) -> DataFrame:
    """1-4-6-4-1 smoothing with repeated edges."""
    w = Window.partitionBy(*group).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = lambda k: F.coalesce(F.lag(value, -k).over(w), first if k < 0 else last)
    return df.withColumn("smooth", (at(-2) + at(-1) * 4 + F.col(value) * 6 + at(1) * 4 + at(2)) / 16)


def best_window(pages: DataFrame, size: int, group: Sequence[str] = ("file",)) -> DataFrame:
    """The first page of the ``size`` neighbouring pages with most status ok, first on ties; all pages of a shorter file."""
    last = pages.groupBy(*group).agg(F.max("page").alias("__last"))
    every = last.select(*group, "__last", F.explode(F.sequence(F.lit(0), F.col("__last").cast("int"))).alias("page"))
    ok = pages.where("status = 'ok'").select(*group, F.col("page").cast("int").alias("page"), F.lit(1).alias("ok")).distinct()
    w = Window.partitionBy(*group).orderBy("page").rowsBetween(0, size - 1)
    counted = every.join(ok, [*group, "page"], "left").withColumn("n", F.sum(F.coalesce("ok", F.lit(0))).over(w))
    fits = counted.where((F.col("page") + size - 1 <= F.col("__last")) | (F.col("page") == 0))
    best = fits.groupBy(*group).agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("start"), F.max("n").alias("ok_pages"), F.max("__last").alias("__last"))
    return best.select(*group, "start", F.least(F.col("start") + size, F.col("__last") + 1).cast("int").alias("stop"), "ok_pages")


def half_height_width(profile: DataFrame, value: str, position: str, group: Sequence[str]) -> DataFrame:
    """Width between the half-height crossings nearest the peak, interpolated; null if a side has none."""
    w = Window.partitionBy(*group).orderBy(position)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = profile.withColumn("__half", (F.max(value).over(whole) + F.min(value).over(whole)) / 2)
    p = p.withColumn("__peak", F.max_by(position, F.struct(F.col(value), -F.col(position))).over(whole))
    p = p.withColumn("__v1", F.lead(value).over(w)).withColumn("__p1", F.lead(position).over(w))
    at = F.col(position) + (F.col("__half") - F.col(value)) * F.try_divide(F.col("__p1") - F.col(position), F.col("__v1") - F.col(value))
    left = (F.col("__p1") <= F.col("__peak")) & (F.col(value) < F.col("__half")) & (F.col("__v1") >= F.col("__half"))
    right = (F.col(position) >= F.col("__peak")) & (F.col(value) >= F.col("__half")) & (F.col("__v1") < F.col("__half"))
    got = p.groupBy(*group).agg(F.max(F.when(left, at)).alias("left"), F.min(F.when(right, at)).alias("right"))
    return got.withColumn("width", F.col("right") - F.col("left"))


def steepest_edges(profile: DataFrame, value: str, position: str, group: Sequence[str]) -> DataFrame:
    """Places of the steepest rise before and fall after the peak (first on ties), from neighbouring differences."""
    w = Window.partitionBy(*group).orderBy(position)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = profile.withColumn("__peak", F.max_by(position, F.struct(F.col(value), -F.col(position))).over(whole))
    p = p.withColumn("__d", F.lead(value).over(w) - F.col(value))
    rise, fall = (F.col(position) < F.col("__peak")) & (F.col("__d") > 0), (F.col(position) >= F.col("__peak")) & (F.col("__d") < 0)
    return p.groupBy(*group).agg(
        F.max_by(F.when(rise, F.col(position)), F.when(rise, F.struct(F.col("__d"), -F.col(position)))).alias("rise"),
        F.max_by(F.when(fall, F.col(position)), F.when(fall, F.struct(-F.col("__d"), -F.col(position)))).alias("fall"),
    )


def cycle_length(states: DataFrame, value: str, step: str, group: Sequence[str], longest: int = 8) -> DataFrame:
    """Smallest k (2..longest) for which the last three states repeat those k steps before within 5 % of their motion; 0: none."""
    w = Window.partitionBy(*group).orderBy(step)
    s = states.withColumn("__back", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(step).desc()))).withColumn("__n", F.count("*").over(Window.partitionBy(*group)))
    s = s.withColumns({f"__d{k}": F.abs(F.col(value) - F.lag(value, k).over(w)) for k in range(1, longest + 1)}).where("__back <= 3")
    got = s.groupBy(*group).agg(F.max("__n").alias("n"), *[F.max(f"__d{k}").alias(f"d{k}") for k in range(1, longest + 1)])
    found = F.coalesce(*[F.when((F.col("n") >= k + 3) & (F.col(f"d{k}") < F.col("d1") * 0.05), k) for k in range(2, longest + 1)], F.lit(0))
    return got.select(*group, F.when((F.col("n") >= 6) & (F.col("d1") > 0), found).otherwise(0).alias("cycle"))


def dense_positions(df: DataFrame, value: str, group: Sequence[str], out: str = "line") -> DataFrame:
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*group).orderBy(value)) - 1)


def within_index(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "k") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def first_by(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__k = 1").drop("__k")


def interpolate(samples: DataFrame, wanted: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation at wanted x, clamped to the end values: brackets found by one union and two windows.

    Both windows run from a group's end to the row, so that a row costs the same in a group of any size; of samples
    at one x the smallest y bounds what lies before it, the largest what lies after.
    """
    both = samples.where(finite(F.col(x)) & finite(F.col(y))).select(*group, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(False).alias("__ask"))
    both = both.unionByName(wanted.select(*group, F.col(x).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("__ask")))
    up = Window.partitionBy(*group).orderBy("x", "__ask", "y").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy(F.desc("x"), F.desc("__ask"), F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(~F.col("__ask"), F.struct("x", "y"))
    b = both.withColumn("__a", F.last(point, True).over(up)).withColumn("__b", F.last(point, True).over(down)).where("__ask")
    lo, hi = F.coalesce("__a", "__b"), F.coalesce("__b", "__a")
    t = F.coalesce(F.try_divide(F.col("x") - lo["x"], hi["x"] - lo["x"]), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return b.select(*group, "x", (lo["y"] + (hi["y"] - lo["y"]) * t).alias("y"))
