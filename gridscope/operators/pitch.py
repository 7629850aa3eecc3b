"""Pitch, residuals and distortion of point sets, and lattice profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import clean, materialised, median
from gridscope.operators.joins import lattice_neighbours
from gridscope.operators.spatial import nearest_k
from gridscope.operators.stats import interval_profile, quantiles, residual_map, robust_pitch
from gridscope.operators.windows import gaussian_smooth, gap_clusters, integrate, running_mean_lines


def _vectors(points: DataFrame, k: int, group: Sequence[str]) -> DataFrame:
    near = nearest_k(points, points, k, group, exclude_self=True)
    a = points.select(*group, F.col("id").alias("query_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(*group, F.col("id").alias("target_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = near.join(a, [*group, "query_id"]).join(b, [*group, "target_id"])
    return j.select(*group, (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))


def knn_pitch(points: DataFrame, k: int = 8, theta: float = 15, least: float = 0.5, most: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Median |dx| of the k nearest neighbours' vectors that point along x (within theta degrees), and |dy| along y."""
    v = _vectors(points, k, group)
    angle = F.degrees(F.atan2(F.abs("dy"), F.abs("dx")))
    length = F.hypot("dx", "dy")
    v = v.where((length >= least) & ((length <= most) if most else F.lit(True)))
    dx, dy = F.when(angle <= theta, F.abs("dx")), F.when(angle >= 90 - theta, F.abs("dy"))
    return v.groupBy(*group).agg(median(dx).alias("pitch_x"), median(dy).alias("pitch_y"), F.count(dx).alias("n_x"), F.count(dy).alias("n_y"))


def residual_to_grid(x: Column, pitch: Column, origin: Column) -> tuple[Column, Column]:
    """(index, residual) of a coordinate against origin + index * pitch, the index rounded half to even."""
    index = F.rint(F.try_divide(x - origin, pitch))
    return index.cast("long"), x - (origin + index * pitch)


def index_pitch(points: DataFrame, start: DataFrame, rounds: int = 2, trim: float = 0.35, group: Sequence[str] = ()) -> DataFrame:
    """(group, pitch_x, pitch_y, ox, oy, kept): pitch per axis refined by least squares on lattice indices.

    start: (group, pitch_x, pitch_y), one row per group.  Indices count from the 5th
    percentile of the coordinates.  Each round fits both axes to the points kept so far
    and then keeps those within ``trim`` pitches of both fits.  Groups with fewer than three
    points left, and an axis whose points all have one index, keep what they had.
    Only the groups' rows are kept between rounds; points are read once a round.
    """
    by, base = list(group), points.select(*group, "x", "y")

    def meet(rows: DataFrame, small: DataFrame) -> DataFrame:
        return rows.join(small, by) if by else rows.crossJoin(F.broadcast(small))  # one row

    def index(c: str, k: int | None = None) -> Column:
        return residual_to_grid(F.col(c), F.col(f"pitch_{c}" if k is None else f"__p{k}{c}"), F.col(f"__{c}0"))[0].cast("double")

    def kept(rounds: int) -> Column:
        """Whether all rounds so far keep a point: their fits lie in its group's row, so points are never written."""
        keep = F.lit(True)
        for k in range(rounds):
            within = F.lit(True)
            for c in "xy":
                left = F.abs(F.col(c) - (F.col(f"__c{k}{c}") + F.col(f"__s{k}{c}") * index(c, k)))
                within = within & F.coalesce(left <= F.abs(f"__s{k}{c}") * trim, F.lit(True))
            keep = keep & (within | (F.col(f"__n{k}") < 3))
        return keep

    first = quantiles(base, ["x", "y"], 0.05, by).select(*by, F.col("x").alias("__x0"), F.col("y").alias("__y0"))
    now = materialised(meet(start.select(*by, "pitch_x", "pitch_y"), first).withColumns({"ox": F.col("__x0"), "oy": F.col("__y0")}))
    for k in range(rounds):
        p = meet(base, now).withColumns({f"__i{c}": index(c) for c in "xy"}).withColumn("__keep", kept(k))
        keep, few = F.col("__keep"), F.count_if("__keep") < 3
        aggs = [F.count_if(keep).alias(f"__n{k}")]
        for c in "xy":
            i, v = F.when(keep, F.col(f"__i{c}")), F.when(keep, F.col(c))
            fine = (F.min(i) < F.max(i)) & ~few
            aggs += [F.when(fine, F.regr_slope(v, i)).alias(f"__s{k}{c}"), F.when(fine, F.regr_intercept(v, i)).alias(f"__c{k}{c}")]
        now = meet(now, p.groupBy(*by).agg(*aggs)).withColumns({f"__p{k}{c}": F.col(f"pitch_{c}") for c in "xy"})
        new = {f"pitch_{c}": F.coalesce(f"__s{k}{c}", f"pitch_{c}") for c in "xy"} | {f"o{c}": F.coalesce(f"__c{k}{c}", f"o{c}") for c in "xy"}
        now = materialised(now.withColumns(new))
    out = now.select(*by, "pitch_x", "pitch_y", "ox", "oy")
    if not rounds:
        return out.withColumn("kept", F.lit(None).cast("long"))
    return meet(out, meet(base, now).groupBy(*by).agg(F.count_if(kept(rounds)).alias("kept")))


def line_pitches(points: DataFrame, tol: float = 1.5, least: int = 3, group: Sequence[str] = ()) -> DataFrame:
    """Lines by running means of y, each line's robust pitch along x; null for lines of few points."""
    lines = running_mean_lines(points, "y", tol, group).drop("n")
    p = points.join(lines, [*group, "y"])
    size = p.groupBy(*group, "line").agg(F.count("*").alias("n"), F.avg("y").alias("center"))
    pitch = robust_pitch(p, "x", [*group, "line"])
    return size.join(pitch, [*group, "line"], "left").withColumn("pitch", F.when(F.col("n") >= least, F.col("pitch")))


def histogram_pitches(points: DataFrame, lines: DataFrame, tol: float, limit: float = 0.25, group: Sequence[str] = ()) -> DataFrame:
    """The other line method: points go to histogram lines within tol, plain medians, lines of uneven pitch (CV over the limit) go."""
    near = points.withColumn("__b", F.explode(F.array(*[F.floor(F.col("y") / tol) + i for i in (-1, 0, 1)])))
    j = near.join(lines.withColumn("__b", F.floor(F.col("center") / tol)), [*group, "__b"]).where(F.abs(F.col("y") - F.col("center")) <= tol)
    w = Window.partitionBy(*group, "id").orderBy(F.abs(F.col("y") - F.col("center")), "line")
    own = j.withColumn("__k", F.row_number().over(w)).where("__k = 1")
    d = own.withColumn("d", F.col("x") - F.lag("x").over(Window.partitionBy(*group, "line").orderBy("x", "id"))).where("d > 0")
    got = d.groupBy(*group, "line").agg(median(F.col("d")).alias("pitch"), F.count("*").alias("n"), F.try_divide(F.stddev_pop("d"), F.avg("d")).alias("cv"))
    return got.where(F.col("cv") <= limit)


def line_residuals(points: DataFrame, threshold: float = 10, pitch: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Residuals of x against each line's straight fit on lattice indices; null for lines of fewer than two.

    The pitch is given or the median of all neighbouring differences within lines.
    """
    lines = gap_clusters(points, "y", threshold, group, "line")
    w = Window.partitionBy(*group, "line").orderBy("x", "id")
    lines = lines.withColumn("__d", F.col("x") - F.lag("x").over(w)).withColumn("__x0", F.min("x").over(Window.partitionBy(*group, "line")))
    if pitch is None:
        p = lines.groupBy(*group).agg(median(F.col("__d")).alias("__p"))
        lines = lines.join(p, list(group)) if group else lines.crossJoin(F.broadcast(p))  # one row
    else:
        lines = lines.withColumn("__p", F.lit(float(pitch)))
    lines = lines.withColumn("index", F.rint(F.try_divide(F.col("x") - F.col("__x0"), F.col("__p"))).cast("long"))
    fit = lines.groupBy(*group, "line").agg(
        F.count("*").alias("__n"), F.min("index").alias("__a"), F.max("index").alias("__z"), F.regr_slope("x", F.col("index").cast("double")).alias("__s"), F.regr_intercept("x", F.col("index").cast("double")).alias("__i"), F.avg("x").alias("__mx")
    )
    flat = F.col("__a") == F.col("__z")
    j = lines.join(fit, [*group, "line"])
    model = F.when(flat, F.col("__mx")).otherwise(F.col("__i") + F.col("__s") * F.col("index"))
    return j.select(*group, "id", "x", "y", "line", "index", F.when(F.col("__n") >= 2, F.col("x") - model).alias("residual"))


def distortion_field(cloud: DataFrame, bin_width: float, sigma_x: float = 3, sigma_row: float = 1.5) -> DataFrame:
    """(line, bin, value): the residual map, smoothed along x within lines, then across lines within bins."""
    m = residual_map(cloud, bin_width)
    along = gaussian_smooth(m, "value", "bin", sigma_x, ["line"], "n").withColumnRenamed("smooth", "value")
    return gaussian_smooth(along, "value", "line", sigma_row, ["bin"]).withColumnRenamed("smooth", "value")


def field_lookup(field: DataFrame, wanted: DataFrame, bin_width: float, x0: float) -> DataFrame:
    """Bilinear values at (id, x, line), line fractional: two rows interpolated in x, then blended; a missing side leaves the other."""
    w = wanted.withColumn("__u", (F.col("x") - x0) / bin_width - 0.5)
    w = w.withColumn("__b", F.floor("__u")).withColumn("__t", F.col("__u") - F.floor("__u")).withColumn("__l", F.floor("line")).withColumn("__s", F.col("line") - F.floor("line"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    c = w.select("id", "__b", "__t", "__l", "__s", corner)
    wt = F.when(F.col("c.i") == 0, 1 - F.col("__t")).otherwise(F.col("__t")) * F.when(F.col("c.j") == 0, 1 - F.col("__s")).otherwise(F.col("__s"))
    c = c.select("id", (F.col("__b") + F.col("c.i")).alias("bin"), (F.col("__l") + F.col("c.j")).alias("line"), wt.alias("wt"))
    j = c.join(field.where(clean(F.col("value")).isNotNull()).select("bin", F.col("line").cast("long").alias("line"), "value"), ["bin", "line"])
    got = j.groupBy("id").agg(F.try_divide(F.sum(F.col("wt") * F.col("value")), F.sum("wt")).alias("value"))
    return wanted.select("id").join(got, "id", "left")


def lattice_profile(lattice: DataFrame, axis: str, group: Sequence[str] = (), rows: tuple[int, int] | None = None, nominal: float | None = None, reference: int = 0) -> DataFrame:
    """(group, node, pitch, sd, pairs, distance, registration): neighbour pitches along an axis, integrated from a node.

    lattice: (group, row, col, x, y), holes of a band of the other index if one is given.
    """
    other = "row" if axis == "x" else "col"
    node = "col" if axis == "x" else "row"
    l = lattice if rows is None else lattice.where(F.col(other).between(*rows))  # noqa: E741
    pairs = lattice_neighbours(l, axis, [axis], group).withColumn("step", F.col(f"next_{axis}") - F.col(axis))
    prof = interval_profile(pairs, node, "step", group).withColumnRenamed(node, "node")
    ends = l.groupBy(*group).agg(F.max(node).alias("__n"))
    nodes = ends.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long"))).alias("node"))
    p = nodes.join(prof, [*group, "node"], "left")
    mean = pairs.groupBy(*group).agg(F.avg("step").alias("__nominal"))
    p = p.join(mean, list(group), "left") if group else p.crossJoin(F.broadcast(mean))  # one row
    if nominal is not None:
        p = p.withColumn("__nominal", F.lit(float(nominal)))
    p = p.withColumn("__ref", F.lit(reference)).withColumn("__off", F.col("pitch") - F.col("__nominal"))
    p = integrate(p, "pitch", "node", "__ref", group).withColumnRenamed("distance", "__distance")
    p = integrate(p, "__off", "node", "__ref", group)
    return p.select(*group, "node", "pitch", "sd", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.col("__distance").alias("distance"), F.col("distance").alias("registration"))
