"""Spectra of series: fast transforms of even samples, sums over samples at any frequencies for uneven ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope import ship
from gridscope.functions import clean, finite, median
from gridscope.operators.windows import interpolate

TWO_PI = 6.283185307179586


def resample_uniform(samples: DataFrame, x: str = "x", y: str = "y", group: Sequence[str] = (), dx: float | None = None) -> DataFrame:
    """(group, k, x, y) on x0 + k dx up to the last sample; dx is the median positive gap unless given."""
    ok = samples.where(finite(F.col(x)) & finite(F.col(y))).select(*group, F.col(x).alias("x"), F.col(y).alias("y"))
    w = Window.partitionBy(*group).orderBy("x")
    gap = F.col("x") - F.lag("x").over(w)
    step = ok.withColumn("__g", gap).groupBy(*group).agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), median(F.when(F.col("__g") > 0, F.col("__g"))).alias("__dx"))
    if dx is not None:
        step = step.withColumn("__dx", F.lit(float(dx)))
    n = F.floor(F.try_divide(F.col("__x1") - F.col("__x0"), F.col("__dx")) + 1e-9)
    grid = step.where("__dx > 0").select(*group, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("k"), "__x0", "__dx")
    grid = grid.select(*group, "k", (F.col("__x0") + F.col("k") * F.col("__dx")).alias("x"))
    return grid.join(interpolate(ok, grid.select(*group, "x").distinct(), "x", "y", group), [*group, "x"]).select(*group, "k", "x", "y")


def detrend(series: DataFrame, y: str, x: str, mode: str, group: Sequence[str]) -> DataFrame:
    """y less nothing, its mean, or its straight line over x."""
    w = Window.partitionBy(*group)
    if mode == "none":
        return series
    if mode == "mean":
        return series.withColumn(y, F.col(y) - F.avg(y).over(w))
    s = F.when(F.max(x).over(w) > F.min(x).over(w), F.try_divide(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))).otherwise(0.0)
    return series.withColumn(y, F.col(y) - F.avg(y).over(w) - s * (F.col(x) - F.avg(x).over(w)))


def dft_amplitudes(series: DataFrame, y: str, k: str, group: Sequence[str], dx: float = 1.0, window: str = "hann", keep_zero: bool = False) -> DataFrame:
    """(group, frequency, amplitude, period): one-sided amplitudes 2 |F| / sum w of evenly spaced samples; period is null at frequency 0.

    k counts the samples of a series from 0.  Each series is one task's fast transform, n log n
    for n samples; missing values count as 0.  Series of one sample have no frequency.
    """
    ship(series.sparkSession)
    src = series.select(*group, F.col(k).cast("long").alias("__k"), F.col(y).cast("double").alias("__y"))
    kind = T.StructType([*src.select(*group).schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("frequency", "amplitude", "period")]])

    def transform(part: pa.Table) -> pa.Table:
        at, v = part["__k"].to_numpy(), np.nan_to_num(part["__y"].to_numpy().astype(float))
        n = len(v)
        w = 0.5 - 0.5 * np.cos(TWO_PI * at / (n - 1)) if window == "hann" and n > 1 else np.ones(n)
        f = np.arange(0 if keep_zero else 1, n // 2 + 1 if n > 1 else 0)
        amplitude = 2 * np.abs(np.fft.rfft(np.bincount(at % n, w * v, n)))[f] / w.sum() if len(f) and w.sum() else np.full(len(f), np.nan)
        frequency = f / (n * dx)
        with np.errstate(divide="ignore"):
            period = 1 / frequency
        columns = [pa.array([part[g][0].as_py()] * len(f), part.schema.field(g).type) for g in group]
        return pa.Table.from_arrays([*columns, pa.array(frequency), pa.array(amplitude, mask=np.isnan(amplitude)), pa.array(period, mask=np.isinf(period))], names=kind.names)

    return src.groupBy(*group).applyInArrow(transform, kind)


def pitch_error_spectrum(samples: DataFrame, x: str, y: str, group: Sequence[str], dx: float | None = None, mode: str = "linear", window: str = "hann") -> DataFrame:
    """Resample, detrend, window, transform: amplitudes over frequency and period of each series."""
    u = resample_uniform(samples, x, y, group, dx)
    d = detrend(u, "y", "x", mode, group)
    step = u.groupBy(*group).agg(F.try_divide(F.max("x") - F.min("x"), F.max("k")).alias("__step"))
    got = dft_amplitudes(d, "y", "k", group, 1.0, window)
    j = got.join(step, list(group)) if group else got.crossJoin(F.broadcast(step))  # one row
    return j.select(*group, (F.col("frequency") / F.col("__step")).alias("frequency"), "amplitude", (F.col("period") * F.col("__step")).alias("period"))


def lomb_scargle(samples: DataFrame, x: str, y: str, frequencies: DataFrame, group: Sequence[str]) -> DataFrame:
    """Classical Lomb-Scargle power of mean-free samples at the given frequencies (column frequency), by closed-form sums.

    The frequencies are a fixed, small table and go to every sample; sums are combined map-side.
    """
    w = Window.partitionBy(*group)
    s = samples.select(*group, clean(F.col(x)).alias("x"), clean(F.col(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    s = s.withColumn("y", F.col("y") - F.avg("y").over(w)).crossJoin(F.broadcast(frequencies.select("frequency")))  # a fixed table of frequencies
    a = F.col("x") * F.col("frequency") * TWO_PI
    c, n, y_ = F.cos(a), F.sin(a), F.col("y")
    g = s.groupBy(*group, "frequency").agg(F.sum(y_ * c).alias("yc"), F.sum(y_ * n).alias("ys"), F.sum(c * c).alias("cc"), F.sum(n * n).alias("ss"), F.sum(c * n).alias("cs"), F.sum(y_ * y_).alias("yy"))
    tau = F.atan2(F.col("cs") * 2, F.col("cc") - F.col("ss")) / 2
    ct, st = F.cos(tau), F.sin(tau)
    yc, ys = F.col("yc") * ct + F.col("ys") * st, F.col("ys") * ct - F.col("yc") * st
    cc = ct * ct * F.col("cc") + ct * st * 2 * F.col("cs") + st * st * F.col("ss")
    ss = ct * ct * F.col("ss") - ct * st * 2 * F.col("cs") + st * st * F.col("cc")
    power = (F.coalesce(F.try_divide(yc * yc, cc), F.lit(0.0)) + F.coalesce(F.try_divide(ys * ys, ss), F.lit(0.0))) / 2
    return g.select(*group, "frequency", power.alias("power"), F.try_divide(F.lit(1.0), F.col("frequency")).alias("period"))


def apply_shift(pixels: DataFrame, dy: float, dx: float, width: int | None = None, height: int | None = None, order: int = 1, fill: float = 0.0) -> DataFrame:
    """Pages moved by (dy, dx): out(y, x) = in(y - dy, x - dx), bilinear or nearest; outside is the fill.

    Outside is what lies beyond the width and height; without them a page has whatever pixels it has.
    Each source pixel goes to the at most four places it adds to; no self-join.
    """
    if order == 0:
        dy, dx = float(round(dy)), float(round(dx))
    fy, fx = int(dy // 1), int(dx // 1)
    ty, tx = dy - fy, dx - fx
    taps = [(i, j, (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i in (0, 1) for j in (0, 1)]
    t = F.explode(F.array(*[F.struct(F.lit(fy + i).alias("i"), F.lit(fx + j).alias("j"), F.lit(float(w)).alias("w")) for i, j, w in taps if w])).alias("t")
    out = pixels.select("page", "x", "y", "v", t).select("page", (F.col("x") + F.col("t.j")).alias("x"), (F.col("y") + F.col("t.i")).alias("y"), (F.col("v") * F.col("t.w")).alias("v"), F.col("t.w").alias("w"))
    for c, size in (("x", width), ("y", height)):
        out = out if size is None else out.where(F.col(c).between(0, size - 1))
    out = out.groupBy("page", "x", "y").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    every = pixels.select("page", "x", "y").join(out, ["page", "x", "y"], "left")
    return every.select("page", "x", "y", F.when(F.col("w") > 1 - 1e-9, F.col("v")).otherwise(fill).alias("v"))


def overlap(ref: DataFrame, mov: DataFrame, dy: float, dx: float) -> DataFrame:
    """(page, x, y, ref, mov): pixels of the shared rectangle after a whole-pixel shift."""
    m = mov.select("page", (F.col("x") + round(dx)).alias("x"), (F.col("y") + round(dy)).alias("y"), F.col("v").alias("mov"))
    return ref.select("page", "x", "y", F.col("v").alias("ref")).join(m, ["page", "x", "y"])


def overlap_rmse(pairs: DataFrame) -> DataFrame:
    d = F.col("ref") - F.col("mov")
    return pairs.groupBy("page").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n"))
