"""Aggregations: robust pitch, spreads, paired comparisons, histograms, maps and profiles.

Medians and percentiles are exact (linear interpolation), standard deviations say in
their names whether they divide by n - 1 (sd, _samp) or n (_pop), and nulls are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import clean, median, safe_corr, steady_mean
from gridscope.operators.windows import gap_clusters


def quantiles(df: DataFrame, columns: Sequence[str], q: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, columns): exact quantiles with linear interpolation, as F.percentile gives them, by counting and sorting values.

    F.percentile holds a group's distinct values in a map of one task; these are sorted and spilled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("e")
    counts = df.select(*group, each).select(*group, "e.i", "e.v").groupBy(*group, "i", "v").agg(F.count("v").alias("n"))
    w = Window.partitionBy(*group, "i").orderBy("v")  # nulls come first and count nothing
    ranks = counts.withColumn("stop", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranks = ranks.withColumn("at", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1) * q)
    holds = lambda k: F.max(F.when((F.col("stop") - F.col("n") <= k) & (k < F.col("stop")), F.col("v")))
    low, high = F.floor("at"), F.ceil("at")
    got = ranks.groupBy(*group, "i").agg(holds(low).alias("a"), holds(high).alias("b"), F.first("at").alias("at"))
    v = F.when(low == high, F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    return got.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, v)).alias(c) for i, c in enumerate(columns)])


def component_stats(labels: DataFrame) -> DataFrame:
    """Box, area and centroid of each label of each page; label 0 is the background."""
    x, y = F.col("x"), F.col("y")
    return labels.groupBy("page", "label").agg(
        F.min(x).alias("bx"), F.min(y).alias("by"), (F.max(x) - F.min(x) + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"),
        F.count("*").alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
    )


def cell_means(cell_pixels: DataFrame) -> DataFrame:
    """Mean intensity: sum of the original pixels over the cell's area."""
    return cell_pixels.groupBy("page", "seed_id").agg((F.sum("v") / F.count("*")).alias("mean_intensity"), F.count("*").alias("area"))


def bounding_box(points: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*group).agg(*[f(clean(F.col(c))).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])


def robust_pitch(coords: DataFrame, x: str, group: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Median of neighbouring differences within 3 MAD of their median (of all, if the MAD is under 1e-12)."""
    w, all_of = Window.partitionBy(*group).orderBy(x, *order), Window.partitionBy(*group)
    d = coords.withColumn("d", F.col(x) - F.lag(x).over(w)).where("d IS NOT NULL").select(*group, "d")
    # one shuffle: the differences, both medians and the result share the groups' partitioning
    off = d.withColumn("off", F.abs(F.col("d") - median(F.col("d")).over(all_of)))
    kept = off.withColumn("mad", median(F.col("off")).over(all_of)).where("mad < 1e-12 OR off <= 3 * mad")
    return kept.groupBy(*group).agg(median(F.col("d")).alias("pitch"), F.count("*").alias("kept"))


def line_pitch(points: DataFrame, threshold: float = 0.5, group: Sequence[str] = ()) -> DataFrame:
    """Lines by gaps in y, then each line's robust pitch along x."""
    lines = gap_clusters(points, "y", threshold, group, "line")
    size = lines.groupBy(*group, "line").agg(F.count("*").alias("n"), F.avg("y").alias("center"))
    return size.join(robust_pitch(lines, "x", [*group, "line"]), [*group, "line"])


def line_offsets(cloud: DataFrame, group: Sequence[str] = ("line",)) -> DataFrame:
    """Median residual and count of each line's finite rows."""
    return cloud.where(clean(F.col("residual")).isNotNull()).groupBy(*group).agg(median(F.col("residual")).alias("offset"), F.count("*").alias("n"))


def residual_map(cloud: DataFrame, bin_width: float = 32, least: int = 1, group: Sequence[str] = ()) -> DataFrame:
    """Median and count of residuals per (line, x bin); the last bin is closed; bins under the count are null."""
    ok = cloud.where(clean(F.col("residual")).isNotNull() & clean(F.col("x")).isNotNull())
    ends = ok.groupBy(*group).agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    j = ok.join(ends, list(group)) if group else ok.crossJoin(F.broadcast(ends))  # one row
    bins = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("__hi") - F.col("__lo")) / bin_width))
    j = j.withColumn("bin", F.least(F.floor((F.col("x") - F.col("__lo")) / bin_width), bins - 1))
    return j.groupBy(*group, "line", "bin").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, median(F.col("residual"))).alias("value"))


def tile_medians(pixels: DataFrame, tile: int, usable: Column | None = None) -> DataFrame:
    """Median of each square tile's usable pixels; null if none is."""
    v = clean(F.col("v")) if usable is None else F.when(usable, clean(F.col("v")))
    return pixels.groupBy("page", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(median(v).alias("median"), F.count(v).alias("n"))


def interval_profile(pairs: DataFrame, index: str, value: str, group: Sequence[str]) -> DataFrame:
    """Count, mean and sample standard deviation of the pitches of each interval."""
    return pairs.groupBy(*group, index).agg(F.count(value).alias("pairs"), F.avg(value).alias("pitch"), F.stddev_samp(value).alias("sd"))


def spread(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """n, mean, sd and 3 sd in per cent of the mean, of valid rows."""
    v = clean(F.col(value))
    got = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return got.withColumn("three_sigma_pct", F.try_divide(F.col("sd") * 300, F.col("mean")))


def spread_between(df: DataFrame, value: str, image: Sequence[str], run: Sequence[str]) -> DataFrame:
    """The same over image means: holes to images, images to the run."""
    means = df.groupBy(*run, *image).agg(F.avg(clean(F.col(value))).alias("__mean"))
    return spread(means, "__mean", run)


def _paired(a: Column, b: Column) -> list[Column]:
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    d = b - a
    sd = F.stddev_samp(d)
    return [
        F.count(d).alias("n"), F.avg(a).alias("mean_ref"), F.avg(b).alias("mean_cand"), F.avg(d).alias("bias"), median(d).alias("median_bias"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), sd.alias("sd_diff"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95_abs"),
        safe_corr(a, b).alias("r"), (F.avg(d) - sd * 1.96).alias("loa_low"), (F.avg(d) + sd * 1.96).alias("loa_high"),
    ]


def paired_statistics(pairs: DataFrame, ref: str, cand: str, group: Sequence[str]) -> DataFrame:
    """Bias, spread and agreement of the pairs that are finite on both sides; undefined figures are null."""
    return pairs.groupBy(*group).agg(*_paired(clean(F.col(ref)), clean(F.col(cand))))


def aggregate_comparisons(images: DataFrame, group: Sequence[str]) -> DataFrame:
    """Statistics of image means with equal weights, and pooled hole figures merged from (n, bias, mae, rmse, sd_diff).

    The pooled variance is the within part, (n - 1) sd^2, plus the between part, n (bias - pooled)^2.
    """
    ok = images.where("n > 0")
    n = F.col("n")
    first = ok.groupBy(*group).agg(
        *_paired(F.col("mean_ref"), F.col("mean_cand")), F.sum(n).alias("paired_holes"),
        (F.sum(n * F.col("bias")) / F.sum(n)).alias("pooled_bias"), (F.sum(n * F.col("mae")) / F.sum(n)).alias("pooled_mae"),
        F.sqrt(F.sum(n * F.col("rmse") * F.col("rmse")) / F.sum(n)).alias("pooled_rmse"),
        F.sum((n - 1) * F.coalesce(F.col("sd_diff"), F.lit(0.0)) * F.coalesce(F.col("sd_diff"), F.lit(0.0))).alias("__in"),
        F.sum(n * F.col("bias") * F.col("bias")).alias("__sq"),
    )
    between = F.greatest(F.col("__sq") - F.col("paired_holes") * F.col("pooled_bias") * F.col("pooled_bias"), F.lit(0.0))
    sd = F.when(F.col("paired_holes") > 1, F.sqrt(F.try_divide(F.col("__in") + between, F.col("paired_holes") - 1)))
    return first.withColumn("pooled_sd", sd).drop("__in", "__sq")


def matched_changes(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of matched holes (value_a, value_b, valid_a, valid_b): mean change, P99 of its size, and validity flips."""
    a, b = clean(F.col("value_a")), clean(F.col("value_b"))
    both = F.col("valid_a") & F.col("valid_b") & a.isNotNull() & b.isNotNull()
    d = F.when(both, b - a)
    return pairs.groupBy(*group).agg(
        F.count("*").alias("matched"), F.count(d).alias("valid_both"),
        F.count_if(F.col("valid_a") & ~F.col("valid_b")).alias("only_a_valid"), F.count_if(~F.col("valid_a") & F.col("valid_b")).alias("only_b_valid"),
        F.avg(d).alias("mean_change"), F.percentile(F.abs(d), F.lit(0.99)).alias("p99_abs_change"),
    )


def change_summary(pairs: DataFrame, group: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Largest, P99 and median change, how many pass the limit, and how many valid flags differ."""
    d = F.when(F.col("valid_a") & F.col("valid_b"), F.abs(clean(F.col("value_a")) - clean(F.col("value_b"))))
    return pairs.groupBy(*group).agg(
        F.max(d).alias("hole_max"), F.percentile(d, F.lit(0.99)).alias("hole_p99"), median(d).alias("hole_median"),
        F.count_if(d > limit).alias("holes_above"), F.count_if(F.col("valid_a") != F.col("valid_b")).alias("valid_changed"),
    )


def agreement(pairs: DataFrame, group: Sequence[str] = ("method_a", "method_b")) -> DataFrame:
    """Pearson r of every two methods, of more than two pairs with some spread."""
    a, b = clean(F.col("value_a")), clean(F.col("value_b"))
    return pairs.groupBy(*group).agg(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"), safe_corr(a, b, 3).alias("r"))


def page_values(measurements: DataFrame, methods: Sequence[str], key: str = "page") -> DataFrame:
    """One wide row per page: each method's valid count and mean."""
    v = F.when(F.col("valid"), clean(F.col("value")))
    return measurements.groupBy(key).pivot("method", list(methods)).agg(F.count(v).alias("valid"), F.avg(v).alias("mean"))


def median_row(measurements: DataFrame, methods: Sequence[str], key: str = "page") -> DataFrame:
    """One batch row per image: cells, and each method's valid count and median."""
    v = F.when(F.col("valid"), clean(F.col("value")))
    cells = measurements.groupBy(key).agg(F.count_distinct("cell_id").alias("cells"))
    wide = measurements.groupBy(key).pivot("method", list(methods)).agg(F.count(v).alias("valid"), median(v).alias("median"))
    return cells.join(wide, key)


def pitch_numbers(profiles: DataFrame, group: Sequence[str]) -> DataFrame:
    """Count-weighted mean pitch, pairs, and the lowest and highest placement error."""
    p, n = clean(F.col("pitch")), F.col("pairs")
    return profiles.groupBy(*group).agg(
        F.try_divide(F.sum(p * n), F.sum(n).cast("double")).alias("mean_pitch"), F.sum(n).alias("pairs"),
        F.min(clean(F.col("registration"))).alias("low"), F.max(clean(F.col("registration"))).alias("high"),
    )


def profile_summary(profiles: DataFrame, group: Sequence[str]) -> DataFrame:
    return profiles.groupBy(*group).agg(F.sum("pairs").alias("pairs"), F.avg(clean(F.col("pitch"))).alias("mean"), F.count_if(clean(F.col("pitch")).isNull()).alias("missing_intervals"))


def status_counts(measurements: DataFrame, group: Sequence[str] = ("method",)) -> DataFrame:
    return measurements.groupBy(*group, "status").agg(F.count("*").alias("n"))


def method_summary(measurements: DataFrame, group: Sequence[str] = ("method",)) -> DataFrame:
    """Valid, failed, median, mean and population sd of valid values."""
    v = F.when(F.col("valid"), clean(F.col("value")))
    return measurements.groupBy(*group).agg(
        F.count(v).alias("valid"), (F.count("*") - F.count(v)).alias("failed"), median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop")
    )


def failure_counts(measurements: DataFrame) -> DataFrame:
    """Failed holes per page and method, most first; methods without one have no row."""
    got = measurements.groupBy("page", "method").agg(F.count_if(~F.col("valid")).alias("failed")).where("failed > 0")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("failed"), F.desc("method"))))


def clipped_histogram(df: DataFrame, value: str, bins: int = 80, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Counts of equal bins between two percentiles, tails in the end bins, the top edge closed."""
    v = df.select(clean(F.col(value)).alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p")).select(
        F.when(F.col("p")[1] <= F.col("p")[0], F.col("p")[0] - 0.5).otherwise(F.col("p")[0]).alias("lo"),
        F.when(F.col("p")[1] <= F.col("p")[0], F.col("p")[1] + 0.5).otherwise(F.col("p")[1]).alias("hi"),
    )
    at = F.floor((F.greatest("lo", F.least("hi", "v")) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    got = v.crossJoin(ends).withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))  # one row of ends
    return got.groupBy("bin").agg(F.count("*").alias("n"), F.min("lo").alias("low"), F.min("hi").alias("high"))


def direction_peaks(slopes: DataFrame, slope: str, group: Sequence[str], bins: int = 140, limit: float = 0.35) -> DataFrame:
    """Peaks of a 5-wide smoothed slope histogram with at least a quarter of its maximum; the one nearest 0 first."""
    s = slopes.where(F.abs(F.col(slope)) <= limit).withColumn("bin", F.least(F.floor((F.col(slope) + limit) * bins / (2 * limit)), F.lit(bins - 1)).cast("int"))
    counts = s.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    every = s.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counts, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*group).orderBy("bin")
    full = full.withColumn("s", F.sum("n").over(w.rowsBetween(-2, 2)))
    full = full.withColumn("__p", F.lag("s", 1, 0).over(w)).withColumn("__q", F.lead("s", 1, 0).over(w)).withColumn("__m", F.max("s").over(Window.partitionBy(*group)))
    peaks = full.where("s >= __p AND s > __q AND s * 4 >= __m")
    center = (F.col("bin") + 0.5) * (2 * limit / bins) - limit
    return peaks.select(*group, "bin", F.col("s").alias("n"), center.alias("slope")).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.abs("slope"), "bin")))


def histogram_lines(points: DataFrame, coordinate: str, tol: float, least: int, group: Sequence[str] = ()) -> DataFrame:
    """Line centres from a histogram of about tol-wide bins: peaks of enough rows, those within tol merged by weight."""
    b = points.withColumn("bin", F.floor(F.col(coordinate) / tol))
    c = b.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg(coordinate).alias("mean"))
    w = Window.partitionBy(*group).orderBy("bin")
    near = lambda k: F.coalesce(F.when(F.abs(F.lag("bin", k).over(w) - F.col("bin")) == 1, F.lag("n", k).over(w)), F.lit(0))
    peaks = c.withColumn("__l", near(1)).withColumn("__r", near(-1)).where(F.col("n") >= least).where("n > __l AND n >= __r").select(*group, "bin", "n", "mean")
    merged = gap_clusters(peaks, "mean", tol, group, "line")
    return merged.groupBy(*group, "line").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("center"), F.sum("n").alias("n"))


def average_hole(samples: DataFrame, centers: DataFrame, radius: int, sub: int = 4, rounds: int = 1) -> DataFrame:
    """Mean of level-normalised pixels per sub-pixel bin around the hole centres: (bx, by, value, n).

    samples: (page, seed_id, x, y, v); centers: (page, seed_id, cx, cy).  Each round fits
    every hole's gain and offset to the mean so far by its normal equations.
    """
    d = samples.join(centers, ["page", "seed_id"])
    d = d.withColumn("bx", F.rint((F.col("x") - F.col("cx")) * sub).cast("int")).withColumn("by", F.rint((F.col("y") - F.col("cy")) * sub).cast("int"))
    d = d.where((F.abs("bx") <= radius * sub) & (F.abs("by") <= radius * sub)).select("page", "seed_id", "bx", "by", "v")
    level = d.groupBy("page", "seed_id").agg(F.avg("v").alias("offset"), F.stddev_pop("v").alias("gain")).where("gain > 0")
    for k in range(rounds + 1):
        flat = d.join(level, ["page", "seed_id"]).withColumn("u", (F.col("v") - F.col("offset")) / F.col("gain"))
        mean = flat.groupBy("bx", "by").agg(F.avg("u").alias("value"), F.count("*").alias("n"))
        if k == rounds:
            return mean
        t = d.join(mean.drop("n"), ["bx", "by"])
        level = t.groupBy("page", "seed_id").agg(F.regr_slope("v", "value").alias("gain"), F.regr_intercept("v", "value").alias("offset")).where("gain > 0")


def preview(pixels: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """Block means; trailing partial blocks go."""
    bx, by = F.floor(F.col("x") / factor), F.floor(F.col("y") / factor)
    inside = (bx < width // factor) & (by < height // factor)
    return pixels.where(inside).groupBy("page", bx.alias("bx"), by.alias("by")).agg(F.avg("v").alias("v"))


def stage_medians(timings: DataFrame, group: Sequence[str] = ("stage",)) -> DataFrame:
    """Median seconds of each stage, with the spread between its quartiles."""
    s = clean(F.col("seconds"))
    return timings.groupBy(*group).agg(F.count(s).alias("n"), median(s).alias("median"), (F.percentile(s, F.lit(0.75)) - F.percentile(s, F.lit(0.25))).alias("iqr"))


def truth_errors(matches: DataFrame, measured: str, truth: str, group: Sequence[str] = ("method",)) -> DataFrame:
    d = clean(F.col(measured)) - clean(F.col(truth))
    return matches.groupBy(*group).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95"))


def center_errors(points: DataFrame, error: str, group: Sequence[str]) -> DataFrame:
    """Standard, robust (1.4826 MAD) and worst deviation of centre errors from their mean, and the mean."""
    w = Window.partitionBy(*group)
    e = points.withColumn("__e", clean(F.col(error))).where("__e IS NOT NULL").withColumn("__d", F.col("__e") - F.avg("__e").over(w))
    e = e.withColumn("__m", F.percentile("__d", F.lit(0.5)).over(w))
    return e.groupBy(*group).agg(
        F.count("*").alias("n"), F.stddev_pop("__d").alias("sd_pop"), (median(F.abs(F.col("__d") - F.col("__m"))) * 1.4826).alias("robust"),
        F.max(F.abs("__d")).alias("worst"), F.avg("__e").alias("offset"),
    )


def phase_curve(points: DataFrame, truth: str, error: str, bins: int, least: int, group: Sequence[str]) -> DataFrame:
    """Mean error against the true centre's place inside its pixel, bins of enough rows only."""
    phase = F.col(truth) - F.rint(F.col(truth))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((phase + 0.5) * bins).cast("int")))
    return points.groupBy(*group, b.alias("bin")).agg(F.count("*").alias("n"), steady_mean(F.col(error)).alias("mean")).where(F.col("n") >= least)


def band_noise(pairs: DataFrame, columns: int, group: Sequence[str]) -> DataFrame:
    """RMS over (band of columns, row) of mean errors after taking each band's mean off; cells need half of their pairs.

    pairs: (group, row, col, error); only whole bands of the page count.
    """
    w = Window.partitionBy(*group)
    p = pairs.withColumn("__c0", F.min("col").over(w)).withColumn("__cols", F.max("col").over(w) - F.min("col").over(w) + 1)
    p = p.withColumn("band", F.floor((F.col("col") - F.col("__c0")) / columns)).where(F.col("band") < F.floor(F.col("__cols") / columns))
    e = clean(F.col("error"))
    cells = p.groupBy(*group, "band", "row").agg(F.avg(e).alias("m"), F.count(e).alias("n")).where(F.col("n") >= max(1, -(-columns // 2)))
    cells = cells.withColumn("d", F.col("m") - F.avg("m").over(Window.partitionBy(*group, "band")))
    return cells.groupBy(*group).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.count("*").alias("cells"))


def level_statistics(pixels: DataFrame, saturation: float, group: Sequence[str] = ("page",)) -> DataFrame:
    """Distinct levels, smallest and greatest common step between them, and the share at the lowest and saturated levels."""
    levels = pixels.groupBy(*group, "v").agg(F.count("*").alias("n"))
    gap = F.col("v") - F.lag("v").over(Window.partitionBy(*group).orderBy("v"))
    levels = levels.withColumn("gap", gap.cast("long"))
    gaps = levels.groupBy(*group).agg(
        F.count("*").alias("levels"), F.sum("n").alias("pixels"), F.collect_set("gap").alias("gaps"), F.sum(F.when(F.col("v") >= saturation, F.col("n")).otherwise(0)).alias("saturated")
    )
    gcd = F.aggregate(
        "gaps", F.lit(0).cast("long"),
        # Euclid's steps on (a, b); 64-bit numbers need at most 92, small level gaps far fewer
        lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))["a"],
    )
    return gaps.select(*group, "levels", "pixels", gcd.alias("step"), F.try_divide(F.col("saturated").cast("double"), F.col("pixels")).alias("saturated_share"))


def noise_line(pixels: DataFrame, level: str, residual: str, bins: int = 12, least: int = 200, group: Sequence[str] = ()) -> DataFrame:
    """Noise variance against level: (1.4826 MAD)^2 per quantile bin and the straight line through them; the mean alone with fewer than three bins."""
    e = pixels.groupBy(*group).agg(F.percentile(level, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("__e"))
    p = pixels.join(e, list(group)) if group else pixels.crossJoin(F.broadcast(e))  # one row
    p = p.withColumn("bin", F.size(F.filter("__e", lambda x: x <= F.col(level))) - 1).where(F.col("bin") < bins)
    mid = p.groupBy(*group, "bin").agg(median(F.col(residual)).alias("__m"), F.count("*").alias("n")).where(F.col("n") > least)
    p = p.join(mid, [*group, "bin"])
    got = p.groupBy(*group, "bin").agg(F.avg(level).alias("x"), median(F.abs(F.col(residual) - F.col("__m"))).alias("__mad"))
    got = got.withColumn("y", F.col("__mad") * F.col("__mad") * (1.4826 * 1.4826))
    return got.groupBy(*group).agg(
        F.when(F.count("*") >= 3, F.greatest(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("slope"),
        F.when(F.count("*") >= 3, F.greatest(F.regr_intercept("y", "x"), F.avg("y") * 0.05)).otherwise(F.greatest(F.avg("y"), F.lit(1e-3))).alias("intercept"), F.count("*").alias("bins"),
    )


def display_levels(pixels: DataFrame, stride: int = 1, group: Sequence[str] = ("page",)) -> DataFrame:
    """P1 and P99 of a strided sample of pixels, which is the feature: display levels needn't see all."""
    some = pixels.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    p = F.percentile(clean(F.col("v")), F.array(F.lit(0.01), F.lit(0.99)))
    return some.groupBy(*group).agg(p.alias("p")).select(*group, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def fit_comparison(fits: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Images with both fits: mean and largest absolute difference."""
    d = F.abs(clean(F.col(a)) - clean(F.col(b)))
    return fits.groupBy(*group).agg(F.count(d).alias("images"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"))


def otsu_threshold(pixels: DataFrame, value: str = "byte", group: Sequence[str] = ("page",)) -> DataFrame:
    """Level 0..255 with the greatest between-class variance, the lowest on ties: a histogram and two running sums."""
    h = pixels.groupBy(*group, F.col(value).cast("long").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy("level")
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("n") * F.col("level")
    h = h.select(*group, "level", F.sum("n").over(run).alias("c"), F.sum(mass).over(run).alias("s"), F.sum("n").over(whole).alias("ca"), F.sum(mass).over(whole).alias("sa"))
    gap = F.try_divide(F.col("s").cast("double"), F.col("c")) - F.try_divide((F.col("sa") - F.col("s")).cast("double"), F.col("ca") - F.col("c"))
    between = F.col("c").cast("double") * (F.col("ca") - F.col("c")) * gap * gap
    h = h.withColumn("between", F.coalesce(between, F.lit(-1.0)))
    return h.groupBy(*group).agg(F.max_by("level", F.struct(F.round("between", 6), -F.col("level"))).alias("threshold"))


def weighted_centroid(cell_pixels: DataFrame, background: DataFrame, keys: Sequence[str] = ("page", "seed_id")) -> DataFrame:
    """Centroid weighed by max(v - background, 0); the plain mean where all weights are 0."""
    p = cell_pixels.join(background, list(keys))
    wt = F.greatest(F.col("v") - F.col("background"), F.lit(0.0))
    got = p.groupBy(*keys).agg(F.sum(wt).alias("w"), F.sum(wt * F.col("x")).alias("wx"), F.sum(wt * F.col("y")).alias("wy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    at = lambda c: F.when(F.col("w") > 0, F.try_divide(F.col(f"w{c}"), F.col("w"))).otherwise(F.col(f"m{c}"))
    return got.select(*keys, at("x").alias("cx"), at("y").alias("cy"))


def polygon_area(vertices: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Shoelace area, extents and perimeter of closed outlines given by ordered vertices."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertices.select(*keys, "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"n{c}") for c in "xy"])
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    got = v.groupBy(*keys).agg(
        (F.abs(F.sum(cross)) / 2).alias("area"), (F.max("x") - F.min("x")).alias("cd_x"), (F.max("y") - F.min("y")).alias("cd_y"),
        F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"),
    )
    return got.withColumn("cd_equivalent", F.sqrt(F.col("area") / F.pi()) * 2)


def contour_rays(vertices: DataFrame, keys: Sequence[str], rays: int = 16) -> DataFrame:
    """Mean radius of each outline's vertices in equal sectors around its vertex mean: (keys, ray, radius, n)."""
    c = vertices.groupBy(*keys).agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    v = vertices.join(c, list(keys))
    dx, dy = F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")
    turn = F.atan2(dy, dx) / (2 * F.pi()) * rays
    ray = F.pmod(F.floor(turn + 0.5), F.lit(rays)).cast("int")
    return v.groupBy(*keys, ray.alias("ray")).agg(F.avg(F.hypot(dx, dy)).alias("radius"), F.count("*").alias("n"))


def moment_widths(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long and short widths of the ellipse with the vertices' second moments, and the long axis' angle in degrees."""
    m = vertices.groupBy(*keys).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    mean, gap = (F.col("xx") + F.col("yy")) / 2, F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    # vertices on an ellipse of semi-axis a have variance a^2 / 2 along it
    width = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * 2) * 2
    return m.select(*keys, width(mean + gap).alias("long"), width(mean - gap).alias("short"), F.degrees(F.atan2(F.col("xy") * 2, F.col("xx") - F.col("yy")) / 2).alias("angle"))
