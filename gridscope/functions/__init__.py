"""Scalar expressions: one rule for missing numbers, rounding, guarded statistics, names and units."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clean(x: Column) -> Column:
    """x where finite, else null: every statistic starts from this."""
    return F.when(finite(x.cast("double")), x.cast("double"))


def safe_corr(a: Column, b: Column, least: int = 2) -> Column:
    """Pearson correlation of the pairs that are both present; null for under ``least`` pairs or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    ok = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)) & (F.count(a) >= least)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when(ok, F.try_divide(F.covar_pop(a, b), sa * sb))


def median(x: Column) -> Column:
    """Exact median with linear interpolation."""
    return F.percentile(x, F.lit(0.5))


def exact_sum(x: Column) -> Column:
    """Decimal sum of the numbers' shortest decimals; null if 38 digits, 24 of them behind the point, don't hold all of them exactly."""
    d = x.cast("double").try_cast("decimal(38,24)")
    return F.when(F.count_if(d.cast("double") == x) == F.count(x), F.try_sum(d))


def steady_mean(x: Column) -> Column:
    """Mean whose last digit doesn't depend on the order of the rows, by exact_sum; the plain mean where that is null."""
    return F.coalesce((exact_sum(x) / F.count(x)).cast("double"), F.avg(x))


def calibrated(value: Column, pixel_size: float, power: int = 1, valid: Column | None = None) -> Column:
    """Lengths times the pixel size, areas (power 2) times its square; null unless valid."""
    out = value * float(pixel_size) ** power
    return out if valid is None else F.when(valid, out)


def accept(error: Column, limit: float) -> Column:
    """Below the limit; a missing error is a rejection."""
    return F.coalesce(clean(error) < limit, F.lit(False))


def polarity(value: Column, invert: bool) -> Column:
    return -value if invert else value


def recommended_method(w: Column, h: Column, small: int = 12) -> Column:
    return F.when(F.greatest(w, h) <= small, "logquad").otherwise("edge_gradmoment")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def area_limits(width: Column, height: Column, square: Column) -> tuple[Column, Column]:
    """Smallest and largest component area around a design area: 0.2 times (2 at least) to 4 times plus 20 (50 at least)."""
    area = width * height * F.when(square, 1.0).otherwise(3.141592653589793 / 4)
    return F.greatest(F.lit(2), F.floor(area * 0.2).cast("int")), F.greatest(F.lit(50), F.floor(area * 4 + 20).cast("int"))


def band(count: int | None, reference: int, size: int) -> range:
    """``count`` neighbouring places around the reference inside 0..size-1; even counts lean right."""
    count = size if count is None else count
    if not 1 <= count <= size:
        raise ValueError(f"a band holds 1 to {size} places")
    start = min(max(reference - (count - 1) // 2, 0), size - count)
    return range(start, start + count)


def relative_key(path: Column, parent: str) -> Column:
    """A path below its parent, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\Q" + parent.rstrip("/") + r"\E/?", "")


def tiff_key(path: Column) -> Column:
    """struct(stripe, vertical, board) of names like 3_12_1.tif; null for other names."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    got = [F.try_to_number(F.regexp_extract(name, r"(?i)^(\d+)_(\d+)_(\d+)\.tiff?$", i), F.lit("999999999")).cast("int") for i in (1, 2, 3)]
    return F.when(name.rlike(r"(?i)^\d+_\d+_\d+\.tiff?$"), F.struct(*[c.alias(n) for c, n in zip(got, ("stripe", "vertical", "board"))]))


def page_range(text: str) -> tuple[int, int | None]:
    """'A:B' -> (A, B), 'A' -> (A, A + 1), 'A:' -> (A, None): half-open page ranges."""
    a, colon, b = text.strip().partition(":")
    try:
        low, high = int(a or 0), (int(b) if b.strip() else None) if colon else int(a) + 1
    except ValueError:
        raise ValueError(f"not a page range: {text!r}") from None
    if low < 0 or (high is not None and high <= low):
        raise ValueError(f"not a page range: {text!r}")
    return low, high


def significant(x: Column, digits: int = 7) -> Column:
    """Shortest text with so many significant digits; an empty string for what isn't finite."""
    return F.when(finite(x), F.format_string(f"%.{digits - 1}e", x).cast("double").cast("string")).otherwise("")


def rounded(x: Column | str, digits: int) -> Column:
    """Nearest multiple of 10^-digits by binary arithmetic, halves away from 0, never -0: as DuckDB rounds doubles."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + F.lit(0.0)


def materialised(df: DataFrame) -> DataFrame:
    """df by checkpoint() if the session names a checkpoint folder, else cached: for small tables of iterations."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist(StorageLevel.MEMORY_AND_DISK)
