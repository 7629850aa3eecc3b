"""Filters and projections on points, components, pixels and measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import clean


def margin_filter(points: DataFrame, width: float, height: float, margin: float = 5) -> DataFrame:
    """Points with margin <= x < width - margin, and y likewise."""
    inside = lambda c, n: (F.col(c) >= margin) & (F.col(c) < n - margin)
    return points.where(inside("x", width) & inside("y", height))


def area_filter(components: DataFrame, low: float, high: float) -> DataFrame:
    return components.where(F.col("area").between(low, high))


def touches_frame(width: Column | int, height: Column | int) -> Column:
    """Whether a box (x, y, w, h) reaches the frame."""
    return (F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") + F.col("w") >= width) | (F.col("y") + F.col("h") >= height)


def map_to_global(
    points: DataFrame, stripes: DataFrame, boards: DataFrame, height: int, crop_top: float = 0, flip: bool = False
) -> DataFrame:
    """Page points (stripe, board, page, x, y) in the frame of the whole board.

    Flipped pages read y from the bottom; page k begins at k * height; what lies above
    the crop or below the stripe's own height (column total_height; null is no limit) goes;
    offsets (dx, dy) of missing metadata are 0.
    """
    y = (F.lit(height - 1) - F.col("y")) if flip else F.col("y")
    p = points.withColumn("__y", F.col("page") * height + y - crop_top)
    p = p.join(stripes.selectExpr("stripe", "dx AS __sx", "dy AS __sy", "total_height AS __h"), "stripe", "left")
    p = p.join(boards.selectExpr("board", "dx AS __bx", "dy AS __by"), "board", "left")
    p = p.where((F.col("__y") >= 0) & (F.col("__h").isNull() | (F.col("__y") < F.col("__h"))))
    zero = lambda *cs: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    out = p.withColumn("gx", F.col("x") + zero("__sx", "__bx")).withColumn("gy", F.col("__y") + zero("__sy", "__by"))
    return out.drop("__y", "__sx", "__sy", "__h", "__bx", "__by")


def crop(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Half-open box, at least 3 by 3, with coordinates from its corner."""
    if x1 - x0 < 3 or y1 - y0 < 3:
        raise ValueError("a crop has at least 3 by 3 pixels")
    kept = pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return kept.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def crop_margin(pixels: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    return crop(pixels, margin, margin, width - margin, height - margin)


def evaluation_set(points: DataFrame, width: int, height: int, pitch: float) -> DataFrame:
    """Points marked inside that keep one pitch from every edge, bounds included."""
    return points.where(F.col("inside") & F.col("x").between(pitch, width - 1 - pitch) & F.col("y").between(pitch, height - 1 - pitch))


def failed_cells(measurements: DataFrame, keys: Sequence[str] = ("page", "cell_id")) -> DataFrame:
    """Cells that any method failed in."""
    return measurements.groupBy(*keys).agg(F.bool_or(~F.col("valid")).alias("failed"), F.count_if(~F.col("valid")).alias("failed_methods")).where("failed")


def failed_in(measurements: DataFrame, method: str, picked: DataFrame | None = None) -> DataFrame:
    """Rows of one method that failed, of a picked subset of cells if one is given."""
    rows = measurements.where((F.col("method") == method) & ~F.col("valid"))
    return rows if picked is None else rows.join(picked, ["page", "cell_id"], "left_semi")


def byte_scaled(pixels: DataFrame, value: str = "v", out: str = "byte") -> DataFrame:
    """Each page's finite values stretched to 0..255, rounded half to even; a constant page is 0."""
    w = Window.partitionBy("page")
    low, high = F.min(clean(F.col(value))).over(w), F.max(clean(F.col(value))).over(w)
    scaled = F.rint((F.col(value) - low) * F.lit(255.0) / F.nullif(high - low, F.lit(0.0)))
    return pixels.withColumn(out, F.coalesce(scaled, F.lit(0.0)).cast("int"))
