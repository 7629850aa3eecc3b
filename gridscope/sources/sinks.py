"""Results as tables: Parquet for machines, CSV for people, one row of JSON for what was run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.functions import calibrated, significant
from gridscope.operators.stats import method_summary


def save_measurements(measurements: DataFrame, path: str, pixel_size: float = 1.0, unit: str = "px", compact: bool = False, mode: str = "errorifexists") -> None:
    """measurements (calibrated), contours (one row per vertex, unless compact) and a manifest under path."""
    if unit == "px" and pixel_size != 1:
        raise ValueError("a unit of px has a pixel size of 1")
    m = measurements
    cd = F.col("metrics")["cd_equivalent_px"]
    flat = m.select(
        "page", "cell_id", "method", "valid", "status", "center_x", "center_y", cd.alias("cd_px"),
        calibrated(cd, pixel_size, 1, F.col("valid")).alias("cd"), calibrated(F.col("metrics")["area_px2"], pixel_size, 2, F.col("valid")).alias("area"),
        *([] if compact else [F.to_json("metrics").alias("metrics")]),
    )
    flat.write.mode(mode).parquet(f"{path}/measurements")
    if not compact:
        m.where("contour IS NOT NULL").select("page", "cell_id", "method", F.posexplode("contour").alias("vertex", "p")).select("page", "cell_id", "method", "vertex", "p.x", "p.y").write.mode(mode).parquet(f"{path}/contours")
    manifest(flat.withColumn("value", F.col("cd")), pixel_size, unit).write.mode(mode).json(f"{path}/manifest")


def manifest(measurements: DataFrame, pixel_size: float, unit: str) -> DataFrame:
    """One row per method: status counts, and valid, failed, median, mean and population sd."""
    counts = measurements.groupBy("method", "status").count().groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("status", "count"))).alias("status_counts"))
    return method_summary(measurements).join(counts, "method").withColumn("pixel_size", F.lit(pixel_size)).withColumn("unit", F.lit(unit))


def load_measurements(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/measurements")


def wide_holes(measurements: DataFrame, methods: list[str]) -> DataFrame:
    """One row per hole, one column of seven significant digits per method, blank where there is no value."""
    v = F.when(F.col("valid"), F.col("value"))
    wide = measurements.groupBy("page", "cell_id").pivot("method", methods).agg(F.first(v, True))
    return wide.select("page", "cell_id", *[significant(F.col(m)).alias(m) for m in methods])


def save_report(profiles: DataFrame, summary: DataFrame, path: str) -> None:
    """Profiles and summary as CSV into a folder that must be new."""
    profiles.write.mode("errorifexists").option("header", "true").csv(f"{path}/profiles")
    summary.write.mode("errorifexists").option("header", "true").csv(f"{path}/summary")


def save_sorted(rows: DataFrame, path: str, keys: tuple[str, ...] = ("file", "page")) -> None:
    """Rows in key order: range partitions, so that part files follow each other."""
    rows.orderBy(*keys).write.mode("overwrite").option("header", "true").csv(path)


def append_run(spark, path: str, **facts) -> None:
    """One JSON record of a run, appended."""
    row = [tuple(str(v) for v in facts.values())]
    spark.createDataFrame(row, ", ".join(f"`{k}` string" for k in facts)).withColumn("time", F.current_timestamp()).write.mode("append").json(path)


def save_centers(points: DataFrame, path: str) -> None:
    points.select("id", "x", "y").write.mode("errorifexists").parquet(path)
