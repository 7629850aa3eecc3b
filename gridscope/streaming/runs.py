"""Runs over page files: batch or stream, checked against their settings, resumable, failures kept as rows."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.operators.pages import measure_pages
from gridscope.sources.pages import decode_pages, read_pages


def fingerprint(settings: dict) -> str:
    """Digest of the settings a run depends on."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def input_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of the input files, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_settings(spark: SparkSession, output: str, settings: dict) -> None:
    """Remember the settings beside the output, or refuse to go on with others."""
    mark, path = fingerprint(settings), f"{output}/settings"
    if _exists(spark, path):
        known = spark.read.json(path).first()["fingerprint"]
        if known != mark:
            raise ValueError("this output belongs to a run with other settings")
        return
    spark.createDataFrame([(mark, json.dumps(settings, default=str))], "fingerprint string, settings string").coalesce(1).write.json(path)


def load_function(spec: str) -> Callable:
    """A page check from FILE.py:NAME."""
    path, _, name = spec.rpartition(":")
    module = importlib.util.spec_from_file_location("page_check", path)
    loaded = importlib.util.module_from_spec(module)
    module.loader.exec_module(loaded)
    return getattr(loaded, name)


def page_rows(measured: DataFrame) -> DataFrame:
    """One row per page that was read: status, holes, and the mean and count of valid sizes per method in maps."""
    v = F.when(F.col("valid"), F.col("metrics")["cd_equivalent_px"])
    measured = measured if "error" in measured.columns else measured.withColumn("error", F.lit(None).cast("string"))
    per = measured.groupBy("file", "page", "method").agg(F.count(v).alias("n"), F.avg(v).alias("cd"), F.max("holes").alias("holes"), F.max("status").alias("status"), F.max("error").alias("error"))
    status = F.max("status")
    return per.groupBy("file", "page").agg(
        F.max("holes").alias("holes"),
        F.when(F.count("error") > 0, "failed").when(F.count("method") > 0, "ok").otherwise(F.when((status == "no_holes") | status.startswith("rejected"), status).otherwise("failed")).alias("status"),
        F.map_from_entries(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("method", "n")))).alias("valid"),
        F.map_from_entries(F.collect_list(F.when(F.col("method").isNotNull() & F.col("cd").isNotNull(), F.struct("method", "cd")))).alias("cd"),
    )


def code_fingerprint() -> str:
    """Digest of the kernels' sources: other code may measure otherwise."""
    import gridscope.kernels as kernels

    folder = os.path.dirname(kernels.__file__)
    digest = hashlib.sha256()
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".py")):
        with open(os.path.join(folder, name), "rb") as f:
            digest.update(name.encode() + f.read())
    return digest.hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_batch(
    spark: SparkSession, inputs: str, output: str, methods: tuple[str, ...], pages: tuple[int, int | None] | None = None, check: str | Callable | None = None,
    timeout: float | None = None, stop_after: int | None = 20, **options,
) -> DataFrame:
    """Measure what the output doesn't have yet and append it; returns all page rows, in order.

    The files' listing is held against the table of finished files before anything is
    read: a finished file isn't opened again, and one that has changed since is an error.
    Every page is decoded and measured once; its rows are written, and page rows and failures
    are made of them.  Pages that failed are in failures and tried again by the next
    run, the others of their file aren't.  ``check``: a function, or FILE.py:NAME of one, that
    rejects pages before they are measured.  Kernels of other code, or other settings, are refused.
    """
    check_settings(spark, output, {"methods": methods, "pages": pages, "check": str(check), "code": code_fingerprint(), **options})
    glob = "*.{npy,tif,tiff}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(inputs).select(F.col("path").alias("file"), "length", "modificationTime")
    if _exists(spark, f"{output}/files"):
        known = spark.read.parquet(f"{output}/files").withColumnsRenamed({"length": "old_length", "modificationTime": "old_time"})
        both = listed.join(known, "file", "left")
        changed = both.where("old_length <> length OR old_time <> modificationTime").first()
        if changed:
            raise ValueError(f"{changed['file']} is finished and has changed since")
        listed = both.where("old_length IS NULL").select("file", "length", "modificationTime")
    paths = [r["file"] for r in listed.select("file").collect()]  # the listing, which the driver made
    if paths:
        done = spark.read.parquet(f"{output}/pages").where("status <> 'failed'").select("file", "page") if _exists(spark, f"{output}/pages") else None
        todo = read_pages(spark, paths, pages, done=done)
        staged = f"{output}/_measured-{uuid.uuid4().hex}"
        check = load_function(check) if isinstance(check, str) else check
        measure_pages(todo, methods, check, timeout, stop_after, with_contours=False, **options).drop("contour").write.parquet(staged)
        measured = spark.read.parquet(staged)
        page_rows(measured.where("error IS NULL")).write.mode("append").parquet(f"{output}/pages")
        failed = measured.where("error IS NOT NULL").select("file", "page", "error")
        failed.withColumn("time", F.current_timestamp()).write.mode("append").parquet(f"{output}/failures")
        listed.join(failed.select("file").distinct(), "file", "left_anti").write.mode("append").parquet(f"{output}/files")
        _delete(spark, staged)
    return spark.read.parquet(f"{output}/pages").orderBy("file", "page")


def run_stream(spark: SparkSession, inputs: str, output: str, methods: tuple[str, ...], glob: str = "*.{npy,tif,tiff}", files_per_trigger: int = 8, **options):
    """The same as a stream of files: the checkpoint remembers files, the sink commits whole micro-batches."""
    check_settings(spark, output, {"methods": methods, **options})
    schema = spark.read.format("binaryFile").load(inputs).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(inputs)
    measured = measure_pages(decode_pages(files.select(F.col("path").alias("file"), "content")), methods, with_contours=False, **options)
    return (
        measured.drop("contour").writeStream.format("parquet").option("path", f"{output}/measured").option("checkpointLocation", f"{output}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )


def event_windows(events: DataFrame, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of (key, ts, value): gap clusters as a session window with a watermark."""
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return events.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("key", "w.start", "w.end", "n", "mean")
