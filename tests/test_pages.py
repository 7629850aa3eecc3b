"""Sources, sinks and runs: round trips, corrupt files, resume, settings, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.kernels import images
from gridscope.operators import pages as ops
from gridscope.sources import pages, sinks
from gridscope.streaming import runs


@pytest.fixture()
def folder(tmp_path):
    c = images.lattice_centers(4, 5, (12, 12))
    stack = np.stack([images.render_holes((70, 80), c, 4.0, 50.0, 20.0, 0.2, k) for k in range(3)]).astype(np.float32)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    np.save(tmp_path / "in" / "a.npy", stack)
    (tmp_path / "in" / "deep" / "b.tif").write_bytes(pages.write_tiff([(p * 100).astype(np.uint16) for p in stack]))
    (tmp_path / "in" / "bad.tif").write_bytes(b"II*\0garbage")
    return tmp_path


def test_reading_keeps_going_past_bad_files(spark, folder):
    got = pages.read_pages(spark, str(folder / "in"))
    ok = got.where("error IS NULL")
    assert ok.count() == 6 and got.where("error IS NOT NULL").count() == 1
    assert pages.read_pages(spark, str(folder / "in"), (1, 2)).where("error IS NULL").count() == 2
    npy = np.load(folder / "in" / "a.npy")
    row = ok.where("file LIKE '%a.npy' AND page = 1").first()
    assert np.allclose(np.array(row.pixels).reshape(row.height, row.width), npy[1])
    px = pages.explode_pixels(ok.where("file LIKE '%a.npy' AND page = 1"))
    assert px.where("x = 10 AND y = 3").first().v == pytest.approx(float(npy[1][3, 10]))


def test_grayscale_rules():
    assert pages.grayscale(np.ones((2, 2, 3)))[0, 0] == pytest.approx(1.0)
    assert pages.grayscale(np.array([[True, False]])).tolist() == [[1.0, 0.0]]
    with pytest.raises(ValueError):
        pages.grayscale(np.array([[np.nan]]))


def test_batch_resumes_and_refuses_other_settings(spark, folder):
    out = str(folder / "out")
    first = runs.run_batch(spark, str(folder / "in" / "a.npy"), out, ("halfmax",), background="border", threshold="otsu").collect()
    again = runs.run_batch(spark, str(folder / "in"), out, ("halfmax",), background="border", threshold="otsu").collect()
    assert len(first) == 3 and len(again) == 6 and all(r.status == "ok" for r in again)
    assert spark.read.parquet(out + "/failures").count() >= 1
    with pytest.raises(ValueError):
        runs.run_batch(spark, str(folder / "in"), out, ("logquad",))
    assert runs.input_manifest(spark, str(folder / "in")).count() == 3


def test_finished_files_are_not_opened_again(spark, folder):
    import os

    out, bad = str(folder / "out"), folder / "in" / "bad.tif"
    options = dict(background="border", threshold="otsu")
    first = runs.run_batch(spark, str(folder / "in"), out, ("halfmax",), **options).collect()
    assert len(first) == 6 and spark.read.parquet(out + "/files").count() == 2 and spark.read.parquet(out + "/failures").count() == 1
    npy = folder / "in" / "a.npy"
    seen, content = os.stat(npy), npy.read_bytes()
    npy.write_bytes(b"\0" * len(content))  # would fail if it were read
    os.utime(npy, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    assert [r.asDict() for r in runs.run_batch(spark, str(folder / "in"), out, ("halfmax",), **options).collect()] == [r.asDict() for r in first]
    assert spark.read.parquet(out + "/failures").count() == 2  # the bad file was tried again, the finished ones weren't
    bad.write_bytes(pages.write_tiff([np.full((30, 30), 7, np.uint16)]))
    assert len(runs.run_batch(spark, str(folder / "in"), out, ("halfmax",), **options).collect()) == 7
    npy.write_bytes(content + b"0")
    with pytest.raises(ValueError, match="has changed"):
        runs.run_batch(spark, str(folder / "in"), out, ("halfmax",), **options)


def test_checks_limits_and_failures_in_a_row(spark, folder, tmp_path):
    (tmp_path / "check.py").write_text("def dark(image):\n    return 'dark' if image.mean() < 1000 else None\n")
    got = runs.run_batch(spark, str(folder / "in" / "deep"), str(folder / "o1"), ("halfmax",), check=f"{tmp_path}/check.py:dark", background="border", threshold="otsu").collect()
    assert {r.status for r in got} == {"ok"}
    got = runs.run_batch(spark, str(folder / "in" / "a.npy"), str(folder / "o2"), ("halfmax",), check=f"{tmp_path}/check.py:dark", background="border", threshold="otsu").collect()
    assert {r.status for r in got} == {"rejected: dark"} and len(got) == 3

    def slow(image):
        import time

        time.sleep(5 if image[0, 0] < 0 else 0)

    p = pages.read_pages(spark, str(folder / "in"), glob="*.npy")
    q = p.withColumn("pixels", F.when(F.col("page") == 1, F.transform("pixels", lambda v: -v)).otherwise(F.col("pixels")))
    rows = ops.measure_pages(q, ("halfmax",), check=slow, timeout=1.0, background="border", threshold="otsu").collect()
    assert {r.page for r in rows if r.error} == {1} and all("TimeoutError" in r.error for r in rows if r.error) and len({r.page for r in rows}) == 3

    def broken(image):
        raise KeyError("broken")

    rows = ops.measure_pages(p, ("halfmax",), check=broken).collect()
    assert len(rows) == 3 and all("KeyError" in r.error for r in rows)
    with pytest.raises(Exception, match="2 pages in a row failed"):
        ops.measure_pages(p, ("halfmax",), check=broken, stop_after=2).collect()


def test_stream_gives_the_same_rows(spark, folder):
    out = str(folder / "stream")
    q = runs.run_stream(spark, str(folder / "in"), out, ("halfmax",), glob="*.npy", background="border", threshold="otsu")
    q.awaitTermination(120)
    streamed = spark.read.parquet(out + "/measured")
    batch = ops.measure_pages(pages.read_pages(spark, str(folder / "in"), glob="*.npy"), ("halfmax",), background="border", threshold="otsu")
    key = lambda d: sorted((r.page, r.cell_id, round(r.metrics["cd_equivalent_px"], 9)) for r in d.where("valid").collect())
    assert key(streamed) == key(batch) and len(key(batch)) > 0


def test_measurements_round_trip(spark, folder):
    m = ops.measure_pages(pages.read_pages(spark, str(folder / "in"), glob="*.npy"), ("halfmax", "logquad"), background="border", threshold="otsu").cache()
    with pytest.raises(ValueError):
        sinks.save_measurements(m, str(folder / "x"), 2.0)
    sinks.save_measurements(m, str(folder / "m"), 2.0, "nm")
    back = sinks.load_measurements(spark, str(folder / "m"))
    one = back.where("valid").first()
    assert back.count() == m.count() and one.cd == pytest.approx(2 * one.cd_px)
    assert spark.read.parquet(str(folder / "m/contours")).groupBy("page", "cell_id", "method").count().agg(F.min("count")).first()[0] == 64
    wide = sinks.wide_holes(m.withColumn("value", F.col("metrics")["cd_equivalent_px"]), ["halfmax", "logquad"])
    assert wide.columns == ["page", "cell_id", "halfmax", "logquad"]
    sinks.save_sorted(wide, str(folder / "w"), ("page", "cell_id"))
    sinks.append_run(spark, str(folder / "runs"), name="x")
    sinks.append_run(spark, str(folder / "runs"), name="y")
    assert spark.read.json(str(folder / "runs")).count() == 2


def test_registration_and_lattice(spark):
    k = spark.createDataFrame([(0, 1), (1, 2)], "page int, seed long")
    p = pages.synthetic_pages(k)
    r = ops.register_pages(p, p).collect()
    assert all(abs(x.dy) < 0.06 and abs(x.dx) < 0.06 and x.check_error < 1e-6 for x in r)
    c = ops.detect_centers(p, threshold="otsu", area=(2, 400), method="weighted")
    assert ops.index_lattice(c).where("indexed").count() == 96


def test_event_windows_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", 1.0) for s in (0, 5, 30)] + [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 03:00:00", 1.0)]
    d = spark.createDataFrame(rows, "key string, t string, value double").select("key", F.col("t").cast("timestamp").alias("ts"), "value")
    d.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = runs.event_windows(spark.readStream.schema(d.schema).parquet(str(tmp_path / "e")), 10)
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT n FROM sessions ORDER BY start").collect()
    assert [r.n for r in got][:2] == [2, 1]
