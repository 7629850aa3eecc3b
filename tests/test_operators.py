"""Relational operators on small exact cases: ties, nulls, NaN, empty tables, clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from gridscope import functions as fn
from gridscope.operators import filters, joins, orders, pitch, spatial, spectra, stats, windows


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def points(spark, data, more=""):
    return spark.createDataFrame(data, "id long, x double, y double" + more)


def test_three_points(spark):
    p = points(spark, [(0, 1.0, 1.0), (1, 1.2, 1.1), (2, 20.0, 20.0)])
    assert filters.margin_filter(p, 64, 64, 0).count() == 3
    got = spatial.dedupe(p, 0.5).collect()
    assert len(got) == 2 and sorted(r.n for r in got) == [1, 2]


def test_margin_is_low_inclusive_high_exclusive(spark):
    p = points(spark, [(0, 5.0, 5.0), (1, 95.0, 50.0), (2, 94.99, 50.0), (3, float("nan"), 1.0)])
    assert rows(filters.margin_filter(p, 100, 100, 5), "id") == [(0,), (2,)]


def test_gap_clusters_and_bounds(spark):
    v = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 20, 21, 40)], "v double")
    got = windows.cluster_bounds(windows.gap_clusters(v, "v", 5), "v")
    assert rows(got, "start", "stop") == [(0, 3), (3, 5), (5, 6)]
    empty = windows.gap_clusters(v.where("false"), "v", 5)
    assert empty.count() == 0 and empty.columns == ["v", "cluster"]


def test_gap_clusters_keep_ties_together(spark):
    v = spark.createDataFrame([(1.0,)] * 3 + [(7.0,)] * 2 + [(12.0,)], "v double")  # 12 - 7 = 5 isn't over 5
    assert rows(windows.gap_clusters(v, "v", 5), "v", "cluster") == [(1.0, 0)] * 3 + [(7.0, 1)] * 2 + [(12.0, 1)]


def test_running_mean_lines_differ_from_gaps(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.9, 3.0, 10.0)], "v double")
    assert [r.line for r in windows.running_mean_lines(v, "v", 1.5).orderBy("v").collect()] == [0, 0, 0, 1, 2]


def test_integrate_stops_at_missing(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 4.0), (4, None)], "node long, p double").withColumn("r", F.lit(1))
    got = {r.node: r.distance for r in windows.integrate(d, "p", "node", "r").collect()}
    assert got == {0: -1.0, 1: 0.0, 2: 2.0, 3: None, 4: None}


def test_mutual_nearest_bound_is_inclusive(spark):
    a = points(spark, [(0, 0.0, 0.0), (1, 0.4, 0.0), (2, 5.0, 0.0), (3, 10.0, 0.0), (4, float("nan"), 0.0)])
    b = points(spark, [(0, 0.1, 0.0), (1, 5.2, 0.0), (2, 11.0, 0.0), (3, 50.0, 0.0)])
    got = spatial.mutual_nearest(a, b, 1.0)
    assert [(r.left_id, r.right_id, round(r.distance, 9)) for r in got.orderBy("left_id").collect()] == [(0, 0, 0.1), (2, 1, 0.2), (3, 2, 1.0)]


def test_nearest_within_is_exclusive_and_hole_keeps_closest(spark):
    p = points(spark, [(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 9.0, 0.0)])
    h = points(spark, [(7, 0.4, 0.0), (8, 10.0, 0.0)])
    assert rows(spatial.nearest_within(p, h, 1.0), "hole_id", "point_id") == [(7, 1)]


def test_unique_matches_drop_double_hits(spark):
    p = points(spark, [(0, 0.0, 0.0), (1, 0.2, 0.0), (2, 5.0, 0.0)])
    t = points(spark, [(0, 0.1, 0.0), (1, 5.1, 0.0)])
    assert rows(spatial.unique_matches(p, t), "point_id", "truth_id") == [(2, 1)]


def test_nearest_k_matches_brute_force_on_skewed_points(spark):
    import random

    random.seed(4)
    data = [(i, random.gauss(0, 1) ** 3, random.gauss(0, 1) ** 3) for i in range(150)] + [(200 + i, 3.0, 3.0) for i in range(20)] + [(300, 500.0, 500.0)]
    p = points(spark, data)
    got = {}
    for r in spatial.nearest_k(p, p, 3, exclude_self=True).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.target_id
    for i, x, y in data:
        best = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in data if j != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in best]
    assert spatial.nearest_k(p, p.where("false"), 2).count() == 0


def test_connected_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in spatial.connected(e).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == 1000


def test_paired_statistics(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 2.0)], "a double, b double")
    r = stats.paired_statistics(d, "a", "b", []).first()
    assert (r.n, r.bias, r.median_bias, r.mae, r.rmse) == (3, pytest.approx(2 / 3), 1.0, pytest.approx(4 / 3), pytest.approx(math.sqrt(2)))
    assert r.sd_diff == pytest.approx(math.sqrt(7 / 3)) and r.p95_abs == pytest.approx(1.9) and r.r == pytest.approx(0)
    gaps = spark.createDataFrame([(1.0, 2.0), (float("nan"), 4.0), (3.0, float("inf")), (4.0, 6.0)], "a double, b double")
    r = stats.paired_statistics(gaps, "a", "b", []).first()
    assert (r.n, r.bias) == (2, 1.5) and r.sd_diff == pytest.approx(math.sqrt(0.5))
    flat = stats.paired_statistics(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b", []).first()
    one = stats.paired_statistics(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b", []).first()
    assert flat.r is None and one.sd_diff is None and one.r is None
    assert stats.paired_statistics(d.where("false"), "a", "b", []).first().n == 0


def test_pooled_deviation_equals_direct(spark):
    d = spark.createDataFrame([(i % 3, float(i), float(i * i % 7)) for i in range(20)], "im long, a double, b double")
    whole = stats.paired_statistics(d, "a", "b", []).first()
    pooled = stats.aggregate_comparisons(stats.paired_statistics(d, "a", "b", ["im"]), []).first()
    assert pooled.paired_holes == 20 and pooled.pooled_bias == pytest.approx(whole.bias)
    assert pooled.pooled_rmse == pytest.approx(whole.rmse) and pooled.pooled_sd == pytest.approx(whole.sd_diff)


def test_lattice_neighbours_skip_missing_holes(spark):
    l = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (0, 3, 30.0)], "row long, col long, x double")  # noqa: E741
    assert rows(joins.lattice_neighbours(l, "x", ["x"]), "col", "next_x") == [(0, 10.0)]


def test_lattice_profile_is_exact(spark):
    l = spark.createDataFrame([(r, c, 15.0 + 10 * c + 0.1 * c * c, 15.0 + 12 * r) for r in range(6) for c in range(8)], "row long, col long, x double, y double")  # noqa: E741
    got = pitch.lattice_profile(l, "x", nominal=10.0).orderBy("node").collect()
    assert [r.pairs for r in got] == [6] * 7 + [0]
    for r in got[:7]:
        assert r.pitch == pytest.approx(10 + 0.1 * (2 * r.node + 1)) and r.registration == pytest.approx(0.1 * r.node**2)


def test_spectrum_finds_the_sine(spark):
    s = spark.createDataFrame([("s", k * 100 / 255, 0.5 * math.sin(2 * math.pi * k * 100 / 255 / 10)) for k in range(256)], "g string, x double, y double")
    got = spectra.pitch_error_spectrum(s, "x", "y", ["g"], mode="mean")
    top = orders.top_k(got, "amplitude", 1, ["g"], ["frequency"]).first()
    assert abs(top.period - 10) < 0.5 and abs(top.amplitude - 0.5) < 0.05


def test_lomb_scargle_peak(spark):
    import random

    random.seed(0)
    x = sorted(random.uniform(0, 200) for _ in range(300))
    s = spark.createDataFrame([("s", v, math.sin(2 * math.pi * v / 20) + random.gauss(0, 0.1)) for v in x], "g string, x double, y double")
    f = spark.range(1, 400).select((F.col("id") / 2000).alias("frequency"))
    best = spectra.lomb_scargle(s, "x", "y", f, ["g"]).orderBy(F.desc("power")).first()
    assert abs(best.period - 20) < 1


def test_true_runs_and_rectangles(spark):
    d = spark.createDataFrame([(i, i in (1, 2, 5, 6, 7)) for i in range(9)], "k long, on boolean")
    runs = windows.true_runs(d, "on", "k")
    assert rows(runs, "start", "stop") == [(1, 3), (5, 8)]
    assert rows(windows.runs_to_rectangles(runs, 10, 0, 4, 60), "x0", "x1") == [(10.0, 30.0), (50.0, 60.0)]


def test_names_and_ranges():
    assert fn.page_range("2:5") == (2, 5) and fn.page_range("3") == (3, 4) and fn.page_range("4:") == (4, None)
    for bad in ("-1", "5:5", "x"):
        with pytest.raises(ValueError):
            fn.page_range(bad)
    assert list(fn.band(4, 0, 10)) == [0, 1, 2, 3] and list(fn.band(4, 5, 10)) == [4, 5, 6, 7]


def test_tiff_key_and_significant(spark):
    d = spark.createDataFrame([("a/3_12_1.TIF",), ("x.tif",), (None,)], "p string").select(fn.tiff_key(F.col("p")).alias("k"))
    assert [tuple(r.k) if r.k else None for r in d.collect()] == [(3, 12, 1), None, None]
    s = spark.createDataFrame([(1234.56789,), (float("nan"),), (None,)], "v double").select(fn.significant(F.col("v")).alias("t"))
    assert [r.t for r in s.collect()] == ["1234.568", "", ""]


def test_settings_difference_and_quantile_pages(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    b = spark.createDataFrame([("x", "1"), ("z", "3")], "key string, value string")
    assert rows(orders.settings_difference(a, b), "key") == [("y",), ("z",)]
    t = spark.createDataFrame([("f", p, float(p), 0, "ok") for p in range(11)] + [("f", 3, 99.0, 1, "ok")], "file string, page long, measure_s double, run_id long, status string")
    assert rows(orders.quantile_pages(t, 3), "page") == [(0,), (3,), (6,)]
    assert rows(orders.quantile_pages(t, 1), "page") == [(0,)]


def test_cycle_and_window(spark):
    s = spark.createDataFrame([("c", k, float(k % 3)) for k in range(12)] + [("n", k, float(k)) for k in range(12)], "g string, k long, v double")
    assert rows(windows.cycle_length(s, "v", "k", ["g"]), "g", "cycle") == [("c", 3), ("n", 0)]
    p = spark.createDataFrame([("f", k, "ok" if k in (4, 5, 6) else "failed") for k in range(10)], "file string, page long, status string")
    r = windows.best_window(p, 3).first()
    assert (r.start, r.stop, r.ok_pages) == (4, 7, 3)


def test_index_pitch_finds_the_slope(spark):
    p = points(spark, [(i, 3 + 10.0 * (i % 9), 5 + 12.0 * (i // 9)) for i in range(81)])
    start = spark.createDataFrame([(10.1, 11.9)], "pitch_x double, pitch_y double")
    r = pitch.index_pitch(p, start).first()
    assert r.pitch_x == pytest.approx(10) and r.pitch_y == pytest.approx(12) and r.ox == pytest.approx(3)
    assert spatial.median_spacing(p).first().spacing == 10.0


def test_smoothing_passes_over_missing(spark):
    d = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "b long, v double")
    got = {r.b: r.smooth for r in windows.gaussian_smooth(d, "v", "b", 1.0).collect()}
    assert got[1] == pytest.approx(2.0) and 1 < got[0] < 2


def test_phase_curve_is_the_same_in_any_order(spark):
    d = [0.1] * 10  # as floats they add up to 0.9999999999999999
    got = stats.phase_curve(spark.createDataFrame([("g", 3.2, v) for v in d], "g string, x double, e double").coalesce(1), "x", "e", 20, 1, ["g"])
    assert rows(got, "bin", "n", "mean") == [(14, 10, 0.1)]
    mixed = [1e300, 1.0, None, float("nan"), float("inf")]
    means = spark.createDataFrame([(i, v) for i, v in enumerate(mixed)], "g int, e double").groupBy("g").agg(fn.steady_mean(F.col("e")).alias("m"))
    assert [str(r.m) for r in means.orderBy("g").collect()] == ["1e+300", "1.0", "None", "nan", "inf"]


def test_quantiles_are_sorted_not_gathered(spark, monkeypatch):
    data = [(g, v if v % 7 else None, float(v * v % 13)) for g in "ab" for v in map(float, range(50))] + [("c", 5.0, None), ("d", None, float("nan"))]
    d = spark.createDataFrame(data, "g string, x double, y double")
    for q in (0.0, 0.05, 0.5, 0.93, 1.0):
        want = d.groupBy("g").agg(F.percentile("x", q).alias("x"), F.percentile("y", q).alias("y"))
        assert str(rows(stats.quantiles(d, ["x", "y"], q, ["g"]), "g", "x", "y")) == str(rows(want, "g", "x", "y"))
    assert rows(stats.quantiles(d, ["x"], 0.5), "x") == rows(d.agg(F.percentile("x", 0.5).alias("x")), "x")

    def gathers(*_):
        raise AssertionError("a group's distinct values in one map")

    p = points(spark, [(i, 10 + 1.5 * i + 0.01 * (i % 3), 2.0 * (i % 4)) for i in range(40)])
    start = spark.createDataFrame([(1.5, 2.0)], "pitch_x double, pitch_y double")
    monkeypatch.setattr(F, "percentile", gathers)
    r = pitch.index_pitch(p, start).first()
    assert abs(r.pitch_x - 1.5) < 1e-3 and r.kept == 40 and pitch.index_pitch(p, start, rounds=0).first().kept is None


def test_interpolation_costs_the_same_in_large_groups(spark):
    """Values as by brute force, ends clamped, ties by y; no frame is summed up anew for each row."""
    s = spark.createDataFrame([("a", x, y) for x, y in ((0.0, 1.0), (2.0, 5.0), (2.0, 9.0), (4.0, 1.0), (3.0, float("nan")))] + [("b", 1.0, 7.0)], "g string, x double, y double")
    w = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 9.0)] + [("b", 0.0), ("b", 2.0), ("c", 1.0)], "g string, x double")
    got = windows.interpolate(s, w, "x", "y", ["g"])
    want = [("a", -1.0, 1.0), ("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 9.0), ("a", 3.0, 5.0), ("a", 4.0, 1.0), ("a", 9.0, 1.0), ("b", 0.0, 7.0), ("b", 2.0, 7.0), ("c", 1.0, None)]
    assert rows(got, "g", "x", "y") == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_dedupe_of_dense_points_makes_no_pairs_of_all(spark, monkeypatch):
    """Equal to brute force on blobs, chains and gaps about eps wide, while no more pairs are made than cells have."""
    import random

    r = random.Random(3)
    data = [(i, r.uniform(0, 9), r.uniform(0, 9), "sparse") for i in range(150)]
    data += [(1000 + i, r.gauss(5 * (i % 6), 0.5), r.gauss(0, 0.5), "dense") for i in range(360)]
    data += [(2000 + i, 1.0 * i, 0.0, "chain") for i in range(30)] + [(3000 + i, 1.0000001 * i, 0.0, "apart") for i in range(30)] + [(4000 + i, 0.1, 0.1, None) for i in range(3)]
    root = {d[0]: d[0] for d in data}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x, y, g) in enumerate(data):
        for j, u, v, h in data[:k]:
            if g is not None and g == h and (x - u) * (x - u) + (y - v) * (y - v) <= 1:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {}
    for i, *_ in data:
        want[top(i)] = want.get(top(i), 0) + 1
    monkeypatch.setattr(spatial, "radius_pairs", None)  # all pairs within eps
    got = spatial.dedupe(points(spark, data, ", g string"), 1.0, ["g"]).collect()
    assert {q.root: q.n for q in got} == want and len(got) == len(want) > 30
    for q in got:
        mine = [d for d in data if top(d[0]) == q.root]
        assert abs(q.x - sum(d[1] for d in mine) / q.n) < 1e-9 and abs(q.y - sum(d[2] for d in mine) / q.n) < 1e-9
