"""Driver queries of windows, orders, sets, pitch, spectra and pixel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope import functions as fn
from gridscope.operators import joins, orders, pitch, spectra, stats, windows
from gridscope.plans import tables as t
from gridscope.plans.relational import _CLOUD, _D2, _DIFFS, OFF, _LINES, _PAIRX, _RMAP, LAT, MEAS, PTS, PX, QUERIES, SEEDS, SQL, TM, _cells, _cloud, off_ties, query, r6  # noqa: F401

# -- windows ----------------------------------------------------------------------------------------


@query("f1_gap_clusters", f"WITH {_LINES} SELECT line AS cluster, count(*) AS n, round(avg(y), 6) AS center, (sum(count(*)) OVER (ORDER BY line))::BIGINT AS stop, (sum(count(*)) OVER (ORDER BY line) - count(*))::BIGINT AS start FROM lp GROUP BY line")
def _(s, d):
    c = windows.gap_clusters(t.points(s, d), "y", 0.5)
    return r6(windows.cluster_bounds(c, "y"), "center")


@query("f1_event_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events), n AS (SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 3600 THEN 1 ELSE 0 END AS new FROM e), c AS (SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS k FROM n)
SELECT user_id, k::BIGINT AS session, count(*) AS n, round(max(s) - min(s), 3) AS seconds FROM c GROUP BY 1, 2""")
def _(s, d):
    e = t.read(s, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    c = windows.gap_clusters(e, "s", 3600, ["user_id"], "session")
    return c.groupBy("user_id", "session").agg(F.count("*").alias("n"), fn.rounded(F.max("s") - F.min("s"), 3).alias("seconds"))


@query("f2_assign_clusters", f"WITH {_LINES} SELECT id, line AS cluster FROM lp")
def _(s, d):
    return windows.gap_clusters(t.points(s, d), "y", 0.5).select("id", "cluster")


@query("f3_running_mean_lines", """WITH RECURSIVE v AS (SELECT event_type, value, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events GROUP BY 1, 2),
r(event_type, k, value, n, line, s, c) AS (SELECT event_type, k, value, n, 0, value * n, n::DOUBLE FROM v WHERE k = 1
UNION ALL SELECT v.event_type, v.k, v.value, v.n, CASE WHEN abs(v.value - r.s / r.c) <= 1.5 THEN r.line ELSE r.line + 1 END, CASE WHEN abs(v.value - r.s / r.c) <= 1.5 THEN r.s + v.value * v.n ELSE v.value * v.n END, CASE WHEN abs(v.value - r.s / r.c) <= 1.5 THEN r.c + v.n ELSE v.n END
FROM r JOIN v ON v.event_type = r.event_type AND v.k = r.k + 1) SELECT event_type, line, sum(n)::BIGINT AS n, count(*) AS levels FROM r GROUP BY 1, 2""")
def _(s, d):
    got = windows.running_mean_lines(t.read(s, d, "events"), "value", 1.5, ["event_type"])
    return got.groupBy("event_type", "line").agg(F.sum("n").alias("n"), F.count("*").alias("levels"))


@query("f4_adjacent_differences", f"WITH {PTS} SELECT id, round(x - lag(x) OVER (PARTITION BY y ORDER BY x, id), 6) AS diff FROM pts")
def _(s, d):
    return r6(windows.adjacent_differences(t.points(s, d), "x", ["y"], ["x", "id"]), "diff").select("id", "diff")


@query("f5_integrate", f"""WITH {LAT}, {_PAIRX}, pf AS (SELECT g, col AS node, avg(step) AS pitch FROM pr GROUP BY 1, 2), n AS (SELECT g, unnest(range(0, (SELECT max(m) FROM (SELECT max(col) + 1 AS m FROM lat)))) AS node FROM (SELECT DISTINCT g FROM lat)),
q AS (SELECT n.g, n.node, pitch FROM n LEFT JOIN pf ON pf.g = n.g AND pf.node = n.node)
SELECT a.g, a.node, CASE WHEN a.node = 50 THEN 0 WHEN a.node > 50 THEN (SELECT CASE WHEN count(*) = count(pitch) THEN round(sum(pitch), 6) END FROM q b WHERE b.g = a.g AND b.node >= 50 AND b.node < a.node)
ELSE (SELECT CASE WHEN count(*) = count(pitch) THEN round(-sum(pitch), 6) END FROM q b WHERE b.g = a.g AND b.node < 50 AND b.node >= a.node) END AS distance FROM q a""")
def _(s, d):
    lat = t.lattice(s, d)
    p = joins.lattice_neighbours(lat, "x", ["x"], ["g"]).groupBy("g", F.col("col").alias("node")).agg(F.avg(F.col("next_x") - F.col("x")).alias("pitch"))
    top = lat.agg(F.max("col").alias("m"))
    nodes = lat.select("g").distinct().crossJoin(top).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("node"))  # one row
    q = nodes.join(p, ["g", "node"], "left").withColumn("ref", F.lit(50))
    return r6(windows.integrate(q, "pitch", "node", "ref", ["g"]), "distance").select("g", "node", "distance")


_RUN = "WITH r AS (SELECT *, k - row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM (SELECT o_orderkey % 3 AS g, o_orderkey // 3 AS k, o_orderstatus FROM orders) WHERE o_orderstatus <> 'F'), runs AS (SELECT g, min(k) AS start, max(k) + 1 AS stop FROM r GROUP BY g, i)"


def _runs(s, d):
    o = t.read(s, d, "orders").select((F.col("o_orderkey") % 3).alias("g"), F.floor(F.col("o_orderkey") / 3).alias("k"), (F.col("o_orderstatus") != "F").alias("on"))
    return windows.true_runs(o, "on", "k", ["g"])


@query("f6_true_runs", f"{_RUN} SELECT g, start, stop FROM runs")
def _(s, d):
    return _runs(s, d)


@query("f7_runs_to_rectangles", f"{_RUN} SELECT g, start * 16.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, least(stop * 16.0::DOUBLE, 40000.0) AS x1, 10.0::DOUBLE AS y1 FROM runs WHERE least(stop * 16.0, 40000.0) > start * 16.0")
def _(s, d):
    return windows.runs_to_rectangles(_runs(s, d), 16, 2, 10, 40000).select("g", "x0", "y0", "x1", "y1")


_SM = "sum(k * m.n * m.value) / sum(k * m.n)"


@query("f8_smooth_map", f"WITH {PTS}, {_CLOUD}, {_RMAP}, kern AS (SELECT i, pow(2.718281828459045, -i * i / 8.0::DOUBLE) AS k FROM (SELECT unnest(range(-6, 7)) AS i)) SELECT a.line, a.bin, round({_SM}, 6) AS smooth FROM rm a JOIN kern ON true JOIN rm m ON m.line = a.line AND m.bin = a.bin - kern.i GROUP BY 1, 2")
def _(s, d):
    m = stats.residual_map(_cloud(s, d), 8)
    return r6(windows.gaussian_smooth(m, "value", "bin", 2, ["line"], "n"), "smooth").select("line", "bin", "smooth")


@query("f9_binomial5", f"WITH {PX} SELECT page, x, y, (coalesce(lag(v, 2) OVER w, f) + 4 * coalesce(lag(v) OVER w, f) + 6 * v + 4 * coalesce(lead(v) OVER w, l) + coalesce(lead(v, 2) OVER w, l)) / 16 AS smooth FROM (SELECT *, first(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM px) WINDOW w AS (PARTITION BY page, y ORDER BY x)")
def _(s, d):
    return windows.binomial5(t.pixels(s, d), "v", ["page", "y"], "x").select("page", "x", "y", "smooth")


@query("f10_band", f'WITH {LAT} SELECT g, "row", count(*) AS n FROM lat WHERE "row" BETWEEN 46 AND 50 GROUP BY 1, 2')
def _(s, d):
    b = fn.band(5, 50, 51)
    return joins.in_band(t.lattice(s, d), "row", b[0], b[-1]).groupBy("g", "row").agg(F.count("*").alias("n"))


_PAGES = "pg AS (SELECT o_custkey % 4 AS file, o_orderkey AS page, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status FROM orders)"


@query("f11_best_window", f"""WITH {_PAGES}, m AS (SELECT file, max(page) AS last FROM pg GROUP BY 1), e AS (SELECT file, last, unnest(range(0, last + 1)) AS page FROM m), c AS (SELECT e.file, e.last, e.page, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY e.file ORDER BY e.page ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM e LEFT JOIN pg USING (file, page)),
b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, page) AS k FROM c WHERE page + 49 <= last OR page = 0) SELECT file, page::INT AS start, least(page + 50, last + 1)::INT AS stop, n::BIGINT AS ok_pages FROM b WHERE k = 1""")
def _(s, d):
    p = t.read(s, d, "orders").select((F.col("o_custkey") % 4).alias("file"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return windows.best_window(p, 50)


@query("f12_dense_positions", f"WITH {PTS} SELECT id, dense_rank() OVER (PARTITION BY g ORDER BY y) - 1 AS line FROM pts")
def _(s, d):
    return windows.dense_positions(t.points(s, d), "y", ["g"]).select("id", "line")


@query("f13_first_by", f"WITH {PTS} SELECT g, id FROM (SELECT g, id, row_number() OVER (PARTITION BY g, p % 10 ORDER BY x, id) AS k FROM pts) WHERE k = 1")
def _(s, d):
    return windows.first_by(t.points(s, d).withColumn("h", F.col("p") % 10), ["g", "h"], ["x", "id"]).select("g", "id")


_PROF = f"WITH {PX}, pr AS (SELECT page, x, avg(v) AS v FROM px GROUP BY 1, 2), pk AS (SELECT *, first(x) OVER (PARTITION BY page ORDER BY v DESC, x) AS peak, (max(v) OVER (PARTITION BY page) + min(v) OVER (PARTITION BY page)) / 2 AS half, lead(v) OVER (PARTITION BY page ORDER BY x) AS v1 FROM pr)"


@query("f14_steepest_edges", f"{_PROF} SELECT page, arg_max(x, (round(v1 - v, 9), -x)) FILTER (x < peak AND v1 > v) AS rise, arg_max(x, (round(v - v1, 9), -x)) FILTER (x >= peak AND v1 < v) AS fall FROM pk GROUP BY 1")
def _(s, d):
    p = t.pixels(s, d).groupBy("page", "x").agg(F.avg("v").alias("v"))
    return windows.steepest_edges(p, "v", "x", ["page"])


@query("f15_half_height_width", f"{_PROF}, c AS (SELECT page, max(x + (half - v) / (v1 - v)) FILTER (x + 1 <= peak AND v < half AND v1 >= half) AS l, min(x + (half - v) / (v1 - v)) FILTER (x >= peak AND v >= half AND v1 < half) AS r FROM pk GROUP BY 1) SELECT page, round(l, 6) AS \"left\", round(r, 6) AS \"right\", round(r - l, 6) AS width FROM c")
def _(s, d):
    p = t.pixels(s, d).groupBy("page", "x").agg(F.avg("v").alias("v"))
    return r6(windows.half_height_width(p, "v", "x", ["page"]), "left", "right", "width")


@query("f16_cycle_length", f"""WITH st AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value * (user_id % 2) + (event_id % 3) AS v FROM events), b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS back, {', '.join(f'abs(v - lag(v, {k}) OVER (PARTITION BY user_id ORDER BY k)) AS d{k}' for k in range(1, 9))} FROM st),
m AS (SELECT user_id, max(n) AS n, {', '.join(f'max(d{k}) AS d{k}' for k in range(1, 9))} FROM b WHERE back <= 3 GROUP BY 1) SELECT user_id, CASE WHEN n < 6 OR d1 <= 0 THEN 0 {' '.join(f'WHEN n >= {k + 3} AND d{k} < 0.05 * d1 THEN {k}' for k in range(2, 9))} ELSE 0 END AS cycle FROM m""")
def _(s, d):
    e = t.read(s, d, "events").select("user_id", "event_id", (F.col("value") * (F.col("user_id") % 2) + F.col("event_id") % 3).alias("v"))
    return windows.cycle_length(e, "v", "event_id", ["user_id"])


@query("f17_within_index", f"WITH {PTS} SELECT id, row_number() OVER (PARTITION BY y ORDER BY x, id) - 1 AS k FROM pts")
def _(s, d):
    return windows.within_index(t.points(s, d), ["y"], ["x", "id"]).select("id", "k")


# -- orders and sets --------------------------------------------------------------------------------


@query("g2_table_rank", f"WITH {MEAS} SELECT cell_id, row_number() OVER (ORDER BY CASE WHEN valid THEN value END DESC NULLS LAST, cell_id) AS rank FROM meas WHERE method = 'a'")
def _(s, d):
    m = t.measurements(s, d).where("method = 'a'").withColumn("value", F.when(F.col("valid"), F.col("value")))
    return orders.table_rank(m, "value", "cell_id", True).select("cell_id", "rank")


@query("g3_top_mean", f"WITH {PX} SELECT page, avg(v) AS top_mean FROM (SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY v DESC) AS k FROM px) WHERE k <= 16 GROUP BY 1")
def _(s, d):
    return orders.top_mean(t.pixels(s, d), "v", 16, ["page"])


@query("g4_quantile_pages", f"""WITH {TM}, l AS (SELECT page, arg_max(measure_s, run_id) AS m FROM tm WHERE status = 'ok' AND measure_s >= 0 GROUP BY 1), p AS (SELECT page, m, row_number() OVER (ORDER BY m, page) - 1 AS place, count(*) OVER () AS n FROM l),
k AS (SELECT DISTINCT round_even(i * (n - 1) / (least(7, n) - 1)::DOUBLE, 0)::BIGINT AS place FROM (SELECT max(n) AS n FROM p), (SELECT unnest(range(7)) AS i)) SELECT 'f' AS file, page, m AS measure_s FROM p JOIN k USING (place)""")
def _(s, d):
    return orders.quantile_pages(t.timings(s, d), 7)


@query("g5_reference_hole", f'WITH {LAT} SELECT g, arg_min(id, ("row", col, id)) AS reference FROM lat GROUP BY 1')
def _(s, d):
    return orders.reference_hole(t.lattice(s, d), ["g"])


@query("g5_nearest_hole", f"WITH {PTS} SELECT g, arg_min(id, ((x - 50) * (x - 50) + (y - 25) * (y - 25), id)) AS nearest FROM pts GROUP BY 1")
def _(s, d):
    return orders.nearest_hole(t.points(s, d), 50, 25, ["g"])


@query("g6_lexsort", f'WITH {LAT} SELECT g, "row", col, row_number() OVER (PARTITION BY g ORDER BY col, "row") AS place FROM lat')
def _(s, d):
    return windows.within_index(t.lattice(s, d), ["g"], ["col", "row"], "place").select("g", "row", "col", (F.col("place") + 1).alias("place"))


@query("g7_best_of", f"WITH {MEAS}, r AS (SELECT page, method, count(*) FILTER (NOT valid) AS need, round(stddev_pop(value), 6) AS noise FROM meas GROUP BY 1, 2) SELECT page, arg_min(method, (need, noise, method)) AS best FROM r GROUP BY 1")
def _(s, d):
    r = t.measurements(s, d).groupBy("page", "method").agg(F.count_if(~F.col("valid")).alias("need"), fn.rounded(F.stddev_pop("value"), 6).alias("noise"))
    return orders.best_of(r, "page", "need", "noise", "method")


@query("g9_pick_pages", f"WITH {TM}, l AS (SELECT page, max(measure_s) AS m FROM tm GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY m, page) - 1 AS k, count(*) OVER () AS n FROM l) SELECT page, CASE WHEN k = n // 2 THEN 'median' ELSE 'slowest' END AS pick FROM p WHERE k = n // 2 OR k = n - 1")
def _(s, d):
    one = t.timings(s, d).groupBy("file", "page").agg(F.max("measure_s").alias("measure_s"))
    return orders.median_and_slowest(one).select("page", "pick")


@query("g9_first_pages", f"WITH {TM}, f AS (SELECT min(page) AS page FROM tm GROUP BY gpu, worker), s AS (SELECT page FROM tm ORDER BY measure_s DESC, page DESC, run_id DESC LIMIT 4) SELECT count(*) AS first_pages FROM s WHERE page IN (SELECT page FROM f)")
def _(s, d):
    return orders.first_pages_among_slowest(t.timings(s, d))


@query("g8_b6_sorted_rewrite", f"WITH {TM} SELECT file, page, run_id, row_number() OVER (ORDER BY file, page, run_id) AS place FROM tm")
def _(s, d):
    return windows.within_index(t.timings(s, d), ["file"], ["page", "run_id"], "place").select("file", "page", "run_id", (F.col("place") + 1).alias("place"))


@query("h1_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def _(s, d):
    return t.read(s, d, "nation").selectExpr("n_nationkey AS k").unionByName(t.read(s, d, "region").selectExpr("r_regionkey AS k"))


@query("h2_union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def _(s, d):
    return t.read(s, d, "lineitem").selectExpr("l_partkey AS k").unionByName(t.read(s, d, "part").selectExpr("p_partkey AS k")).distinct()


@query("h3_intersect", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return t.read(s, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS k").intersect(t.read(s, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS k"))


@query("h4_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def _(s, d):
    return t.read(s, d, "orders").selectExpr("o_orderkey AS k").subtract(t.read(s, d, "lineitem").selectExpr("l_orderkey AS k"))


@query("h5_settings_difference", "WITH a AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer), b AS (SELECT c_custkey + 3 AS key, c_mktsegment AS value FROM customer) SELECT key, a.value AS a, b.value AS b FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def _(s, d):
    c = t.read(s, d, "customer")
    return orders.settings_difference(c.selectExpr("c_custkey AS key", "c_mktsegment AS value"), c.selectExpr("c_custkey + 3 AS key", "c_mktsegment AS value"))


# -- scalar families --------------------------------------------------------------------------------


@query("i_string_hash_json", "SELECT event_id, sha256(props) AS digest, (props->>'$.k')::BIGINT AS k, strftime(ts, '%Y%m%d') AS day FROM events")
def _(s, d):
    return t.read(s, d, "events").select("event_id", F.sha2("props", 256).alias("digest"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyyMMdd").alias("day"))


@query("i_math", f"WITH {PTS} SELECT id, round(sqrt(x) + exp(-y / 50) + ln(x + 1), 6) AS a, round(degrees(atan2(y, x)), 6) AS angle, round_even(x * 2, 0)::BIGINT AS r, floor(x)::BIGINT AS f, ceil(x)::BIGINT AS c, gcd(id, 36) AS g FROM pts")
def _(s, d):
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(F.col("id").alias("a"), F.lit(36).cast("long").alias("b")), lambda a, _: F.when(a["b"] == 0, a).otherwise(F.struct(a["b"].alias("a"), F.try_mod(a["a"], a["b"]).alias("b"))))["a"]
    return t.points(s, d).select("id", fn.rounded(F.sqrt("x") + F.exp(-F.col("y") / 50) + F.log(F.col("x") + 1), 6).alias("a"), fn.rounded(F.degrees(F.atan2("y", "x")), 6).alias("angle"), F.rint(F.col("x") * 2).cast("long").alias("r"), F.floor("x").alias("f"), F.ceil("x").alias("c"), gcd.alias("g"))


@query("i_interpolate", f"WITH {PTS}, a AS (SELECT y, x AS px, d AS pd FROM (SELECT y, x, min(d) AS d FROM pts GROUP BY 1, 2)), w AS (SELECT DISTINCT y, 50.5::DOUBLE AS x FROM pts), b AS (SELECT w.y, w.x, max(px) FILTER (px <= w.x) AS x0, min(px) FILTER (px >= w.x) AS x1 FROM w JOIN a USING (y) GROUP BY 1, 2), v AS (SELECT b.*, (SELECT pd FROM a WHERE a.y = b.y AND px = coalesce(x0, x1)) AS v0, (SELECT pd FROM a WHERE a.y = b.y AND px = coalesce(x1, x0)) AS v1 FROM b) SELECT y AS line, x, round(CASE WHEN x0 IS NULL OR x1 IS NULL OR x0 = x1 THEN v0 ELSE v0 + (v1 - v0) * (x - x0) / (x1 - x0) END, 6) AS y FROM v")
def _(s, d):
    a = t.points(s, d).groupBy(F.col("y").alias("line"), "x").agg(F.min("d").alias("d"))
    w = a.select("line").distinct().withColumn("x", F.lit(50.5))
    return r6(windows.interpolate(a, w, "x", "d", ["line"]), "y")


@query("i_regression", f"WITH {PTS} SELECT g, round(regr_slope(x, y), 6) AS slope, round(regr_intercept(x, y), 6) AS intercept FROM pts GROUP BY 1")
def _(s, d):
    return r6(t.points(s, d).groupBy("g").agg(F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("intercept")), "slope", "intercept")


@query("i_array_map", f"WITH {MEAS} SELECT page, cell_id, round(max(value) FILTER (method = 'a'), 9) AS a, count(*) AS n, round(sum(value), 9) AS total FROM meas GROUP BY 1, 2")
def _(s, d):
    m = t.measurements(s, d).groupBy("page", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "value"))).alias("m"))
    return m.select("page", "cell_id", fn.rounded(F.element_at("m", "a"), 9).alias("a"), F.size(F.map_keys("m")).cast("long").alias("n"), fn.rounded(F.aggregate(F.array_sort(F.map_values("m")), F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


# -- pixels -----------------------------------------------------------------------------------------


@query("j1_otsu_threshold", f"""WITH {PX}, b AS (SELECT page, round_even((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w), 0)::BIGINT AS l FROM px WINDOW w AS (PARTITION BY page)), h AS (SELECT page, l, count(*) AS n FROM b GROUP BY 1, 2),
r AS (SELECT page, l, sum(n) OVER (PARTITION BY page ORDER BY l) AS c, sum(n * l) OVER (PARTITION BY page ORDER BY l) AS s, sum(n) OVER (PARTITION BY page) AS ca, sum(n * l) OVER (PARTITION BY page) AS sa FROM h), z AS (SELECT page, l, CASE WHEN ca = c THEN -1 ELSE round(c::DOUBLE * (ca - c)::DOUBLE * pow(s::DOUBLE / c::DOUBLE - (sa - s)::DOUBLE / (ca - c)::DOUBLE, 2), 6) END AS q FROM r) SELECT page, arg_max(l, (q, -l)) AS threshold FROM z GROUP BY 1""")
def _(s, d):
    from gridscope.operators.filters import byte_scaled

    return stats.otsu_threshold(byte_scaled(t.pixels(s, d)))


@query("k1_weighted_centroid", f"WITH {PX}, b AS (SELECT page, median(v) AS bg FROM px GROUP BY 1), w AS (SELECT page, x // 8 AS seed_id, x, y, greatest(v - bg, 0) AS w FROM px JOIN b USING (page)) SELECT page, seed_id, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy FROM w GROUP BY 1, 2")
def _(s, d):
    p = t.pixels(s, d).withColumn("seed_id", F.floor(F.col("x") / 8))
    b = p.groupBy("page").agg(F.percentile("v", F.lit(0.5)).alias("background")).join(p.select("page", "seed_id").distinct(), "page")
    return r6(stats.weighted_centroid(p, b), "cx", "cy")


@query("l6_flux_ratio", f"WITH {MEAS} SELECT page, cell_id, round(2 * sqrt(greatest(value, 0) / (100 - 5) / pi()) * 1.1, 6) AS cd FROM meas WHERE method = 'b' AND valid")
def _(s, d):
    m = t.measurements(s, d).where("method = 'b' AND valid")
    return m.select("page", "cell_id", fn.rounded(F.sqrt(F.greatest("value", F.lit(0.0)) / (100 - 5) / F.pi()) * 2 * 1.1, 6).alias("cd"))


@query("l22_polygon_area", f"WITH {PTS}, v AS (SELECT g, p % 50 AS c, row_number() OVER (PARTITION BY g, p % 50 ORDER BY atan2(y - 25, x - 40), id) AS k, x, y FROM pts), n AS (SELECT g, c, x, y, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY g, c ORDER BY k)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY g, c ORDER BY k)) AS ny FROM v WINDOW w AS (PARTITION BY g, c ORDER BY k)), a AS (SELECT g, c, abs(sum(x * ny - nx * y)) / 2 AS area, max(x) - min(x) AS cd_x, max(y) - min(y) AS cd_y, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM n GROUP BY 1, 2) SELECT g, c, round(area, 6) AS area, round(cd_x, 6) AS cd_x, round(cd_y, 6) AS cd_y, round(perimeter, 6) AS perimeter, round(2 * sqrt(area / pi()), 6) AS cd_equivalent FROM a")
def _(s, d):
    v = t.points(s, d).withColumn("c", F.col("p") % 50).withColumn("a", F.atan2(F.col("y") - 25, F.col("x") - 40))
    v = windows.within_index(v, ["g", "c"], ["a", "id"])
    return r6(stats.polygon_area(v, ["g", "c"], "k"), "area", "cd_x", "cd_y", "perimeter", "cd_equivalent")


_SHAPES = "v AS (SELECT g, p % 50 AS c, x, y FROM pts)"


@query("l23_contour_rays", f"WITH {PTS}, {_SHAPES}, m AS (SELECT g, c, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY 1, 2), r AS (SELECT g, c, x - cx AS dx, y - cy AS dy FROM v JOIN m USING (g, c)) SELECT g, c, ((floor(atan2(dy, dx) / (2 * pi()) * 8 + 0.5)::BIGINT + 8) % 8)::INT AS ray, round(avg(sqrt(dx * dx + dy * dy)), 6) AS radius, count(*) AS n FROM r GROUP BY 1, 2, 3")
def _(s, d):
    v = t.points(s, d).withColumn("c", F.col("p") % 50).select("g", "c", "x", "y")
    return r6(stats.contour_rays(v, ["g", "c"], 8), "radius")


@query("l23_moment_widths", f"WITH {PTS}, {_SHAPES}, m AS (SELECT g, c, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM v GROUP BY 1, 2), e AS (SELECT *, (xx + yy) / 2 AS m, sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS h FROM m) SELECT g, c, round(2 * sqrt(2 * (m + h)), 6) AS long, round(2 * sqrt(2 * greatest(m - h, 0)), 4) AS short, round(degrees(atan2(2 * xy, xx - yy) / 2), 4) AS angle FROM e")
def _(s, d):
    v = t.points(s, d).withColumn("c", F.col("p") % 50).select("g", "c", "x", "y")
    got = r6(stats.moment_widths(v, ["g", "c"]), "long")
    return got.withColumns({n: fn.rounded(n, 4) for n in ("short", "angle")})


@query("l24_layer_values", f"WITH {MEAS} SELECT page, cell_id, method, CASE WHEN valid THEN value END AS layer, round(value - avg(CASE WHEN valid THEN value END) OVER (PARTITION BY page, method), 6) AS from_page_mean FROM meas")
def _(s, d):
    from pyspark.sql import Window

    m = t.measurements(s, d).withColumn("layer", F.when(F.col("valid"), F.col("value")))
    off = F.col("value") - F.avg("layer").over(Window.partitionBy("page", "method"))
    return m.select("page", "cell_id", "method", "layer", fn.rounded(off, 6).alias("from_page_mean"))


# -- pitch and lattice ------------------------------------------------------------------------------


@query("p2_index_pitch", f"""WITH {PTS}, o AS (SELECT g, quantile_cont(x, 0.05) AS x0, quantile_cont(y, 0.05) AS y0 FROM pts GROUP BY g),
a1 AS (SELECT g, x, y, x0, y0, round_even((x - x0) / 1.02, 0) AS i, round_even(y - y0, 0) AS j FROM pts JOIN o USING (g)),
f1 AS (SELECT g, regr_slope(x, i) AS sx, regr_intercept(x, i) AS cx, regr_slope(y, j) AS sy, regr_intercept(y, j) AS cy FROM a1 GROUP BY g),
a2 AS (SELECT g, x, y, round_even((x - x0) / sx, 0) AS i, round_even((y - y0) / sy, 0) AS j FROM a1 JOIN f1 USING (g) WHERE abs(x - (cx + sx * i)) <= abs(sx) * 0.35 AND abs(y - (cy + sy * j)) <= abs(sy) * 0.35),
f2 AS (SELECT g, regr_slope(x, i) AS sx, regr_intercept(x, i) AS cx, regr_slope(y, j) AS sy, regr_intercept(y, j) AS cy FROM a2 GROUP BY g)
SELECT g, round(any_value(sx), 6) AS pitch_x, round(any_value(sy), 6) AS pitch_y, round(any_value(cx), 6) AS ox, round(any_value(cy), 6) AS oy, count(*) FILTER (abs(x - (cx + sx * i)) <= abs(sx) * 0.35 AND abs(y - (cy + sy * j)) <= abs(sy) * 0.35) AS kept FROM a2 JOIN f2 USING (g) GROUP BY g""")
def _(s, d):
    p = t.points(s, d)
    start = p.select("g").distinct().withColumn("pitch_x", F.lit(1.02)).withColumn("pitch_y", F.lit(1.0))
    return r6(pitch.index_pitch(p, start, group=["g"]), "pitch_x", "pitch_y", "ox", "oy")


@query("p3_line_pitches", f"""WITH RECURSIVE {PTS}, v AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY y) AS k FROM pts GROUP BY 1),
r(k, y, n, line, s, c) AS (SELECT k, y, n, 0, y * n, n::DOUBLE FROM v WHERE k = 1
UNION ALL SELECT v.k, v.y, v.n, CASE WHEN abs(v.y - r.s / r.c) <= 0.4 THEN r.line ELSE r.line + 1 END, CASE WHEN abs(v.y - r.s / r.c) <= 0.4 THEN r.s + v.y * v.n ELSE v.y * v.n END, CASE WHEN abs(v.y - r.s / r.c) <= 0.4 THEN r.c + v.n ELSE v.n END FROM r JOIN v ON v.k = r.k + 1),
lp AS (SELECT pts.*, line FROM pts JOIN r USING (y)), {_DIFFS}
SELECT line, n, round(center, 6) AS center, CASE WHEN n >= 3 THEN round(pitch, 6) END AS pitch, kept FROM (SELECT line, count(*) AS n, avg(y) AS center FROM lp GROUP BY 1) LEFT JOIN kp USING (line)""")
def _(s, d):
    return r6(pitch.line_pitches(t.points(s, d), 0.4), "center", "pitch")


@query("p4_histogram_pitches", f"""WITH {PTS}, b AS (SELECT g, floor(y / 0.75)::BIGINT AS bin, count(*) AS n, avg(y) AS mean FROM pts GROUP BY 1, 2),
pk AS (SELECT a.g, a.bin, a.n, a.mean FROM b a LEFT JOIN b l ON l.g = a.g AND l.bin = a.bin - 1 LEFT JOIN b r ON r.g = a.g AND r.bin = a.bin + 1 WHERE a.n >= 5 AND a.n > coalesce(l.n, 0) AND a.n >= coalesce(r.n, 0)),
nw AS (SELECT *, CASE WHEN mean - lag(mean) OVER (PARTITION BY g ORDER BY mean) > 0.75 THEN 1 ELSE 0 END AS new FROM pk),
ln AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY mean)::BIGINT AS line FROM nw),
hl AS (SELECT g, line, sum(mean * n) / sum(n) AS center FROM ln GROUP BY 1, 2),
own AS (SELECT g, id, x, line FROM (SELECT pts.g, id, x, line, row_number() OVER (PARTITION BY pts.g, id ORDER BY abs(y - center), line) AS k FROM pts JOIN hl ON pts.g = hl.g AND abs(y - center) <= 0.75) WHERE k = 1),
df AS (SELECT g, line, x - lag(x) OVER (PARTITION BY g, line ORDER BY x, id) AS d FROM own)
SELECT g, line, round(median(d), 6) AS pitch, count(*) AS n, round(stddev_pop(d) / avg(d), 6) AS cv FROM df WHERE d > 0 GROUP BY 1, 2 HAVING stddev_pop(d) / avg(d) <= 5""")
def _(s, d):
    p = t.points(s, d)
    return r6(pitch.histogram_pitches(p, stats.histogram_lines(p, "y", 0.75, 5, ["g"]).drop("n"), 0.75, 5.0, ["g"]), "pitch", "cv")


@query("p5_pitch_residuals", f"WITH {PTS} SELECT id, round_even((x - 1) / 2.5, 0)::BIGINT AS index, round(x - (1 + round_even((x - 1) / 2.5, 0) * 2.5), 6) AS residual FROM pts")
def _(s, d):
    i, r = pitch.residual_to_grid(F.col("x"), F.lit(2.5), F.lit(1.0))
    return t.points(s, d).select("id", i.alias("index"), fn.rounded(r, 6).alias("residual"))


@query("p6_line_residuals", f"""WITH {_LINES}, q AS (SELECT *, min(x) OVER (PARTITION BY line) AS x0 FROM lp), i AS (SELECT id, line, x, round_even((x - x0) / 0.5, 0)::BIGINT AS k FROM q), f AS (SELECT line, count(*) AS n, min(k) AS a, max(k) AS z, regr_slope(x, k::DOUBLE) AS s, regr_intercept(x, k::DOUBLE) AS c, avg(x) AS m FROM i GROUP BY 1)
SELECT id, line, k AS index, CASE WHEN n >= 2 THEN round(x - CASE WHEN a = z THEN m ELSE c + s * k END, 6) END AS residual FROM i JOIN f USING (line)""")
def _(s, d):
    return r6(pitch.line_residuals(t.points(s, d).select("id", "x", "y"), 0.5, 0.5), "residual").select("id", "line", "index", "residual")


@query("p7_distortion_field", f"""WITH {PTS}, {_CLOUD}, {_RMAP}, k3 AS (SELECT i, exp(-i * i / 18.0::DOUBLE) AS k FROM (SELECT unnest(range(-9, 10)) AS i)), k1 AS (SELECT i, exp(-i * i / 4.5::DOUBLE) AS k FROM (SELECT unnest(range(-4, 5)) AS i)),
m1 AS (SELECT a.line, a.bin, sum(k * m.n * m.value) / sum(k * m.n) AS value FROM rm a JOIN k3 ON true JOIN rm m ON m.line = a.line AND m.bin = a.bin - k3.i GROUP BY 1, 2)
SELECT a.line, a.bin, round(sum(k * m.value) / sum(k), 6) AS value FROM m1 a JOIN k1 ON true JOIN m1 m ON m.bin = a.bin AND m.line = a.line - k1.i GROUP BY 1, 2""")
def _(s, d):
    return r6(pitch.distortion_field(_cloud(s, d), 8), "value")


@query("i_field_lookup", f"""WITH {PTS}, {_CLOUD}, {_RMAP}, w AS (SELECT id, floor((x - 0.9) / 8 - 0.5)::BIGINT AS b, (x - 0.9) / 8 - 0.5 - floor((x - 0.9) / 8 - 0.5) AS u, floor(y + 0.25)::BIGINT AS l, (y + 0.25) - floor(y + 0.25) AS s FROM pts),
c AS (SELECT id, b + i AS bin, l + j AS line, (CASE i WHEN 0 THEN 1 - u ELSE u END) * (CASE j WHEN 0 THEN 1 - s ELSE s END) AS wt FROM w, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
g AS (SELECT id, sum(wt * value) / nullif(sum(wt), 0) AS value FROM c JOIN rm USING (bin, line) GROUP BY 1) SELECT id, round(value, 6) AS value FROM pts LEFT JOIN g USING (id)""")
def _(s, d):
    f = stats.residual_map(_cloud(s, d), 8)
    w = t.points(s, d).select("id", "x", (F.col("y") + 0.25).alias("line"))
    return r6(pitch.field_lookup(f, w, 8, 0.9), "value")


@query("p8_p10_lattice_profile", f"""WITH {LAT}, {_PAIRX}, pf AS (SELECT g, col AS node, count(*) AS pairs, avg(step) AS pitch, stddev_samp(step) AS sd FROM pr GROUP BY 1, 2), n AS (SELECT g, unnest(range(0, m + 1)) AS node FROM (SELECT g, max(col) AS m FROM lat GROUP BY 1)) SELECT n.g, n.node, round(pitch + {OFF}, 6) AS pitch, round(sd, 6) AS sd, coalesce(pairs, 0) AS pairs FROM n LEFT JOIN pf ON pf.g = n.g AND pf.node = n.node""")
def _(s, d):
    return r6(off_ties(pitch.lattice_profile(t.lattice(s, d), "x", ["g"], reference=50), "pitch"), "pitch", "sd").select("g", "node", "pitch", "sd", "pairs")


@query("p12_stripe_board", f"""WITH {PTS}, q AS (SELECT id, x, (y + 51 * (p % 60)) AS gy, g FROM pts WHERE x >= 5 AND x < 100 AND y >= 5 AND y < 46) SELECT id, x AS gx, gy FROM q WHERE gy >= 0""")
def _(s, d):
    from gridscope.operators import filters

    p = filters.margin_filter(t.points(s, d), 105, 51, 5).select("id", "x", "y", F.col("g").alias("stripe"), F.lit(0).alias("board"), (F.col("p") % 60).alias("page"))
    none = t.read(s, d, "region").where("false")
    stripes = none.selectExpr("cast(r_regionkey as bigint) AS stripe", "0.0D AS dx", "0.0D AS dy", "cast(null as double) AS total_height")
    boards = none.selectExpr("r_regionkey AS board", "0.0D AS dx", "0.0D AS dy")
    return filters.map_to_global(p, stripes, boards, 51).select("id", "gx", "gy")


# -- spectra and registration -----------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id, i AS k, embedding[i + 1]::DOUBLE AS y FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"


def _series(s, d):
    e = t.read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "y"))
    return e.select("vec_id", F.col("k").cast("long").alias("k"), F.col("y").cast("double").alias("y"))


def _grid(g, dx):
    """SQL of u: e (g, x, value) on even places, between the samples before and after each."""
    return f"""gp AS (SELECT {g}, x, x - lag(x) OVER (PARTITION BY {g} ORDER BY x) AS gap FROM e), st AS (SELECT {g}, min(x) AS x0, max(x) AS x1, {dx} AS dx FROM gp GROUP BY 1),
gr AS (SELECT {g}, k, x0 + k * dx AS x FROM (SELECT *, unnest(range(0, floor((x1 - x0) / dx + 1e-9)::BIGINT + 1)) AS k FROM st WHERE dx > 0)),
lo AS (SELECT gr.{g}, gr.k, gr.x, e.x AS xa, e.value AS ya FROM gr ASOF LEFT JOIN e ON gr.{g} = e.{g} AND gr.x >= e.x),
u AS (SELECT lo.{g}, lo.k, lo.x, coalesce(ya, e.value) + (coalesce(e.value, ya) - coalesce(ya, e.value)) * coalesce((lo.x - coalesce(xa, e.x)) / nullif(coalesce(e.x, xa) - coalesce(xa, e.x), 0), 0) AS y FROM lo ASOF LEFT JOIN e ON lo.{g} = e.{g} AND lo.x <= e.x)"""


def _amplitudes(g):
    """SQL of am: amplitudes of dw (g, k, n, y, w) at whole frequencies."""
    return f"""am AS (SELECT {g}, f, any_value(n) AS n, 2 * sqrt(pow(sum(w * y * cos(((f * k) % n) * 6.283185307179586 / n)), 2) + pow(sum(w * y * sin(((f * k) % n) * 6.283185307179586 / n)), 2)) / sum(w) AS a FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS f FROM dw) GROUP BY 1, 2)"""


@query("q1_resample_uniform", f"""WITH e AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS x, value FROM events), {_grid('user_id', 'median(gap) FILTER (gap > 0)')} SELECT user_id, k, round(x, 6) AS x, round(y, 6) AS y FROM u""")
def _(s, d):
    e = t.read(s, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    return r6(spectra.resample_uniform(e, "x", "value", ["user_id"]), "x", "y")


@query("q2_detrend", f"WITH {_VEC}, f AS (SELECT vec_id, regr_slope(y, k) AS s, avg(y) AS my, avg(k) AS mk FROM v GROUP BY 1) SELECT vec_id, k, round(y - my - s * (k - mk), 6) AS y FROM v JOIN f USING (vec_id)")
def _(s, d):
    return r6(spectra.detrend(_series(s, d), "y", "k", "linear", ["vec_id"]), "y")


_DFT = """w AS (SELECT vec_id, k, y, 0.5 - 0.5 * cos(6.283185307179586 * k / 63) AS w FROM v), g AS (SELECT vec_id, f, sqrt(pow(sum(w * y * cos(((f * k) % 64) * 6.283185307179586 / 64)), 2) + pow(sum(w * y * sin(((f * k) % 64) * 6.283185307179586 / 64)), 2)) * 2 / sum(w) AS amplitude FROM w, (SELECT unnest(range(1, 33)) AS f) GROUP BY 1, 2)"""


@query("q3_dft_spectrum", f"WITH {_VEC}, {_DFT} SELECT vec_id, round(f / 64, 6) AS frequency, round(amplitude, 6) AS amplitude, round(64 / f, 6) AS period FROM g")
def _(s, d):
    return r6(spectra.dft_amplitudes(_series(s, d), "y", "k", ["vec_id"]), "frequency", "amplitude", "period")


@query("g1_top_periods", f"WITH {_VEC}, {_DFT} SELECT vec_id, round(f / 64, 6) AS frequency, round(amplitude, 6) AS amplitude, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(amplitude, 9) DESC, f) AS rank FROM g) WHERE rank <= 5")
def _(s, d):
    a = spectra.dft_amplitudes(_series(s, d), "y", "k", ["vec_id"]).withColumn("key", fn.rounded("amplitude", 9))
    return r6(orders.top_k(a, "key", 5, ["vec_id"], ["frequency"]), "frequency", "amplitude").select("vec_id", "frequency", "amplitude", "rank")


@query("q4_periodicity_uniform", f"WITH {_VEC}, g AS (SELECT vec_id, f, sqrt(pow(sum(y * cos(((f * k) % 64) * 6.283185307179586 / 64)), 2) + pow(sum(y * sin(((f * k) % 64) * 6.283185307179586 / 64)), 2)) * 2 / 64 AS a FROM v, (SELECT unnest(range(0, 33)) AS f) GROUP BY 1, 2) SELECT vec_id, round(f / 64, 6) AS frequency, round(a, 6) AS amplitude FROM g")
def _(s, d):
    return r6(spectra.dft_amplitudes(_series(s, d), "y", "k", ["vec_id"], window="none", keep_zero=True), "frequency", "amplitude").select("vec_id", "frequency", "amplitude")


@query("q5_resampled_spectrum", f"""WITH e AS (SELECT event_type, floor(epoch_us(ts) / 3.6e9) AS x, avg(value) AS value FROM events GROUP BY 1, 2), {_grid('event_type', '1.0')},
dt AS (SELECT event_type, regr_slope(y, x) AS s, avg(y) AS my, avg(x) AS mx, count(*) AS n FROM u GROUP BY 1), dw AS (SELECT event_type, k, n, y - my - s * (x - mx) AS y, 0.5 - 0.5 * cos(6.283185307179586 * k / (n - 1)) AS w FROM u JOIN dt USING (event_type)), {_amplitudes('event_type')}
SELECT event_type, round(f / n, 6) AS frequency, round(a, 6) AS amplitude, round(n / f, 6) AS period FROM am""")
def _(s, d):
    e = t.read(s, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    hourly = e.groupBy("event_type", F.floor("x").cast("double").alias("x")).agg(F.avg("value").alias("value"))
    return r6(spectra.pitch_error_spectrum(hourly, "x", "value", ["event_type"], 1.0), "frequency", "amplitude", "period")


@query("q6_lomb_scargle", """WITH e AS (SELECT event_type, epoch_us(ts) / 3.6e9 - 473352 AS x, value - avg(value) OVER (PARTITION BY event_type) AS y FROM events), f AS (SELECT unnest(range(1, 65)) / 100 AS frequency),
g AS (SELECT event_type, frequency, sum(y * cos(6.283185307179586 * x * frequency)) AS yc, sum(y * sin(6.283185307179586 * x * frequency)) AS ys, sum(pow(cos(6.283185307179586 * x * frequency), 2)) AS cc, sum(pow(sin(6.283185307179586 * x * frequency), 2)) AS ss, sum(cos(6.283185307179586 * x * frequency) * sin(6.283185307179586 * x * frequency)) AS cs FROM e, f GROUP BY 1, 2),
h AS (SELECT *, atan2(2 * cs, cc - ss) / 2 AS u FROM g) SELECT event_type, frequency, round((pow(yc * cos(u) + ys * sin(u), 2) / (pow(cos(u), 2) * cc + 2 * cos(u) * sin(u) * cs + pow(sin(u), 2) * ss) + pow(ys * cos(u) - yc * sin(u), 2) / (pow(cos(u), 2) * ss - 2 * cos(u) * sin(u) * cs + pow(sin(u), 2) * cc)) / 2, 4) AS power FROM h""")
def _(s, d):
    e = t.read(s, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("x"), "value")
    f = s.range(1, 65).select((F.col("id") / 100).alias("frequency"))
    return spectra.lomb_scargle(e, "x", "value", f, ["event_type"]).select("event_type", "frequency", fn.rounded("power", 4).alias("power"))


@query("q8_apply_shift", f"""WITH {PX}, s AS (SELECT page, x + j AS x, y + i AS y, v * wy * wx AS v, wy * wx AS w FROM px, (VALUES (1, 0.75::DOUBLE), (2, 0.25)) a(i, wy), (VALUES (-3, 0.5::DOUBLE), (-2, 0.5)) b(j, wx)), g AS (SELECT page, x, y, sum(v) AS v, sum(w) AS w FROM s GROUP BY ALL) SELECT px.page, px.x, px.y, round(CASE WHEN w > 1 - 1e-9 THEN g.v ELSE 0 END, 6) AS v FROM px LEFT JOIN g USING (page, x, y)""")
def _(s, d):
    return r6(spectra.apply_shift(t.pixels(s, d), 1.25, -2.5), "v")


@query("q9_overlap_rmse", f"WITH {PX} SELECT a.page, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 6) AS rmse, count(*) AS n FROM px a JOIN px b ON a.page = b.page AND a.x = b.x + 2 AND a.y = b.y - 1 GROUP BY 1")
def _(s, d):
    p = t.pixels(s, d)
    return r6(spectra.overlap_rmse(spectra.overlap(p, p, -1.2, 2.3)), "rmse")


@query("r8_throughput", f"WITH {TM} SELECT worker, count(*) FILTER (status = 'ok') AS pages, round(count(*) FILTER (status = 'ok') / sum(measure_s), 6) AS pages_per_s FROM tm GROUP BY 1")
def _(s, d):
    return t.timings(s, d).groupBy("worker").agg(F.count_if(F.col("status") == "ok").alias("pages"), fn.rounded(F.count_if(F.col("status") == "ok") / F.sum("measure_s"), 6).alias("pages_per_s"))
