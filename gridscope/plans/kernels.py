"""Driver queries of the page operators, on pages rendered per label: no SQL, tests hold them to known truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridscope.kernels import measure as m
from gridscope.operators import pages as p
from gridscope.operators import pitch, stats
from gridscope.plans import tables as t
from gridscope.plans.ordered import _amplitudes
from gridscope.plans.relational import QUERIES, query, r6
from gridscope.sources.pages import explode_pixels, synthetic_pages


def _pages(s, d, seed=0):
    """A page per nation, rendered."""
    n = t.read(s, d, "nation").select(F.col("n_nationkey").alias("page"), (F.col("n_nationkey") + seed).alias("seed"))
    return synthetic_pages(n.repartition(8, "page"))


def _flat(df):
    return df.drop("contour").withColumn("metrics", F.to_json("metrics")) if "metrics" in df.columns else df


@query("a4_a17_pages")
def _(s, d):
    return _pages(s, d).select("file", "page", "height", "width", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("e1_components")
def _(s, d):
    return p.component_labels(_pages(s, d))


@query("j7_detect_centers")
def _(s, d):
    return p.detect_centers(_pages(s, d), threshold="otsu", area=(2, 400), method="weighted")


@query("j8_detect_tiled")
def _(s, d):
    return p.detect_centers(_pages(s, d), threshold="otsu", area=(2, 400), method="weighted", tile=60, overlap=24)


@query("j10_peaks")
def _(s, d):
    return p.detect_peaks(_pages(s, d), 8)


@query("j11_spacing")
def _(s, d):
    return p.page_spacing(_pages(s, d))


for _name in ("logquad", "edge_gradmoment", "edge_erf", "radial_symmetry", "isophote_curvature"):

    @query(f"k_{_name}")
    def _(s, d, method=_name):
        return p.detect_centers(_pages(s, d), threshold="otsu", area=(2, 400), method=method)


@query("l_model_sizes")
def _(s, d):
    return _flat(p.measure_pages(_pages(s, d), m.MODEL_METHODS, threshold="otsu", nominal=4.0, with_contours=False, rounds=6))


@query("l_local_sizes")
def _(s, d):
    return _flat(p.measure_pages(_pages(s, d), ("logquad", "gradient", "halfmax", *m.LOCAL_METHODS), threshold="otsu", background="border", with_contours=False))


@query("n_outline_fit")
def _(s, d):
    return p.outline_pages(_pages(s, d))


@query("n_outline_fit_fast")
def _(s, d):
    return p.outline_pages(_pages(s, d), fast=True)


for _name in ("gaussian", "wiener", "mean_hole"):

    @query(f"o_{_name}")
    def _(s, d, kind=_name):
        got = p.filter_pages(_pages(s, d), kind)
        return got.select("file", "page", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("p9_lattice_index")
def _(s, d):
    c = p.detect_centers(_pages(s, d), threshold="otsu", area=(2, 400), method="weighted")
    return p.index_lattice(c)


@query("p8_analyze_pitch")
def _(s, d):
    c = p.detect_centers(_pages(s, d), threshold="otsu", area=(2, 400), method="weighted")
    l = p.index_lattice(c).where("indexed")  # noqa: E741
    lat = l.join(c.select("page", F.col("id").alias("seed_id"), "x", "y"), ["page", "seed_id"]).selectExpr("page", "row_idx AS row", "col_idx AS col", "x", "y")
    return pitch.lattice_profile(lat, "x", ["page"])


@query("q4_fft_series", f"""WITH e AS (SELECT event_type, floor(epoch_us(ts) / 3.6e9) AS h, avg(value) AS v FROM events GROUP BY 1, 2), o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY h) - 1 AS k FROM e),
dt AS (SELECT event_type, regr_slope(v, k) AS s, avg(v) AS my, avg(k) AS mk, count(*) AS n FROM o GROUP BY 1), dw AS (SELECT event_type, k, n, v - my - s * (k - mk) AS y, 0.5 - 0.5 * cos(6.283185307179586 * k / (n - 1)) AS w FROM o JOIN dt USING (event_type)), {_amplitudes('event_type')}
SELECT event_type AS series, round(f / n, 6) AS frequency, round(a, 6) AS amplitude, round(n / f, 6) AS period FROM am""")
def _(s, d):
    e = t.read(s, d, "events").groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.avg("value").alias("v"))
    return r6(p.fft_spectrum(e, "event_type", "h", "v"), "frequency", "amplitude", "period")


@query("q7_q10_register")
def _(s, d):
    return p.register_pages(_pages(s, d), _pages(s, d, 100))


@query("r4_page_rows")
def _(s, d):
    from gridscope.streaming.runs import page_rows

    rows = page_rows(p.measure_pages(_pages(s, d), ("logquad", "halfmax"), threshold="otsu", background="border", with_contours=False))
    return rows.select("file", "page", "holes", "status", F.to_json("valid").alias("valid"), F.to_json("cd").alias("cd"))


@query("e9_page_tiles")
def _(s, d):
    return stats.tile_medians(explode_pixels(_pages(s, d)), 16)


__all__ = ["QUERIES"]
