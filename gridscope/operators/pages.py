"""Page operators: one page is one row and one task's work; wanted outputs are arguments, so nothing else is built."""

from __future__ import annotations

import contextlib
import signal
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.schemas import LATTICE

KEYS = ["file", "page"]
CENTERS = "file string, page int, id long, x double, y double, area double"
MEASURED = (
    "file string, page int, cell_id long, method string, valid boolean, status string, center_x double, center_y double, "
    "metrics map<string,double>, contour array<struct<x:double,y:double>>, holes int, converged boolean, rounds int"
)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    for b in batches:
        narrow = [b.column(c).to_pylist() for c in ("file", "page", "height", "width")]
        for i, (file, page, height, width) in enumerate(zip(*narrow)):
            yield file, page, np.array(b.column("pixels")[i].values.to_numpy(zero_copy_only=False)).reshape(height, width)


@contextlib.contextmanager
def _limited(seconds: float | None) -> Iterator[None]:
    """Ends what runs inside with a TimeoutError after the given seconds, where signals reach this thread."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"not done after {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def map_pages(pages: DataFrame, f: Callable[[np.ndarray], list[dict]], schema: str, timeout: float | None = None, stop_after: int | None = None) -> DataFrame:
    """Rows (file, page, ..., error) that a function makes of each page's image; schema names the function's columns.

    A page that can't be read, or measured within ``timeout`` seconds, is one row with the
    error and nulls; the others go on.  After ``stop_after`` failures in a row within one task
    the job ends with the last one: something is wrong with more than a page.
    """
    ship(pages.sparkSession)
    full = "file string, page int, " + schema + ", error string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for file, page, image in _images(batches):
            try:
                with _limited(timeout):
                    rows, failed = [{"file": file, "page": page, **r} for r in f(image)], 0
            except Exception as e:  # noqa: BLE001  a bad page is a row, not the end of the run
                failed += 1
                if stop_after and failed >= stop_after:
                    raise RuntimeError(f"{failed} pages in a row failed, the last ({file}, {page})") from e
                rows = [{"file": file, "page": page, "error": f"{type(e).__name__}: {e}"}]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ok = pages.where("error IS NULL").select("file", "page", "height", "width", "pixels").mapInArrow(run, full)
    names = [n for n in kind.names if n not in ("file", "page", "error")]
    bad = pages.where("error IS NOT NULL").select("file", "page", *[F.lit(None).cast(ok.schema[n].dataType).alias(n) for n in names], "error")
    return ok.unionByName(bad) if not pages.isStreaming else ok


def detect_centers(pages: DataFrame, **options) -> DataFrame:
    """(file, page, id, x, y, area) of the bright components of each page."""

    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels.cells import detect

        return [{"id": i, "x": x, "y": y, "area": a} for i, (x, y, a, _) in enumerate(detect(image, **options).tolist())]

    return map_pages(pages, f, "id long, x double, y double, area double")


def detect_peaks(pages: DataFrame, distance: float, sigma: float = 1.0, threshold: float = 0.25) -> DataFrame:
    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels.images import peaks

        return [{"id": i, "x": x, "y": y} for i, (x, y) in enumerate(peaks(image, distance, sigma, threshold).tolist())]

    return map_pages(pages, f, "id long, x double, y double")


def page_spacing(pages: DataFrame) -> DataFrame:
    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels.images import estimate_spacing

        s = estimate_spacing(image)
        return [{"spacing": s if np.isfinite(s) else None}]

    return map_pages(pages, f, "spacing double")


def component_labels(pages: DataFrame, threshold: str | float = "otsu", **options) -> DataFrame:
    """(file, page, label, bx, by, w, h, area, cx, cy): label 0 is the background."""

    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels import images

        t = images.component_table(images.components(images.segment(image, threshold, **options)))
        names = {"bx": "x", "by": "y", "w": "w", "h": "h", "area": "area", "cx": "cx", "cy": "cy"}
        return [{"label": k, **{n: t[c][k].item() for n, c in names.items()}} for k in range(len(t["area"]))]

    return map_pages(pages, f, "label int, bx int, by int, w int, h int, area long, cx double, cy double")


def measure_pages(
    pages: DataFrame, methods: tuple[str, ...], check: Callable[[np.ndarray], str | None] | None = None, timeout: float | None = None, stop_after: int | None = None, **options
) -> DataFrame:
    """One row per cell and method; a page whose measurement fails has one row with its error.

    ``check`` sees each page before it is measured: a reason that it returns is the page's
    only row, with the status "rejected: reason".
    """
    schema = MEASURED.removeprefix("file string, page int, ")

    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels.measure import measure

        reason = check(image) if check else None
        if reason:
            return [{"cell_id": None, "method": None, "valid": False, "status": f"rejected: {reason}"}]
        rows, page = measure(image, methods, **options)
        if not rows:
            return [{"cell_id": None, "method": None, "valid": False, "status": "no_holes", "holes": page["holes"]}]
        none = lambda v: v if np.isfinite(v) else None
        return [
            {
                "cell_id": r["cell_id"], "method": r["method"], "valid": r["valid"], "status": r["status"], "center_x": none(r["x"]), "center_y": none(r["y"]),
                "metrics": [(k, v) for k, v in r["metrics"].items() if np.isfinite(v)], "contour": None if r["contour"] is None else [{"x": x, "y": y} for x, y in r["contour"].tolist()],
                "holes": page["holes"], "converged": page["converged"], "rounds": page["rounds"],
            }
            for r in rows
        ]

    return map_pages(pages, f, schema, timeout, stop_after)


def filter_pages(pages: DataFrame, kind: str, **options) -> DataFrame:
    """Pages smoothed ('gaussian'), or denoised ('wiener', 'mean_hole' with detected centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridscope.kernels import cells, images

        for b in batches:
            out = []
            for _, _, image in _images(iter([b])):
                if kind == "gaussian":
                    got = images.smooth(image, **options)
                elif kind == "wiener":
                    got = images.denoise_wiener(image, **options)
                else:
                    got = images.denoise_mean_hole(image, cells.detect(image, "otsu", (2, 5000), "weighted")[:, :2], **options)
                out.append(got.astype(np.float64).ravel())
            k = b.schema.get_field_index("pixels")
            yield b.set_column(k, b.schema.field(k), pa.array(out, pa.list_(pa.float64())))

    ok = pages.where("error IS NULL").select("file", "page", "height", "width", "pixels")
    return ok.mapInArrow(run, "file string, page int, height int, width int, pixels array<double>")


def outline_pages(pages: DataFrame, fast: bool = False) -> DataFrame:
    """One row per page: status, size, axes, power and blur of its common outline."""

    def f(image: np.ndarray) -> list[dict]:
        from gridscope.kernels import cells, outline

        seeds = cells.detect(image, "otsu", (2, 5000), "weighted")[:, :2]
        got = (outline.fit_outline_fast if fast else outline.fit_outline)(image, seeds)
        v = [float(x) if np.isfinite(x) else None for x in (got["cd"], *got["shape"])]
        return [{"status": got["status"], "cd": v[0], "axis_x": v[1], "axis_y": v[2], "power": v[3], "blur": v[4], "holes": len(seeds), "used": int(got["valid"].sum())}]

    return map_pages(pages, f, "status string, cd double, axis_x double, axis_y double, power double, blur double, holes int, used int")


def _paired(ref: DataFrame, mov: DataFrame, keys: list[str]) -> DataFrame:
    a = ref.where("error IS NULL").select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("height", "width", "pixels")])
    b = mov.where("error IS NULL").select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("height", "width", "pixels")])
    return a.join(b, keys)


def register_pages(ref: DataFrame, mov: DataFrame, keys: list[str] = ["page"], upsample: int = 20) -> DataFrame:  # noqa: B006
    """(keys, dy, dx, error, check_error) of every pair of pages with equal keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridscope.kernels import images

        for d in batches:
            rows = []
            for r in d.itertuples(index=False):
                a, b = np.asarray(r.a_pixels).reshape(r.a_height, r.a_width), np.asarray(r.b_pixels).reshape(r.b_height, r.b_width)
                check = images.hole_check_error(a, b)
                if a.shape != b.shape:
                    rows.append((*[getattr(r, k) for k in keys], None, None, None, check))
                    continue
                (dy, dx), error = images.estimate_shift(a, b, upsample)
                rows.append((*[getattr(r, k) for k in keys], dy, dx, error, check))
            yield pd.DataFrame(rows, columns=[*keys, "dy", "dx", "error", "check_error"])

    p = _paired(ref, mov, keys)
    kinds = dict(p.select(*keys).dtypes)
    return p.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", dy double, dx double, error double, check_error double")


def index_lattice(points: DataFrame, page: str = "page", layout: str = "auto") -> DataFrame:
    """(page, seed_id, row_idx, col_idx, indexed) of each page's points: a page's points are one task's."""

    def f(d: pd.DataFrame) -> pd.DataFrame:
        from gridscope.kernels.lattice import index_points

        d = d.sort_values("id")
        rc = index_points(d[["x", "y"]].to_numpy(float), layout)
        return pd.DataFrame({"page": d["page"].astype("int32"), "seed_id": d["id"], "row_idx": rc[:, 0], "col_idx": rc[:, 1], "indexed": rc[:, 0] >= 0})

    ship(points.sparkSession)
    src = points.where("id IS NOT NULL").select(F.col(page).cast("int").alias("page"), F.col("id").cast("long").alias("id"), "x", "y")
    return src.groupBy("page").applyInPandas(f, LATTICE)


def fft_spectrum(series: DataFrame, group: str, order: str, value: str, window: str = "hann", dx: float = 1.0) -> DataFrame:
    """One-sided amplitudes of long, even series by the FFT of each group."""

    def f(d: pd.DataFrame) -> pd.DataFrame:
        y = d.sort_values("k")["v"].to_numpy(float)
        n = len(y)
        y = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n)) if n > 2 else y
        w = np.hanning(n) if window == "hann" and n > 1 else np.ones(n)
        a, q = 2 * np.abs(np.fft.rfft(y * w)) / max(w.sum(), 1e-12), np.fft.rfftfreq(n, dx)
        return pd.DataFrame({"series": d["g"].iloc[0], "frequency": q[1:], "amplitude": a[1:], "period": 1 / q[1:]})

    src = series.select(F.col(group).cast("string").alias("g"), F.col(order).alias("k"), F.col(value).alias("v"))
    return src.groupBy("g").applyInPandas(f, "series string, frequency double, amplitude double, period double")
