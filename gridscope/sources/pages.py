"""Image pages as tables: .npy stacks, raw arrays and uncompressed TIFF, read from any store Spark reads.

Files come through Spark's own binary reader, so listing, remote stores and splits by
file are Spark's; decoding is per file in Python.  A file or page that can't be decoded
is a row with its error, and the scan goes on.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.schemas import PAGE


def tiff_pages(data: bytes) -> Iterator[np.ndarray | Exception]:
    """Pages of an uncompressed grey TIFF in strips, both byte orders, 8, 16, 32 bits, integer or float."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags = {}
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = {1: 1, 3: 2, 4: 4}.get(kind, 0)
            if not size:
                continue
            raw = entry[8 : 8 + size * count] if size * count <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size * count]
            tags[tag] = struct.unpack(order + str(count) + {1: "B", 3: "H", 4: "I"}[kind], raw)
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        try:
            if tags.get(259, (1,))[0] != 1:
                raise ValueError("compressed TIFF pages can't be read")
            if tags.get(277, (1,))[0] != 1:
                raise ValueError("only grey TIFF pages can be read")
            w, h, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
            kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
            raw = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279]))
            yield np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}"), w * h).reshape(h, w)
        except (KeyError, ValueError, TypeError) as e:
            yield ValueError(str(e))


def write_tiff(pages: list[np.ndarray]) -> bytes:
    """An uncompressed little-endian TIFF, one strip a page."""
    out, links = bytearray(b"II*\0\0\0\0\0"), 4
    for p in pages:
        p = np.ascontiguousarray(p)
        data_at = len(out)
        out += p.astype(p.dtype.newbyteorder("<")).tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, links, len(out))
        kind = {"u": 1, "i": 2, "f": 3}[p.dtype.kind]
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, p.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, data_at), (277, 3, 1), (278, 4, p.shape[0]), (279, 4, p.nbytes), (339, 3, kind)]
        out += struct.pack("<H", len(tags))
        for tag, t, v in tags:
            out += struct.pack("<HHI", tag, t, 1) + (struct.pack("<HH", v, 0) if t == 3 else struct.pack("<I", v))
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode(name: str, data: bytes) -> Iterator[np.ndarray | Exception]:
    """Grey pages of a file by its name."""
    if name.lower().endswith(".npy"):
        got = np.load(io.BytesIO(data), allow_pickle=False)
        yield from (got if got.ndim == 3 and got.shape[-1] not in (3, 4) else got[None])
    elif name.lower().endswith((".tif", ".tiff")):
        yield from tiff_pages(data)
    else:
        raise ValueError(f"no reader for {name}")


def grayscale(image: np.ndarray) -> np.ndarray:
    """A two-dimensional finite page; colours by luminance, booleans as 0 and 1."""
    if image.ndim == 3 and image.shape[-1] in (3, 4):
        image = image[..., :3].astype(float) @ np.array([0.2126, 0.7152, 0.0722])
    if image.ndim != 2:
        raise ValueError("a page has two dimensions")
    out = image.astype(float)
    if not np.isfinite(out).all():
        raise ValueError("a page has only finite values")
    return out


def read_pages(spark: SparkSession, path: str | list[str], pages: tuple[int, int | None] | None = None, glob: str = "*.{npy,tif,tiff}", done: DataFrame | None = None) -> DataFrame:
    """(file, page, height, width, pixels, error) of all matching files under the paths, found once each.

    ``pages`` is a half-open range, whose other pages' pixels aren't converted; pages in
    ``done`` (file, page) are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.select(F.col("path").alias("file"), "content").dropDuplicates(["file"])
    return decode_pages(files, pages, done)


def decode_pages(files: DataFrame, pages: tuple[int, int | None] | None = None, done: DataFrame | None = None) -> DataFrame:
    """The same from (file, content), batch or stream."""
    low, high = pages or (0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                name, k = file.as_py(), 0
                try:
                    for k, page in enumerate(decode(name, content.as_py())):
                        if k < low:
                            continue
                        if high is not None and k >= high:
                            break
                        yield _row(name, k, page)
                except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the scan
                    yield _row(name, k, e)

    got = files.select("file", "content").mapInArrow(run, PAGE)
    return got if done is None else got.join(done.select("file", "page").distinct(), ["file", "page"], "left_anti")


def _row(name: str, k: int, page: np.ndarray | Exception) -> pa.RecordBatch:
    error = None
    if not isinstance(page, Exception):
        try:
            page = grayscale(page)
        except ValueError as e:
            page = e
    if isinstance(page, Exception):
        error, page = f"{type(page).__name__}: {page}", None
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name]), pa.array([k], pa.int32()), pa.array([None if page is None else page.shape[0]], pa.int32()),
            pa.array([None if page is None else page.shape[1]], pa.int32()), pa.array([None if page is None else page.ravel()], pa.list_(pa.float64())), pa.array([error], pa.string()),
        ],
        names=["file", "page", "height", "width", "pixels", "error"],
    )


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, x, y) of .npy point files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                p = np.load(io.BytesIO(content.as_py()), allow_pickle=False).reshape(-1, 2).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(p)), pa.array(np.arange(len(p))), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["file", "id", "x", "y"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, id long, x double, y double")


def read_csv_rows(spark: SparkSession, path: str, schema: str, file: str | None = None) -> DataFrame:
    """CSV rows, malformed ones dropped, of one file key if given."""
    rows = spark.read.option("header", "true").option("mode", "DROPMALFORMED").schema(schema).csv(path)
    return rows if file is None else rows.where(F.col("file") == file)


def explode_pixels(pages: DataFrame) -> DataFrame:
    """(file, page, x, y, v) of small pages."""
    p = pages.where("error IS NULL").select("file", "page", "width", F.posexplode("pixels").alias("k", "v"))
    return p.select("file", "page", (F.col("k") % F.col("width")).cast("long").alias("x"), F.floor(F.col("k") / F.col("width")).alias("y"), "v")


def synthetic_pages(keys: DataFrame, rows: int = 6, cols: int = 8, pitch: float = 12.0, fwhm: float = 4.0, noise: float = 0.5) -> DataFrame:
    """A rendered page of holes per row of (page, seed), the same for the same seed."""
    from gridscope.kernels import images

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = images.lattice_centers(rows, cols, (pitch, pitch), (15.0, 15.0), True)
        h, w = int(15 * 2 + (rows - 1) * pitch), int(15 * 2 + cols * pitch)
        for b in batches:
            for page, seed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _row("synthetic", page, images.render_holes((h, w), c, fwhm, 50.0, 20.0, noise, seed))

    return keys.select(F.col("page").cast("int"), F.col("seed").cast("long")).mapInArrow(run, PAGE)
