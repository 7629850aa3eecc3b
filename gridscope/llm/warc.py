"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Uncompressed bytes of a file, which one task reads whole, and of a row of the writer; one larger record exceeds both.
FILE_BYTES, ROW_BYTES = 64 << 20, 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The type of the row that stands for a file's last byte; no record has it.
FILE_END = "\n"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits, four letters each."""
    hexed = F.sha1(data)
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, first_id): first_id is the page whose record a revisit refers to, else null.

    Of equal payloads of at least min_bytes bytes the smallest page_id is the response
    and all others revisit it; null ids never lead a group that has another.  Only groups
    of two or more pages go into the join, pre-aggregated; a hot payload's rows are
    split by the skew join.
    """
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    groups = src.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
    groups = groups.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    out = src.join(groups.drop("n"), "digest", "left")
    first = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", first.alias("first_id"))


def render(records: DataFrame) -> DataFrame:
    """(value): the record without its closing blank lines, which the writer puts between lines."""
    again = F.col("first_id").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), r"[\x00-\x20\x7F]", "%20")
    size = F.octet_length("payload").cast("string")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    return records.select(
        F.concat(
            F.lit(VERSION.decode()),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", uri),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            maybe("X-Page-Id", F.col("page_id")),
            F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("digest"))), maybe("X-Refers-To-Page-Id", F.col("first_id")))).otherwise(""),
            line("X-Payload-Length", size),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(again, "0").otherwise(size)),
            F.lit("\r\n"),
            F.when(again, "").otherwise(F.col("payload")),
        ).alias("value")
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole gzip members, one a record, ROW_BYTES of records each; the last byte, always 0, is left to the writer.

    A member ends with its length's highest byte, which is 0 below 16 MB; behind a
    longer record an empty member follows, as the format allows.
    """
    held, size = [], 0
    for b in batches:
        for v in b.column(0):
            raw = v.as_buffer().to_pybytes() + END.encode()
            for part in (raw, b"")[: 1 + (len(raw) >= 1 << 24)]:
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                held += [c.compress(part), c.flush()]
            size += len(raw)
            if size >= ROW_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])


def write_archives(records: DataFrame, path: str) -> None:
    """Archives of one gzip member per record under path, bounded in bytes, through Spark's own writer to any store."""
    ship(records.sparkSession)
    rows = render(records).mapInArrow(_packed, "value binary").select(F.col("value").cast("string"))
    out = rows.write.mode("overwrite").option("lineSep", "\0").option("compression", "none")
    out.option("maxRecordsPerFile", FILE_BYTES // ROW_BYTES).text(path)


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file, one after another; other files as they are.  A member that breaks off is an error."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


SCHEMA = (
    "file string, at long, next long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, url string, intact boolean"
)


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?m)^" + re.escape(name) + rb": *([^\r\n]*)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def _candidates(name: str, data: bytes) -> Iterator[tuple]:
    """Every place that looks like a record, with the offset at which its successor would begin.

    A record follows the file's start or another one's closing blank lines, so headers,
    of whatever length, don't overlap and each byte is searched once.
    """
    for m in re.finditer(re.escape(VERSION), data):
        if m.start() and data[max(0, m.start() - 4) : m.start()] != b"\r\n\r\n":
            continue
        stop = data.find(b"\r\n\r\n", m.end() - 2)
        if stop < 0:
            break
        head, body = data[m.start() : stop], stop + 4
        length = _number(_field(head, b"Content-Length"))
        if length is None or length < 0 or data[body + length : body + length + 4] != b"\r\n\r\n":
            continue
        kind, told = _field(head, b"WARC-Type"), (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
        size, digest = _number(_field(head, b"X-Payload-Length")), told
        if kind != "revisit":
            size, digest = length, base64.b32encode(hashlib.sha1(data[body : body + length]).digest()).decode()
        yield (
            name, m.start(), body + length + 4, _number(_field(head, b"X-Page-Id")), size, digest, kind,
            _number(_field(head, b"X-Refers-To-Page-Id")), _field(head, b"WARC-Target-URI"), digest == told,
        )


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """Rows reachable from offset 0 by pointer jumping: after k rounds the first 2^k records are marked."""
    part = part.sort_values("at", ignore_index=True)
    at, n = part["at"].to_numpy(np.int64), len(part)
    jump = np.searchsorted(at, part["next"].to_numpy(np.int64))
    jump[(jump < n) & (at[np.minimum(jump, n - 1)] != part["next"].to_numpy(np.int64))] = n  # no such record
    jump, reached = np.append(jump, n), np.append(at == 0, False)
    while True:
        before = int(reached.sum())
        reached[jump[np.flatnonzero(reached)]] = True
        reached[n] = False
        if int(reached.sum()) == before:
            return part[reached[:n]]
        jump = jump[jump]


def _whole_chain(part: pd.DataFrame) -> pd.DataFrame:
    """The chain of one file, without its end row, which the chain must reach."""
    got = _chain(part)
    ends = got["record_type"] == FILE_END
    if not ends.any():
        last = int(got["next"].max()) if len(got) else 0
        raise ValueError(f"{part['file'].iloc[0]}: no record at byte {last} of {int(part['at'].max())}")
    return got[~ends]


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives under path.

    A task per file emits candidates with their successors' offsets (the magic inside a
    payload is one too); the files' chains are then followed from their starts, and
    candidates that no chain reaches are dropped.  A chain that doesn't end exactly at
    its file's last byte is an error.  Candidates are narrow rows and a
    file's are bounded by its size; payloads are digested where they are found and
    never move.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            for name, content in zip(b.column(0), b.column(1)):
                data = unpacked(content.as_py())
                rows = [*_candidates(name.as_py(), data), (name.as_py(), len(data), -1, None, None, None, FILE_END, None, None, None)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(spark)
    kind: StructType = _parse_datatype_string(SCHEMA)
    schema, names = to_arrow_schema(kind), kind.names
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(scan, SCHEMA).groupBy("file").applyInPandas(_whole_chain, SCHEMA)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """pages written as archives into the shared folder and read back: one row per page; another number is an error.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact).  Null
    html is an empty payload; a null id has no id in its record and, alone in its group
    or with other nulls, a response; repeated rows of one id are all responses; an empty
    table gives an empty result; other columns are ignored.  Equal rows have equal record ids.
    """
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    write_archives(plan_records(pages, **columns), path)
    got = scratch.save(read_archives(spark, path).drop("file", "at", "next"), "records")  # without payloads
    written, read = pages.count(), got.count()
    if written != read:
        raise ValueError(f"{written} pages written, {read} records read from {path}")
    return got


SQL = """
WITH src AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1) for i in range(32)], '') AS payload_digest FROM src)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
