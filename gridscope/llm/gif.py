"""Media columns as GIF: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

Files follow the GIF89a specification.  Code streams of all frames of a batch are
decoded together by whole-array steps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch

SIDE = 24
UNIT = SIDE * SIDE
DELAY = 4  # hundredths of a second
GREYS = bytes(v for v in range(256) for _ in range(3))
MAX_CODES = 4096
WINDOW = 5000  # codes looked at after a clear, at first
HIST_SHIFT = 5  # eight bins a channel


# -- encoding ---------------------------------------------------------------------------------------


def lzw_codes(data: bytes) -> list[int]:
    """LZW codes of 8-bit samples, begun by a clear and closed by an end code."""
    clear, table, free = 256, {}, 258
    out, held = [clear], data[0]
    seen, put = table.get, out.append
    for c in data[1:]:
        pair = held << 8 | c
        code = seen(pair)
        if code is not None:
            held = code
            continue
        put(held)
        if free < MAX_CODES:
            table[pair] = free
            free += 1
        else:
            put(clear)
            table.clear()
            free = 258
        held = c
    out += [held, 257]
    return out


def _width_table(bits: int, n: int) -> np.ndarray:
    """Bits of each of the n codes after a clear: one more each time the dictionary outgrows them."""
    filled = (1 << bits) + 1 + np.arange(n, dtype=np.int64)
    return np.clip(np.floor(np.log2(filled)).astype(np.int64) + 1, bits + 1, 12)


def pack_codes(lists: list[list[int]]) -> list[bytes]:
    """The bytes of many code lists, each beginning with a clear code."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    c = np.concatenate([np.array(x, np.int64) for x in lists])
    place, begin = np.arange(len(c)), np.repeat(np.cumsum(lens) - lens, lens)
    cleared = np.maximum.accumulate(np.where(c == 256, place, 0))
    since = place - np.concatenate(([0], cleared[:-1])) - 1  # codes after the clear before this one
    width = _width_table(8, MAX_CODES + 2)[np.clip(since, 0, MAX_CODES)]
    width[place == begin] = 9
    ends = np.cumsum(width)
    total = np.add.reduceat(width, np.cumsum(lens) - lens)
    sizes = -(-total // 8)
    bit = ends - width - np.repeat(np.cumsum(total) - total, lens) + 8 * np.repeat(np.cumsum(sizes) - sizes, lens)
    at, word, n = bit >> 3, c << (bit & 7), int(sizes.sum())
    data = sum(np.bincount(at + k, word >> 8 * k & 255, n + 2) for k in range(3)).astype(np.uint8)[:n].tobytes()
    cut = np.cumsum(sizes).tolist()
    return [data[x:y] for x, y in zip([0, *cut], cut)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gifs(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of UNIT bytes, as an animation of opaque grey frames."""
    cuts = [(p, i) for p in payloads for i in range(0, len(p), UNIT)]
    streams = iter(pack_codes([lzw_codes(p[i : i + UNIT]) for p, i in cuts]))
    side, files = SIDE.to_bytes(2, "little"), []
    head = b"!\xf9\x04\x04" + DELAY.to_bytes(2, "little") + b"\0\0," + b"\0\0\0\0" + side + side + b"\0\x08"
    for p in payloads:
        out = [b"GIF89a", side, side, b"\xf7\0\0", GREYS]
        if len(p) > UNIT:
            out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
        for _ in range(0, len(p), UNIT):
            out += [head, _blocks(next(streams))]
        files.append(b"".join([*out, b";"]))
    return files


def to_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % UNIT if data else UNIT)


# -- decoding ---------------------------------------------------------------------------------------


class GifError(ValueError):
    """Bytes that aren't a GIF, or one that breaks off."""


def parse_gif(data: bytes) -> dict:
    """Screen size, background and frames (position, palette, timing, disposal, transparency, code stream)."""
    try:
        return _parse(data)
    except IndexError:
        raise GifError("file breaks off") from None


def _parse(data: bytes) -> dict:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF")
    word = lambda at: int.from_bytes(data[at : at + 2], "little")
    flags, at, palette = data[10], 13, None

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("palette breaks off")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def chunks(at: int) -> tuple[bytes, int]:
        out = []
        while True:
            if at >= len(data):
                raise GifError("blocks break off")
            n = data[at]
            at += 1
            if not n:
                return b"".join(out), at
            out.append(data[at : at + n])
            at += n

    if flags & 128:
        palette, at = colours(at, flags)
    screen = {"width": word(6), "height": word(8), "background": data[11], "palette": palette, "frames": []}
    control = {"delay": 0, "disposal": 0, "transparent": None}
    while True:
        mark = data[at : at + 1]
        if mark == b";":
            return screen
        if mark == b"!":
            label = data[at + 1 : at + 2]
            if label == b"\xf9":
                f = data[at + 3]
                control = {"delay": word(at + 4), "disposal": f >> 2 & 7, "transparent": data[at + 6] if f & 1 else None}
            _, at = chunks(at + 2)
        elif mark == b",":
            f, own = data[at + 9], palette
            frame = {"x": word(at + 1), "y": word(at + 3), "width": word(at + 5), "height": word(at + 7), "interlaced": bool(f & 64)}
            at += 10
            if f & 128:
                own, at = colours(at, f)
            if own is None:
                raise GifError("no palette")
            bits = data[at]
            stream, at = chunks(at + 1)
            screen["frames"].append(frame | control | {"palette": own, "bits": bits, "stream": stream})
            control = {"delay": 0, "disposal": 0, "transparent": None}
        else:
            raise GifError("unknown block")


def lzw_decode(streams: list[bytes], bits: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Samples of many LZW streams: bits is each one's minimum code size, sizes how many samples it has.

    After a clear the widths of all codes are known, so every code of every stream is
    cut out at once, up to the next clear.  The code that made dictionary entry j is the
    j-th one, whose samples are those of entry j but the last: each code's string is a
    path of parents, found by pointer doubling, and written back to front.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(streams)
    for b in np.unique(bits):
        if not 1 <= b <= 11:
            raise GifError("code size out of range")
        some = np.flatnonzero(bits == b)
        for i, got in zip(some.tolist(), _decode_alike([streams[i] for i in some], int(b), sizes[some])):
            out[i] = got
    return out


def _decode_alike(streams: list[bytes], bits: int, sizes: np.ndarray) -> list[np.ndarray]:
    n, clear = len(streams), 1 << bits
    lens = np.fromiter(map(len, streams), np.int64, n)
    flat = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    base, have = 8 * (np.cumsum(lens) - lens), np.zeros(n, np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in range(n)]
    live, pos, window = np.arange(n), np.zeros(n, np.int64), WINDOW
    while len(live):
        widths = _width_table(bits, window)
        upto = np.concatenate(([0], np.cumsum(widths)))
        count = np.minimum(np.searchsorted(upto, 8 * lens[live] - pos[live], "right") - 1, window)
        live, count = live[count > 0], count[count > 0]
        if not len(live):
            break
        first = np.cumsum(count) - count
        own, k = np.repeat(np.arange(len(live)), count), np.arange(count.sum()) - np.repeat(first, count)
        at = base[live][own] + pos[live][own] + upto[k]
        b = at >> 3
        word = flat[b] | flat[np.minimum(b + 1, len(flat) - 1)] << 8 | flat[np.minimum(b + 2, len(flat) - 1)] << 16
        code = word >> (at & 7) & ((1 << widths[k]) - 1)
        wrong = code - clear - 2 >= k  # an entry that isn't there yet
        stop = np.minimum.reduceat(np.where((code == clear) | (code == clear + 1) | wrong, k, window + 1), first)
        cut = np.minimum(stop, count)
        if (stop > count).any() and window < 1 << 24 and (8 * lens[live] - pos[live] > upto[-1]).any():
            window *= 2  # no clear within the window: look further
            continue
        keep = k < cut[own]
        got, sizes_of = _strings(code[keep], k[keep], clear)
        length = np.zeros(len(live), np.int64)
        np.add.at(length, own[keep], sizes_of)
        ends = np.cumsum(length).tolist()
        for i, x, y in zip(live.tolist(), [0, *ends], ends):
            parts[i].append(got[x:y])
        have[live] += length
        again = (stop < count) & (have[live] < sizes[live])
        again[again] = code[first[again] + stop[again]] == clear
        pos[live] += upto[np.minimum(stop + 1, window)]
        live = live[again]
    out = []
    for i in range(n):
        x = parts[i][0] if len(parts[i]) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts[i]])
        out.append(x[: sizes[i]] if len(x) >= sizes[i] else np.concatenate([x, np.zeros(sizes[i] - len(x), np.uint8)]))
    return out


def _strings(code: np.ndarray, k: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """All samples of the codes, and how many each has; k is a code's place after its clear."""
    n = len(code)
    literal, here = code < clear, np.arange(n)
    parent = np.where(literal, here, here - k + code - clear - 2)
    root, steps = parent, (~literal).astype(np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        steps = steps + steps[root]
        root = up
    last = code.copy()
    last[~literal] = code[root[parent[~literal] + 1]]
    size = steps + 1
    end = np.cumsum(size) - 1
    out = np.empty(int(end[-1]) + 1 if n else 0, np.uint8)
    cur = here
    while len(cur):
        out[end] = last[cur]
        more = ~literal[cur]
        cur, end = parent[cur[more]], end[more] - 1
    return out, size


def compose(screen: dict, indices: list[np.ndarray]) -> np.ndarray:
    """RGBA frames (n, height, width, 4) as shown, disposal and transparency applied."""
    h, w, frames = screen["height"], screen["width"], screen["frames"]
    whole = all(
        f["transparent"] is None and (f["x"], f["y"], f["width"], f["height"]) == (0, 0, w, h) and not f["interlaced"] for f in frames
    )
    if whole and len({id(f["palette"]) for f in frames}) == 1:  # each frame covers the last
        out = np.full((len(frames), h, w, 4), 255, np.uint8)
        table = _padded(frames[0]["palette"])
        out[..., :3] = table[np.stack(indices).reshape(len(frames), h, w)]
        return out
    canvas, shown = np.zeros((h, w, 4), np.uint8), []
    for f, index in zip(frames, indices):
        kept = canvas.copy() if f["disposal"] == 3 else None
        rows = index.reshape(f["height"], f["width"])
        if f["interlaced"]:
            order = np.concatenate([np.arange(a, f["height"], b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = rows[np.argsort(order)]
        y, x = f["y"], f["x"]
        place = canvas[y : y + f["height"], x : x + f["width"]]
        rows = rows[: place.shape[0], : place.shape[1]]
        seen = np.ones(rows.shape, bool) if f["transparent"] is None else rows != f["transparent"]
        place[seen, :3] = _padded(f["palette"])[rows[seen]]
        place[seen, 3] = 255
        shown.append(canvas.copy())
        if f["disposal"] == 2:
            place[...] = 0
        elif f["disposal"] == 3:
            canvas = kept
    return np.stack(shown) if shown else np.zeros((0, h, w, 4), np.uint8)


def _padded(palette: np.ndarray) -> np.ndarray:
    return np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])


def decode_gifs(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(screen, RGBA frames) of each file; all files' code streams are decoded together."""
    screens = [parse_gif(x) for x in files]
    frames = [f for s in screens for f in s["frames"]]
    sizes = np.array([f["width"] * f["height"] for f in frames], np.int64)
    found = lzw_decode([f["stream"] for f in frames], np.array([f["bits"] for f in frames], np.int64), sizes)
    out, at = [], 0
    for s in screens:
        out.append((s, compose(s, found[at : at + len(s["frames"])])))
        at += len(s["frames"])
    return out


def histogram(rgba: np.ndarray) -> list[int]:
    """Visible pixels by bins of 32 levels: eight counts each of red, green and blue."""
    seen = rgba[rgba[..., 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] >> HIST_SHIFT, minlength=256 >> HIST_SHIFT)]


# -- Spark ------------------------------------------------------------------------------------------

MEDIA = "id long, n_bytes long, media binary"
FRAMES = (
    "id long, n_bytes long, media binary, width int, height int, "
    "frames array<struct<at_cs:int,delay_cs:int,disposal:int,histogram:array<long>>>, samples binary"
)
BATCH_BYTES = 2_000_000


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a GIF of 24 x 24 frames, one sample a byte.

    Null and empty texts are one frame of padding (byte 255); null ids, repeated rows
    and other columns pass or are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            for rows in _cut(b):
                got = [to_payload(t.as_py()) for t in rows.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(encode_gifs([p for _, p in got]), pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, MEDIA)


def _cut(b: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about BATCH_BYTES in a column each, a row at least."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)], np.int64)
    group = np.cumsum(sizes) // BATCH_BYTES
    at = 0
    while at < b.num_rows:
        n = max(1, int(np.searchsorted(group, group[at], "right")) - at)
        yield b.slice(at, n)
        at += n


def decode_media(media: DataFrame) -> DataFrame:
    """Timed frames with colour histograms, and the red samples of all frames, read from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at_cs", pa.int32()), ("delay_cs", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
        for b in scratch.tidied(batches):
            for rows in _cut(b, 2):
                got = decode_gifs([x.as_py() for x in rows.column(2)])
                frames, samples = [], []
                for screen, rgba in got:
                    level = np.stack([_levels(rgba[..., c]) for c in range(3)], 1) if len(rgba) else np.zeros((0, 3, 8), np.int64)
                    if not (rgba[..., 3] > 0).all():
                        level = np.array([histogram(x) for x in rgba]).reshape(-1, 3, 8)
                    delays = [f["delay"] for f in screen["frames"]]
                    begin = np.cumsum([0, *delays])[:-1].tolist()
                    counts = level.reshape(len(rgba), -1).tolist()
                    frames.append([{"at_cs": a, "delay_cs": d, "disposal": f["disposal"], "histogram": h} for a, d, f, h in zip(begin, delays, screen["frames"], counts)])
                    samples.append(rgba[..., 0].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([s["width"] for s, _ in got], pa.int32()), pa.array([s["height"] for s, _ in got], pa.int32()), pa.array(frames, kind), pa.array(samples, pa.binary())],
                    names=["id", "n_bytes", "media", "width", "height", "frames", "samples"],
                )

    ship(media.sparkSession)
    return media.mapInArrow(run, FRAMES)


def _levels(channel: np.ndarray) -> np.ndarray:
    """Counts of eight bins for each frame."""
    n = len(channel)
    bins = (channel.reshape(n, -1) >> HIST_SHIFT).astype(np.int64) + 8 * np.arange(n)[:, None]
    return np.bincount(bins.ravel(), minlength=8 * n).reshape(n, 8)



def digest(decoded: DataFrame) -> DataFrame:
    """Digest columns of decoded media; the feature is the grey histogram of all frames."""

    hist = F.aggregate("frames", F.array(*[F.lit(0).cast("long")] * 8), lambda acc, f: F.zip_with(acc, F.slice(f["histogram"], 1, 8), lambda a, b: a + b))
    return decoded.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(hist.cast("array<string>"), ",").alias("feature"),
        F.size("frames").cast("long").alias("n_frames"),
    )


def digest_row(n_bytes: int, payload: bytes, media: bytes) -> tuple:
    """What digest() should give for a payload: for tests."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> HIST_SHIFT, minlength=8)
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, counts)), len(payload) // UNIT)
