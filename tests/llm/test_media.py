import random

import numpy as np
import pytest

from gridscope.llm import gif


def plain_decode(stream, bits, size):
    """One code at a time, after the format's description."""
    out, pos, width, clear = bytearray(), 0, bits + 1, 1 << bits
    number, table, prev, free = int.from_bytes(stream, "little"), {}, None, 0
    while len(out) < size:
        code = number >> pos & ((1 << width) - 1)
        pos += width
        if code == clear:
            table, free, width, prev = {i: bytes([i]) for i in range(clear)}, clear + 2, bits + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if prev is None or code in table else prev + prev[:1]
        if prev is not None and free < 4096:
            table[free] = prev + entry[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        out += entry
        prev = entry
    return bytes(out[:size])


@pytest.mark.parametrize("levels,size", [(1, 576), (2, 5000), (3, 60_000), (256, 30_000)])
def test_streams_against_a_plain_decoder(levels, size):
    random.seed(levels)
    data = bytes(random.randrange(levels) for _ in range(size))
    stream = gif.pack_codes([gif.lzw_codes(data)])[0]
    assert plain_decode(stream, 8, size) == data
    assert gif.lzw_decode([stream], np.array([8]), np.array([size]))[0].tobytes() == data


def test_many_streams_together_and_broken_ones():
    random.seed(5)
    data = [bytes(random.randrange(9) for _ in range(n)) for n in (1, 7, 576, 3000)]
    streams = gif.pack_codes([gif.lzw_codes(d) for d in data])
    got = gif.lzw_decode(streams, np.full(4, 8), np.array([len(d) for d in data]))
    assert [g.tobytes() for g in got] == data
    cut = gif.lzw_decode([streams[3][:50]], np.array([8]), np.array([3000]))[0]
    assert len(cut) == 3000 and cut[:20].tobytes() == data[3][:20]
    with pytest.raises(gif.GifError):
        gif.parse_gif(b"PNG")
    with pytest.raises(gif.GifError):
        gif.parse_gif(gif.encode_gifs([b"\0" * 576])[0][:-5])


def build(frames, w, h, palette):
    """A GIF by hand: frames of (x, y, w, h, disposal, transparent, interlaced, delay, indices), two-bit codes."""
    out = [b"GIF89a", w.to_bytes(2, "little"), h.to_bytes(2, "little"), bytes([0x80 | 1, 0, 0]), bytes(palette)]
    for x, y, fw, fh, disposal, clear, laced, delay, index in frames:
        out.append(b"!\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0]))
        out.append(b"," + b"".join(v.to_bytes(2, "little") for v in (x, y, fw, fh)) + bytes([0x40 if laced else 0, 2]))
        bits = "".join(format(c, "03b")[::-1] for i in index for c in (4, i)) + format(5, "03b")[::-1]  # a clear before each sample
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += [bytes([len(data)]) + data, b"\0"]
    return b"".join([*out, b";"])


def test_disposal_transparency_and_interlace():
    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    pal = [*red, *green, *blue, *white]
    whole = [0] * 16
    g = build([(0, 0, 4, 4, 1, None, False, 5, whole), (1, 1, 2, 2, 3, None, False, 7, [1] * 4), (0, 0, 1, 1, 2, None, False, 9, [2]), (3, 3, 1, 1, 1, 3, False, 1, [3])], 4, 4, pal)
    (screen, rgba), = gif.decode_gifs([g])
    assert [f["delay"] for f in screen["frames"]] == [5, 7, 9, 1]
    assert tuple(rgba[1, 1, 1, :3]) == green and tuple(rgba[2, 1, 1, :3]) == red  # restored to what was before
    assert tuple(rgba[2, 0, 0, :3]) == blue and rgba[3, 0, 0, 3] == 0  # cleared
    assert tuple(rgba[3, 3, 3, :3]) == red  # a transparent sample leaves what is there
    rows = [[r % 4] * 2 for r in range(8)]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    g = build([(0, 0, 2, 8, 0, None, True, 0, sum((rows[r] for r in order), []))], 2, 8, pal)
    (_, rgba), = gif.decode_gifs([g])
    table = np.array([red, green, blue, white])
    assert (rgba[0, :, 0, :3] == table[[r % 4 for r in range(8)]]).all()
    assert gif.histogram(rgba[0]) == [8, 0, 0, 0, 0, 0, 0, 8, 8, 0, 0, 0, 0, 0, 0, 8, 8, 0, 0, 0, 0, 0, 0, 8]


def test_texts_round_trip(spark):
    texts = [None, "", "x", "é" * 288, "a" * 576, "ab" * 40_000, "日本語 😀\0\n", "same", "same"]
    d = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in gif.digest(gif.decode_media(gif.encode_texts(d))).collect()}
    for i, t in enumerate(texts):
        n, payload = gif.to_payload(t)
        media = gif.encode_gifs([payload])[0]
        r = got[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.n_frames) == gif.digest_row(n, payload, media)
    frames = gif.decode_media(gif.encode_texts(d.where("doc_id = 5"))).first().frames
    assert [f.at_cs for f in frames[:3]] == [0, 4, 8] and sum(frames[0].histogram) == 3 * 576
    assert gif.encode_texts(d.where("false")).count() == 0
