"""SentencePiece encoding and decoding by batched numpy.

A text is cut into units that no piece can cross; distinct units of equal length
advance together.  Substrings are identified by polynomial hashes, probed in the
sorted hashes of the pieces.  A unigram model's units take Viterbi steps: vectorised
maxima over the pieces that end at each place store backpointers.  A byte-pair model
defines its result by merges, which no sum of scores gives, so its units take merge
steps instead: the best pair of each unit by a vectorised maximum, leftmost on ties.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch

SPACE = "▁"
#: Fixed values of the model file's format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LONG = 48  # units of more characters merge one by one, by a heap
MEMORY_UNITS = 200_000
CHUNK_BYTES = 1_000_000
NONE = np.float32(-np.inf)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + n]
            at += n
        yield key >> 3, value


@lru_cache(maxsize=4)
def character_map(blob: bytes) -> dict[str, str]:
    """The sequences that a model's normaliser replaces: a double-array trie of them, then their replacements.

    Fixed by the format: the trie's size in bytes; units of 32 bits with, from the lowest bit, a
    label or the lower value bits, a flag for an end (bit 8), a flag for wide offsets (bit 9),
    and the offset; a replacement ends with a zero byte.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts, every = np.frombuffer(blob, np.uint32, size // 4, 4), blob[4 + size :], np.arange(1, 256)

    def children(at: int) -> int:
        u = int(units[at])
        return at ^ ((u >> 10) << ((u & 0x200) >> 6))

    out, open_ = {}, [(children(0), b"")]
    while open_:
        base, key = open_.pop()
        at = base ^ every
        for byte in every[(at < len(units)) & (units[np.minimum(at, len(units) - 1)] & 0x800000FF == every)].tolist():
            below, longer = children(base ^ byte), key + bytes([byte])
            if units[base ^ byte] & 0x100:
                begin = int(units[below]) & 0x7FFFFFFF
                out[longer.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
            open_.append((below, longer))
    return out


class Pieces:
    """A model file's pieces, type and normaliser flags; small enough for every task (one copy per executor process)."""

    def __init__(self, data: bytes):
        self.text, self.score, self.kind = [], [], []
        self.type, self.prefix, self.trim, self.escape, charsmap, self.fallback = UNIGRAM, True, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.text.append(got[1].decode())
                self.score.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
                self.kind.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                self.type, self.fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                charsmap = got.get(2, b"")
                self.prefix, self.trim, self.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
                if got.get(24, 0):
                    raise ValueError("a model with spaces at the ends of words")
        if not self.escape or self.type not in (UNIGRAM, BPE) or (self.type == BPE and UNUSED in self.kind):
            raise ValueError("a model with unescaped spaces, with unused merges, or of another type than unigram or BPE")
        self._index(character_map(charsmap))

    def _index(self, characters: dict[str, str] | None = None) -> None:
        self.unknown = self.kind.index(UNKNOWN)
        given = {self.text[i]: i for i, k in enumerate(self.kind) if k == USER_DEFINED}
        normal = [self.score[i] for i, k in enumerate(self.kind) if k == NORMAL]
        # given symbols: a byte-pair model cuts them out before it merges; in a unigram model they outscore nearly all
        # (measured of the library: a tenth for each byte beyond the first)
        self.symbols = given if self.type == BPE else {}
        self.score = [(len(t.encode()) - 1) / 10 if k == USER_DEFINED else x for t, x, k in zip(self.text, self.score, self.kind)]
        either = "|".join(map(re.escape, sorted(given, key=len, reverse=True)))
        self.symbol_cut = re.compile(f"({either})") if self.symbols else None
        self.characters = characters or {}
        self.longest_character = max(map(len, self.characters), default=0)
        first = "[" + "".join(re.escape(c) for c in sorted({c[0] for c in self.characters})) + "]"
        self.mapped = re.compile((f"(?P<symbol>{either})|" if either else "(?P<symbol>(?!))|") + first) if self.characters else None
        usable = [i for i, k in enumerate(self.kind) if k == NORMAL or k == USER_DEFINED and self.type == UNIGRAM]
        keys = np.array([_hash_of(self.text[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces with one hash")
        self.key_score = np.array(self.score, np.float32)[self.ids]
        self.lookup = {self.text[i]: (self.score[i], i) for i in usable}
        self.longest = max((len(self.text[i]) for i in usable), default=1)
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.low = min(normal, default=0.0) - 10
        # where no piece goes across, texts are cut
        many = [self.text[i] for i in usable if len(self.text[i]) > 1]
        joins = any(re.search("[^" + SPACE + "]" + SPACE, t) for t in many)
        lines = any("\n" in t for t in many)
        rest = "" if lines else "\n"
        self.units = re.compile(r"[\s\S]+" if joins else f"{SPACE}+[^{SPACE}{rest}]*|[^{SPACE}{rest}]+" + ("" if lines else "|\n"))
        # decoding: each piece's bytes
        raw = [self._bytes_of(i) for i in range(len(self.text))]
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _bytes_of(self, i: int) -> bytes:
        if self.kind[i] == BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        if self.kind[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kind[i] == UNKNOWN else self.text[i].replace(SPACE, " ").encode()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_mem")}

    # -- encoding ---------------------------------------------------------------------------------

    def _map(self, text: str) -> str:
        """The text with the longest sequences of the character map replaced, from the left; given symbols stay."""
        out, at = [], 0
        while m := self.mapped.search(text, at):
            i = m.start()
            out.append(text[at:i])
            if m["symbol"]:
                out.append(m["symbol"])
                at = m.end()
                continue
            for n in range(self.longest_character, 0, -1):
                got = self.characters.get(text[i : i + n])
                if got is not None:
                    out.append(got)
                    at = min(len(text), i + n)
                    break
            else:
                out.append(text[i])
                at = i + 1
        return "".join([*out, text[at:]])

    def _cut(self, text: str) -> list[str]:
        """The units of a normalised text."""
        if not self.symbol_cut:
            return self.units.findall(text)
        return [u for i, part in enumerate(self.symbol_cut.split(text)) for u in ([part] if i % 2 else self.units.findall(part))]

    def normalise(self, text: str) -> str:
        if self.mapped:
            text = self._map(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys, whether it is there) of substring hashes."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == h

    def encode_units(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        for i, u in enumerate(units if self.symbols else []):
            if u in self.symbols:
                out[i], lens[i] = [self.symbols[u]], 0
        for n in np.unique(lens[lens > 0]).tolist():
            where = np.flatnonzero(lens == n).tolist()
            if n > LONG:
                for i in where:
                    out[i] = self._merge_long(units[i]) if self.type == BPE else self._pieces_of(units[i : i + 1], *self._viterbi(units[i : i + 1], n))[0]
                continue
            for at in range(0, len(where), 20_000):
                some = where[at : at + 20_000]
                words = [units[i] for i in some]
                found = self._pieces_of(words, *(self._viterbi if self.type == UNIGRAM else self._merge)(words, n))
                for i, ids in zip(some, found):
                    out[i] = ids
        return out

    def _pieces_of(self, words: list[str], bounds: list[list[int]], ids: list[list[int]]) -> list[list[int]]:
        out = []
        for w, b, p in zip(words, bounds, ids):
            if -1 in p:
                p = [x for s, e, i in zip(b, b[1:], p) for x in ([i] if i >= 0 else self._strange(w[s:e]))]
            out.append(p)
        return out

    def _strange(self, text: str) -> list[int]:
        """Ids of characters that aren't pieces."""
        if self.fallback and self.bytes:
            return [self.bytes[b] for b in text.encode()]
        return [self.unknown] * len(text)

    def _viterbi(self, words: list[str], n: int) -> tuple[list[list[int]], list[list[int]]]:
        """Best segmentations of words of n characters by the sum of scores; of equals, the longest last piece."""
        h, powers = _prefix_hashes(words, n)
        rows = np.arange(len(words))
        best = np.full((len(words), n + 1), NONE, np.float32)  # sums in the library's precision, which decides near ties
        best[:, 0] = 0
        back, piece = np.zeros((len(words), n + 1), np.int64), np.full((len(words), n + 1), -1, np.int64)
        for e in range(1, n + 1):
            s = np.arange(max(0, e - self.longest), e)
            at, there = self.probe(h[:, e, None] - h[:, s] * powers[e - s])
            value = np.where(there, self.key_score[at], np.where(s == e - 1, np.float32(self.low), NONE)) + best[:, s]
            top = np.argmax(value, 1)
            best[:, e], back[:, e] = value[rows, top], s[top]
            piece[:, e] = np.where(there[rows, top], self.ids[at[rows, top]], -1)
        bounds, ids = [], []
        for r in range(len(words)):
            e, b, p = n, [n], []
            while e:
                p.append(int(piece[r, e]))
                e = int(back[r, e])
                b.append(e)
            bounds.append(b[::-1])
            ids.append(p[::-1])
        return bounds, ids

    def _merge(self, words: list[str], n: int) -> tuple[list[list[int]], list[list[int]]]:
        """Byte-pair merges of words of n characters, one a step in each word that has one."""
        h, powers = _prefix_hashes(words, n)
        bounds: list[list[int]] = [[]] * len(words)
        ids: list[list[int]] = [[]] * len(words)
        live, cut = np.arange(len(words)), np.tile(np.arange(n + 1), (len(words), 1))
        while len(live):
            m = cut.shape[1] - 1
            row = np.arange(len(live))
            if m > 1:
                s, e = cut[:, :-2], cut[:, 2:]
                at, there = self.probe(h[live[:, None], e] - h[live[:, None], s] * powers[e - s])
                value = np.where(there, self.key_score[at], NONE)
                top = np.argmax(value, 1)
                go = value[row, top] > NONE
            else:
                go, top = np.zeros(len(live), bool), np.zeros(len(live), np.int64)
            done = ~go
            if done.any():
                s, e = cut[done, :-1], cut[done, 1:]
                at, there = self.probe(h[live[done][:, None], e] - h[live[done][:, None], s] * powers[e - s])
                got = np.where(there, self.ids[at], -1)
                for i, b, p in zip(live[done].tolist(), cut[done].tolist(), got.tolist()):
                    bounds[i], ids[i] = b, p
            keep = np.ones((int(go.sum()), m + 1), bool)
            keep[np.arange(len(keep)), top[go] + 1] = False
            cut = cut[go][keep].reshape(len(keep), m)
            live = live[go]
        return bounds, ids

    def _merge_long(self, word: str) -> list[int]:
        """The same merges for one long unit, by a heap over a linked list."""
        n, get = len(word), self.lookup.get
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if a >= 0 and b < n and (got := get(word[a : end[b]])):
                heapq.heappush(heap, (-got[0], a, end[b]))

        for a in range(n - 1):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, e = heapq.heappop(heap)
            b = right[a] if alive[a] else n
            if b >= n or end[b] != e:
                continue
            alive[b], end[a], right[a] = False, e, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        out: list[int] = []
        a = 0
        while a < n:
            got = get(word[a : end[a]])
            out += [got[1]] if got else self._strange(word[a : end[a]])
            a = right[a]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        memory = self.__dict__.setdefault("_memory", {})
        cut = [self._cut(self.normalise(t)) for t in texts]
        distinct = set().union(*cut) if cut else set()
        new = [u for u in distinct if u not in memory]
        if len(memory) + len(new) > MEMORY_UNITS:
            memory.clear()
            new = list(distinct)
        memory.update((u, array("i", ids).tobytes()) for u, ids in zip(new, self.encode_units(new)))
        place = {u: i for i, u in enumerate(distinct)}
        found = [memory[u] for u in distinct]
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        at = np.cumsum(lens) - lens
        got = [_gather(flat, at, lens, np.fromiter(map(place.__getitem__, u), np.int64, len(u))) for u in cut]
        if self.fallback and self.bytes:
            return got
        # a run of unknown characters is one unknown piece
        return [ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]] if len(ids) else ids for ids in got]

    def decode(self, ids: np.ndarray) -> str:
        data = _gather(self.raw, self.raw_at, self.raw_len, ids.astype(np.int64)).tobytes()
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[at : at + lens] of the chosen ones, one after the other."""
    n = lens[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - n), n)]


def _hash_of(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
    return h


def _prefix_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.array(["".join(words)]).view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
    h, powers = np.zeros((len(words), n + 1), np.uint64), np.full(n + 1, BASE, np.uint64)
    powers[0] = 1
    for i in range(n):
        h[:, i + 1] = h[:, i] * BASE + code[:, i]
    return h, np.multiply.accumulate(powers)


def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode_column(docs: DataFrame, model: Pieces, text_col: str = "text", ids: str = "token_ids", decoded: str | None = "decoded_text") -> DataFrame:
    """docs with the ids of each whole text, and the text decoded from them again.

    Null and empty texts have no ids and decode to an empty text.  All rows and
    columns stay, but for those named like the new ones.
    """
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: a few MB at most
    ship(docs.sparkSession)
    src, last = docs.drop(ids, *[decoded] * bool(decoded)), scratch.fresh(docs, "text")
    kind = T.StructType([*src.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        kind = kind.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            for rows, texts in _chunks(b, b.num_columns - 1):
                got = sent.value.encode(texts)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *got])))]
                if decoded:
                    made.append(pa.array([sent.value.decode(g) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=kind.names)

    return src.withColumn(last, docs[text_col].cast("string")).mapInArrow(run, kind)


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of a batch of about CHUNK_BYTES characters in a column, and those texts (null: empty)."""
    at = 0
    while at < b.num_rows:
        texts, size, first = [], 0, at
        while at < b.num_rows and size < CHUNK_BYTES:
            texts.append(b.column(column)[at].as_py() or "")
            size += len(texts[-1])
            at += 1
        yield b.slice(first, len(texts)), texts


def digests(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) of each text, made where the ids are.

    ids_sha256 is over the ids as little-endian 32-bit integers, so no id list leaves its task.
    """
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            for part, texts in _chunks(b, 1):
                rows = []
                for t, ids in zip(texts, sent.value.encode(texts)):
                    back = sent.value.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*rows))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
