"""SimHash near-duplicates through deletion-variant segment signatures.

A fingerprint of 64 bits (one or more such lanes) is cut into so few segments that
two fingerprints within the distance differ by at most one bit in one of them.  Each
segment is indexed once per bit with that bit as a wildcard: two segments that differ
by at most one bit share a variant.  Equal variants meet in one sorted stream, and the
full Hamming distance verifies them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch
from gridscope.llm.components import connected_components, through_lowest

SHINGLE = 4
MAX_DISTANCE = 4
SEGMENTS = 3
SEED = 42
#: Buckets of more distinct fingerprints are split by a second cut.
LARGE_BUCKET = 20_000


def _text_lanes(text: str | None, shingle: int, lanes: int, seed: int) -> list[int]:
    """Fingerprint lanes of one text as signed 64-bit integers."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * lanes
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter(
            [digest(joined[s:e], seed) for s, e in zip(first[at : at + 65536], last[at : at + 65536])], np.uint64
        )
        for lane in range(lanes):
            ones[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            if lane + 1 < lanes:
                h = _mix(h)
    bits = np.packbits(ones * 2 > n, axis=1, bitorder="little")
    return bits.view(np.int64).ravel().tolist()


def _mix(h: np.ndarray) -> np.ndarray:
    """Another hash of a hash (the splitmix64 finaliser), for further lanes."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, lanes: int = 1, seed: int = SEED
) -> DataFrame:
    """(id long, fp0.. long): majority bits of the XXH64 of all word shingles.

    Words are runs of bytes that aren't ASCII white space, A-Z lower-cased; fewer
    words than a shingle make one shingle, none (null and empty texts) give 0.
    """
    names = [f"fp{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            rows = [_text_lanes(t.as_py(), shingle, lanes, seed) for t in b.column(1)]
            got = np.array(rows, np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(got[:, i]) for i in range(lanes))], names=["id", *names]
            )

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _segments(segments: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment of a 64-bit lane, widths as even as can be."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _wildcards(value, off: int, width: int, tag: int) -> list:
    """One key per bit of a segment of a column of 64 bits: the tag and the bit above the segment's bits, that bit cleared."""
    part = F.shiftrightunsigned(value, off)
    ones = (1 << width) - 1
    return [part.bitwiseAND(F.lit(ones & ~(1 << bit))).bitwiseOR(F.lit((tag + off + bit) << 40)) for bit in range(width)]


def _variants(lanes: int, segments: int) -> list:
    """The wildcard keys of all segments; a key's tag is 64 * lane + bit."""
    return [k for lane in range(lanes) for off, width in _segments(segments) for k in _wildcards(F.col(f"fp{lane}"), off, width, lane * 64)]


def _second_variants(lanes: int, segments: int, distance: int):
    """An array of wildcard keys over the bits outside the segment that the column ``key`` is of.

    These are cut so that of two rows within the distance one segment differs by at most one bit.
    """
    tag, out, each = F.shiftrightunsigned("key", 40), F.when(F.lit(False), F.array(F.lit(0).cast("long"))), -(-(distance // 2 + 1) // lanes)
    for lane in range(lanes):
        for off, width in _segments(segments):
            keys = []
            for other in range(lanes):
                value, bits = F.col(f"fp{other}"), 64
                if other == lane:  # turned so that this segment's bits are the highest
                    value, bits = F.shiftrightunsigned(value, (off + width) % 64).bitwiseOR(F.shiftleft(value, (64 - off - width) % 64)), 64 - width
                cuts = [round(bits * i / each) for i in range(each + 1)]
                for x, y in zip(cuts, cuts[1:]):
                    keys += _wildcards(value, x, y - x, other * 64)
            out = out.when(tag.between(lane * 64 + off, lane * 64 + off + width - 1), F.array(*keys))
    return out


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over the links a-b, to the fixed point."""
    while len(a):
        m = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether rows of x (n, lanes) and y are within the distance, by broadcasting."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= distance


def _large_bucket(fp: np.ndarray, distance: int) -> np.ndarray:
    """Labels within one large bucket: breadth first, each link removes its end from the rest."""
    label, rest = np.arange(len(fp)), np.arange(len(fp))
    while len(rest):
        root, queue, rest = rest[0], [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            hit = np.zeros(len(rest), bool)
            step = max(1, 4_000_000 // len(rest))
            for at in range(0, len(front), step):
                left = ~hit
                block = _near(fp[front[at : at + step], None, :], fp[rest[left]][None, :, :], distance).any(0)
                hit[np.flatnonzero(left)[block]] = True
            found, rest = rest[hit], rest[~hit]
            if len(found):
                label[found] = root
                queue += np.array_split(found, max(1, len(found) // 64))
    return label


SMALL, MIDDLE = 48, 2048


def _bucket_labels(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by key: the first row of each one's cluster within its bucket."""
    n = len(key)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    big = np.repeat(size > SMALL, size)
    links_a, links_b = [], []
    for d in range(1, min(SMALL, n)):
        same = np.flatnonzero((key[d:] == key[:-d]) & ~big[:-d])
        if not len(same):
            break
        ok = same[_near(fp[same], fp[same + d], distance)]
        links_a.append(ok)
        links_b.append(ok + d)
    for start, count in zip(edge[:-1][size > SMALL].tolist(), size[size > SMALL].tolist()):
        part = fp[start : start + count]
        if count > MIDDLE:
            label[start : start + count] = start + _large_bucket(part, distance)
            continue
        for at in range(0, count, 256):
            i, j = np.nonzero(_near(part[at : at + 256, None, :], part[None, at:, :], distance))
            keep = j > i
            links_a.append(start + at + i[keep])
            links_b.append(start + at + j[keep])
    if links_a:
        label = _spread(label, np.concatenate(links_a), np.concatenate(links_b))
    return label


def links(nodes: DataFrame, lanes: int = 1, segments: int = SEGMENTS, distance: int = MAX_DISTANCE, large: int = LARGE_BUCKET) -> DataFrame:
    """Edges (a, b) that connect, bucket by bucket, all fingerprints within the distance.

    nodes: (node long, fp0..), one row per distinct fingerprint.  A bucket of n rows
    gives at most n - 1 edges: those of a spanning star of each of its clusters, which
    keep every connection and none of the quadratically many pairs.  A task holds one
    bucket's fingerprints at a time (8 bytes a lane), never texts.  Beyond
    2 * segments * lanes - 1 bits the search becomes probabilistic; within it, exact.

    A bucket of more than ``large`` rows is split, before anything of it moves, by the
    variants of a second cut: the bits outside its segment, in so many segments that two rows
    within the distance share a variant there too.  Only rows that agree in both stay together.
    Segments have at most 24 bits.
    """
    names = [f"fp{i}" for i in range(lanes)]
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if not len(rows):
                continue
            if held and held[0][0, 0] == rows[-1, 0]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = [rows[cut:]]
            if cut:
                yield _edges(rows[:cut], distance)
        if held:
            yield _edges(np.concatenate(held), distance)

    keyed = nodes.select(F.explode(F.array(*_variants(lanes, segments))).alias("key"), "node", *names)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key")
    hot = scratch.save(sizes, "hot")  # at most rows / large keys
    if not hot.isEmpty():
        split = keyed.join(hot, "key", "left_semi").withColumn("second", F.explode(_second_variants(lanes, segments, distance)))
        split = split.select(F.xxhash64("key", "second").alias("key"), "node", *names)
        keyed = keyed.join(hot, "key", "left_anti").unionByName(split)
    # by node too: a cluster's star has its smallest node as the centre, which buckets of one group share, so edges repeat and go
    near = keyed.repartition("key").sortWithinPartitions("key", "node")
    return near.mapInArrow(run, "a long, b long")


def _edges(rows: np.ndarray, distance: int) -> pa.RecordBatch:
    fp = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
    label = _bucket_labels(rows[:, 0], fp, distance)
    moved = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.sort(np.column_stack([rows[label[moved], 1], rows[moved, 1]]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    lanes: int = 1,
    segments: int = SEGMENTS,
    distance: int = MAX_DISTANCE,
    seed: int = SEED,
) -> DataFrame:
    """(id, fp0.., component_id): each document's fingerprint and the smallest id it reaches.

    Documents link when their fingerprints differ in at most ``distance`` bits over
    all lanes.  Equal fingerprints are contracted before the search, so copies cost
    one row each, whatever their number.  Null and empty texts have fingerprint 0 and
    link like any other; a null id stays and counts only where a component has no
    other (component_id null); repeated rows return one row each; an empty table
    gives an empty result; other columns are ignored.
    """
    names = [f"fp{i}" for i in range(lanes)]
    prints = scratch.save(fingerprints(docs, id_col, text_col, shingle, lanes, seed), "prints")
    # the id of a node: its single lane, else a 64-bit mix of the lanes
    node = F.col("fp0") if lanes == 1 else F.xxhash64(*names)
    nodes = prints.groupBy(*names).agg(F.min("id").alias("first_id")).withColumn("node", node)
    nodes = scratch.save(nodes, "nodes")
    roots = connected_components(through_lowest(links(nodes, lanes, segments, distance)))
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = scratch.save(labelled, "labelled")  # tables of their own, so that a hot component can be split in the join
    low = scratch.save(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    classes = labelled.join(low, "root").select(*names, "component_id")
    return prints.join(classes, names).select("id", *names, "component_id")


#: Minhash keys that complete the search of drop_near_duplicates, and the minima in each: of pairs at Jaccard 0.8
#: one in 13,000 shares no key.
BANDS, BAND_ROWS = 24, 5
SIMILARITY = (4, 5)
#: Rows of sets that a worker makes at a time, and rows that it gets at a time, while it holds sets.
SLICE, BATCH = 128, 512
#: Sets in one block of a bucket.
BLOCK_SETS = 256
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)


def _shingles(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles in order, words as in fingerprints; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n))


def _bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: two sets share one with probability J ** BAND_ROWS each."""
    if not len(s):
        return np.zeros(BANDS, np.int64)
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, _mix((s[None, at : at + 1024] * (_MULTIPLY | np.uint64(1))) + _ADD).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, BAND_ROWS).T:
        key = _mix(key ^ row)
    return key.view(np.int64)


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def _alike(both, a, b):
    """Whether Jaccard >= SIMILARITY, in whole numbers: sizes a and b, and of what they share; empty sets are equal."""
    t, u = SIMILARITY
    return (t + u) * both >= t * (a + b)


def _exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that a chain of pairs at SIMILARITY or more leads to."""
    size = np.array([len(x) for x in sets], np.int64)
    _, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    label, rest = np.arange(len(sets)), np.arange(len(sets))
    mark = np.zeros(len(flat) + 1, bool)
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            mine = queue.pop()
            mark[flat[start[mine] : start[mine + 1]]] = True
            both = np.array([np.count_nonzero(mark[flat[start[i] : start[i + 1]]]) for i in rest])
            mark[flat[start[mine] : start[mine + 1]]] = False
            hit = _alike(both, size[mine], size[rest])
            label[rest[hit]] = root
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return label


def _signatures(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(id, node, fp0.., bands) of docs (id, text); texts of one set of shingles are one node."""
    names = [f"fp{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            nodes, prints, bands = [], [], []
            for t in b.column(1):
                text = t.as_py()
                s = _shingles(text, shingle)
                nodes.append(_set_id(s))
                prints.append(_text_lanes(text, shingle, lanes, SEED))
                bands.append(_bands(s).tolist())
            got = np.array(prints, np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.int64()), *(pa.array(got[:, i]) for i in range(lanes)), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "node", *names, "bands"],
            )

    return docs.mapInArrow(run, "id long, node long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, root, set) of rows (node, root, text) whose text is the node's; the set as 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in scratch.tidied(batches) for at in range(0, b.num_rows, SLICE)):
            sets = [_shingles(t.as_py(), shingle) for t in b.column(2)]
            own = [i for i, (n, s) in enumerate(zip(b.column(0).to_pylist(), sets)) if _set_id(s) == n]
            some = b.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "root", "set"])

    return rows.mapInArrow(run, "node long, root long, set binary")


def _save_in_batches(df: DataFrame, name: str) -> DataFrame:
    """scratch.save while workers get BATCH rows at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return scratch.save(df, name)
    finally:
        conf.set(key, before)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs of nodes (a, b): whether their sets are at SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                linked.append(bool(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _stars(part):
    """Edges (a, b) of a spanning star of each cluster of one cell's sets."""
    import pandas as pd

    part = part.drop_duplicates("node").sort_values("node", ignore_index=True)
    label, node = _exact_groups([np.frombuffer(x, np.uint64) for x in part["set"]]), part["node"].to_numpy()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": node[label[moved]], "b": node[moved]})


def _exact_edges(buckets: DataFrame, sets: DataFrame, block: int = BLOCK_SETS) -> DataFrame:
    """Edges (a, b) at SIMILARITY that connect a bucket's strays to whatever in it is like them.

    buckets: (bucket, node, stray).  Members are dealt to blocks of about ``block`` nodes,
    strays too, and each block of members with each block of strays is one cell, which compares
    all its pairs: a task holds two blocks, whatever a bucket's size.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays")).where("n > 1 AND strays > 0")
    sizes = sizes.select("bucket", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("n", "strays")])
    rows = buckets.join(scratch.save(sizes, "blocks"), "bucket")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = rows.select("bucket", of("n").alias("i"), every("strays").alias("j"), "node")
    cells = cells.unionByName(rows.where("stray").select("bucket", every("n").alias("i"), of("strays").alias("j"), "node"))
    found = cells.join(sets.select("node", "set"), "node").groupBy("bucket", "i", "j").applyInPandas(_stars, "a long, b long")
    return found.distinct()


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = 2, segments: int = 4, distance: int = 22
) -> DataFrame:
    """docs with one document (the smallest id) of each near-duplicate group, all columns kept.

    A group is what pairs of Jaccard similarity 0.8 or more (SIMILARITY, five-word
    shingles) connect.  Candidates come from two nets: fingerprints within the distance
    that share a deletion variant, and minhash keys; the fingerprints alone find 0.76 of
    the pairs at 0.8, the keys all but one in 13,000.  What they connect is held
    against the exact sets: each member with its group's root first; members that aren't
    like it then with their links and all that share a key, in cells of bounded size.  Rows with a null id can't be told apart and all stay.  Of rows with
    the same id one stays (the smallest text).
    """
    names = [f"fp{i}" for i in range(lanes)]
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    prints = _save_in_batches(_signatures(src, shingle, lanes), "prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("id", *names)).alias("s"), F.first("bands").alias("bands"))
    nodes = scratch.save(nodes.select("node", F.col("s.id").alias("first_id"), *[F.col(f"s.{n}").alias(n) for n in names], "bands"), "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    low = keyed.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = keyed.join(low, "bucket").where("a <> node").select("a", F.col("node").alias("b"))
    # many buckets of a group give the same edge: once is enough for the joins on strays below, at most one a node and bucket is left;
    # the joins of components get about one a node
    near = scratch.save(links(nodes.select("node", *names), lanes, segments, distance).distinct(), "near")
    members = nodes.join(connected_components(through_lowest(near.unionByName(shared))), "node").select("node", "root", "first_id")
    members = scratch.save(members, "members")
    texts = src.join(members, src["id"] == members["first_id"]).select("node", "root", "text")
    sets = _save_in_batches(_sets(texts, shingle).dropDuplicates(["node"]), "sets")
    checked = _save_in_batches(_compared(members.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), sets), "checked")
    strays = scratch.save(checked.where("NOT linked").select(F.col("a").alias("root"), F.col("b").alias("node")), "strays")
    alike = checked.where("linked").select("a", "b")
    if not strays.isEmpty():
        stray = strays.select("node")
        some = near.join(stray.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(near.join(stray.withColumnRenamed("node", "b"), "b", "left_semi"))
        by_print = _save_in_batches(_compared(some.select("a", "b").distinct(), sets), "by_print").where("linked").select("a", "b")
        mixed = members.join(strays.select("root").distinct(), "root", "left_semi").select("node")
        mixed = scratch.save(mixed.join(stray.withColumn("stray", F.lit(True)), "node", "left").select("node", F.coalesce("stray", F.lit(False)).alias("stray")), "mixed")
        buckets = scratch.save(keyed.join(mixed, "node").distinct(), "buckets")
        alike = alike.unionByName(by_print).unionByName(_save_in_batches(_exact_edges(buckets, sets), "cells"))
    parts = connected_components(through_lowest(alike)).withColumnRenamed("root", "part")
    found = nodes.select("node", "first_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    keep_id = scratch.fresh(docs, "keep_id")
    keep = found.groupBy("part").agg(F.min("first_id").alias(keep_id)).select(keep_id).distinct()
    rows = docs.join(keep, F.col(id_col).cast("long") == F.col(keep_id), "left_semi")
    # combined before the shuffle, so a hot id's rows don't meet in one task
    rows = rows.groupBy(F.col(id_col)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(text_col).isNull(), F.col(text_col))).alias("row"))
    return rows.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
