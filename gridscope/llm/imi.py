"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook; a cell is a pair
of centroids.  A query walks the cells by summed half distances, best first, with a
heap over the two sorted lists of centroids, until the cells hold enough entries;
those entries are reranked by exact distances.  How many are enough is measured on
the sample that fits the codebooks: the share of entries in whose cells RECALL of its exact
neighbours lie.  Clustered vectors need a small one; vectors without structure nearly all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch
from gridscope.llm.sampling import bounded_sample

#: Entries that a cell has on average: codebooks grow with the table, from 4 to MAX_CENTROIDS centroids a half.
CELL_ENTRIES, MAX_CENTROIDS = 50, 256
#: Rows that fit the codebooks: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
ITERATIONS = 12
#: The sample's queries and the share of their neighbours that the share of visited entries is chosen for.
SAMPLE_QUERIES, RECALL = 300, 0.96
MIN_ENTRIES = 2_000
#: Entries of a zone, the unit of reranking: several small cells, or a part of a large one (of copies of one vector too).
ZONE_ENTRIES = 4_000
#: Queries that meet a zone in one group, and those among them that are reranked at a time.
PART_QUERIES, BLOCK_QUERIES = 20_000, 256
#: Query vectors up to this many bytes are sent to every executor; more are joined.
BROADCAST_BYTES = 32 << 20


def usable(vec: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def train(points: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Lloyd's k-means from rows evenly spread over the points; fewer distinct points give fewer centroids."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    rng = np.random.default_rng(7)
    centres = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(iterations):
        near = _nearest(points, centres)
        total = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_distances(x[i : i + 8192], centres), 1) for i in range(0, len(x), 8192)] or [np.zeros(0, int)])


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells (i * len(d2) + j) by d1[i] + d2[j], until they hold the needed entries; empty cells are passed over."""
    o1, o2, found, held = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), [], 0
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap = [(a[0] + b[0], 0, 0)]
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(b) + int(o2[j])
        n = int(counts[cell])
        if n:
            found.append(cell)
            held += n
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each row of pairs begins once its predecessor has
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def needed_share(points: np.ndarray, books: list[np.ndarray], cut: int, k: int, recall: float = RECALL) -> float:
    """The smallest share of entries, in the order in which cells are visited, that holds this part of exact neighbours.

    Queries are the first SAMPLE_QUERIES points, neighbours their k nearest among all
    points.  In a larger table neighbours are nearer, so the share errs to the safe side.
    """
    n = min(SAMPLE_QUERIES, len(points))
    cell = _nearest(points[:, :cut], books[0]) * len(books[1]) + _nearest(points[:, cut:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    out = []
    for i in range(n):
        far = ((points - points[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(points) - 1)]
        sums = (_distances(points[i : i + 1, :cut], books[0])[0][:, None] + _distances(points[i : i + 1, cut:], books[1])[0][None]).ravel()
        order = np.argsort(sums, kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(counts[order])
        out.append(held[cell[near]])
    found = np.sort(np.concatenate(out)) if out else np.zeros(0)
    return float(found[min(len(found) - 1, int(np.ceil(recall * len(found))))] / len(points)) if len(found) else 1.0


def _zones(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zone, blocks) of each cell: consecutive small cells share a zone of ZONE_ENTRIES, a larger cell has its own, in blocks."""
    blocks = np.maximum(1, -(-counts // ZONE_ENTRIES))
    zone, at, held = np.zeros(len(counts), np.int32), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > ZONE_ENTRIES:
            at, held = at + 1, 0
        zone[i] = at
        held += n
    return zone, blocks.astype(np.int32)


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    centroids: int | None = None,
    share: float | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that satisfies ``queries``.

    Scores are Euclidean distances of the original vectors in double precision; ties go
    to the smaller id.  All usable rows with an id and the commonest length are indexed;
    others (null, zero, non-finite, null id, other lengths) take no part.  A query isn't
    its own neighbour; other rows that repeat its id aren't either, and a repeated id
    counts once, by its nearest row: rows of one id and vector are contracted first, and
    a zone gives k distinct ids.  Empty tables give empty results; other columns
    are ignored.

    Codebooks, of as many centroids as the table needs unless told, are fitted on a
    bounded sample, and so is the share of entries that a query's cells must hold.  Cells are
    packed into zones of bounded size, and a zone meets the queries that visit a cell
    of it, a bounded number at a time, in numpy, giving k rows per query: candidate pairs are
    never rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    # a row repeated with its vector would fill cells and zones; combined before the shuffle, a hot row is one per task
    rows = scratch.save(rows.groupBy("id", "v").agg(F.max("asked").alias("asked")), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.count_if("asked").alias("asked")).orderBy(F.desc("count"), "n").head()
    if sizes is None or not sizes["asked"]:
        return empty
    width, total, n_asked = int(sizes["n"]), int(sizes["count"]), int(sizes["asked"])
    rows = rows.where(F.size("v") == width)
    sample = bounded_sample(rows.select("id", "v"), ["id"], sample_rows).select("v").toArrow()
    points = _matrix(sample["v"].combine_chunks(), width)
    cut = max(1, width // 2)
    centroids = centroids or int(np.clip(round((total / CELL_ENTRIES) ** 0.5), 4, MAX_CENTROIDS))
    books = [train(points[:, :cut], centroids), train(points[:, cut:], centroids)]
    share = needed_share(points, books, cut, k) if share is None else share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.tidied(batches):
            x = _matrix(b.column("v"), width)
            cell = _nearest(x[:, :cut], books[0]) * len(books[1]) + _nearest(x[:, cut:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    placed = scratch.save(rows.mapInArrow(assign, "id long, v array<double>, asked boolean, cell int"), "cells")
    filled = placed.groupBy("cell").count().collect()  # at most MAX_CENTROIDS ** 2 rows
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in filled:
        counts[r["cell"]] = r["count"]
    need = max(MIN_ENTRIES, int(np.ceil(share * counts.sum())))
    zone, blocks = _zones(counts)
    parts = -(-n_asked // PART_QUERIES)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column("v"), width), b.column("id").to_numpy()
            d1, d2 = _distances(x[:, :cut], books[0]), _distances(x[:, cut:], books[1])
            for q in range(len(x)):
                cells = np.sort(np.array(walk(d1[q], d2[q], counts, need), np.int32))
                edge = np.flatnonzero(np.r_[True, zone[cells[1:]] != zone[cells[:-1]], True])
                first = cells[edge[:-1]]
                n = blocks[first]
                again = np.repeat(np.arange(len(first)), n)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lists = pa.array([cells[edge[i] : edge[i + 1]] for i in again.tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(zone[first][again]), pa.array(block.astype(np.int32)), pa.array(np.full(len(again), ids[q])), lists], names=["zone", "block", "id", "cells"]
                )

    asked = placed.where("asked").select("id", "v")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    visits = asked.mapInArrow(visit, "zone int, block int, id long, cells array<int>").withColumn("part", part).repartition("zone", "block", "part")
    sent = F.broadcast(asked) if n_asked * width * 8 <= BROADCAST_BYTES else asked
    table = visits.join(sent, "id").select("zone", "block", "part", "id", "cells", "v")
    # a row per cell, MAX_CENTROIDS ** 2 at most; the block of an entry of a large cell: a hash of its id spreads it evenly
    where = spark.createDataFrame([(int(c), int(zone[c]), int(blocks[c])) for c in np.flatnonzero(counts)], "cell int, zone int, blocks int")
    entries = placed.join(F.broadcast(where), "cell").select("zone", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cell", "id", "v")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            left, right = left.combine_chunks(), right.combine_chunks()
            x, ids, cell = _matrix(left["v"].chunk(0), width), left["id"].to_numpy(), left["cell"].to_numpy()
            names, cell = np.unique(cell, return_inverse=True)
            q, qid, lists = _matrix(right["v"].chunk(0), width), right["id"].to_numpy(), right["cells"].chunk(0)
            for at in range(0, len(q), BLOCK_QUERIES):
                some = lists.slice(at, BLOCK_QUERIES)
                row = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy(zero_copy_only=False))
                col = np.searchsorted(names, some.flatten().to_numpy())  # every visited cell has entries, in some block
                fine = (col < len(names)) & (names[np.minimum(col, len(names) - 1)] == some.flatten().to_numpy())
                seen = np.zeros((len(some), len(names)), bool)
                seen[row[fine], col[fine]] = True
                found.append(_best(q[at : at + BLOCK_QUERIES], qid[at : at + BLOCK_QUERIES], x, ids, k, seen[:, cell]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ("zone", "block", "part")
    found = entries.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest distinct ids of each query, distances from differences (not from products, which cancel).

    seen: which entries each query may find, all by default.
    """
    by_id = np.argsort(ids, kind="stable")
    x, ids = x[by_id], ids[by_id]
    rough = _distances(q, x)
    rough[qid[:, None] == ids[None]] = np.inf
    if seen is not None:
        rough[~seen[:, by_id]] = np.inf
    each = np.minimum.reduceat(rough, np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), axis=1)
    # exact distances of whatever rounding could put among the first k
    kth = np.partition(each, min(k, each.shape[1]) - 1, axis=1)[:, min(k, each.shape[1]) - 1]
    scale = (q**2).sum(1) + (x**2).sum(1).max()
    row, col = np.nonzero((rough <= (kth + 1e-10 * scale)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((q[row] - x[col]) ** 2).sum(1))
    order = np.lexsort((ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    _, first = np.unique(np.column_stack([row, ids[col]]), axis=0, return_index=True)  # each id's nearest row
    first.sort()
    row, col, exact = row[first], col[first], exact[first]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < k
    return qid[row[top]], ids[col[top]], exact[top]
