"""Neighbour joins on a grid: always equi-joins on a bucket, never a join on a distance alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope.functions import exact_sum, finite, materialised


def _usable(points: DataFrame) -> DataFrame:
    return points.where(finite(F.col("x")) & finite(F.col("y")))


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _spread(size: float, rings: int = 1) -> Column:
    """The buckets around a point's own."""
    near = range(-rings, rings + 1)
    bx, by = _bucket(F.col("x"), size), _bucket(F.col("y"), size)
    return F.explode(F.array(*[F.struct((bx + i).alias("bx"), (by + j).alias("by")) for i in near for j in near]))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, left_id, right_id, d2) of all pairs with d^2 <= radius^2; buckets are as wide as the radius."""
    a = _usable(left).select(*group, F.col("id").alias("left_id"), F.col("x").alias("__x"), F.col("y").alias("__y"), _spread(radius).alias("__b"), "x", "y")
    a = a.select(*group, "left_id", "__x", "__y", "__b.bx", "__b.by")
    b = _usable(right).select(*group, F.col("id").alias("right_id"), "x", "y", _bucket(F.col("x"), radius).alias("bx"), _bucket(F.col("y"), radius).alias("by"))
    d2 = (F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x")) + (F.col("y") - F.col("__y")) * (F.col("y") - F.col("__y"))
    return a.join(b, [*group, "bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(*group, "left_id", "right_id", "d2")


def nearest_k(
    queries: DataFrame, targets: DataFrame, k: int, group: Sequence[str] = (), cell: float | None = None, exclude_self: bool = False, skip_equal: bool = False
) -> DataFrame:
    """(group, query_id, target_id, d2, rank) of the k nearest targets of each query, ties to the smaller id.

    Rounds with growing buckets: a query is done once its k-th target is nearer than a
    bucket's width, since all targets that near are in the 3 x 3 buckets searched; the
    others, ever fewer, go on with buckets twice as wide until those span everything.
    A round's density is bounded by the first bucket width, which holds about k targets.
    """
    q, t = _usable(queries).select(*group, "id", "x", "y"), _usable(targets).select(*group, "id", "x", "y")
    seen = t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not seen[4]:
        return q.select(*group, F.col("id").alias("query_id"), F.lit(0).cast("long").alias("target_id"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).where("false")
    reach = q.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    lows = [min(v for v in pair if v is not None) for pair in ((seen[0], reach[0]), (seen[2], reach[2]))]
    highs = [max(v for v in pair if v is not None) for pair in ((seen[1], reach[1]), (seen[3], reach[3]))]
    width, height = highs[0] - lows[0], highs[1] - lows[1]
    groups = t.select(*group).distinct().count() if group else 1
    size = cell or max((max(width, 1e-9) * max(height, 1e-9) * k * groups / seen[4]) ** 0.5, 1e-9, max(width, height) / 1e6)
    found, left = [], q
    while True:
        last = size >= max(width, height)
        a = left.select(*group, F.col("id").alias("query_id"), F.col("x").alias("__x"), F.col("y").alias("__y"), _spread(size).alias("__b"), "x", "y")
        a = a.select(*group, "query_id", "__x", "__y", "__b.bx", "__b.by")
        b = t.select(*group, F.col("id").alias("target_id"), "x", "y", _bucket(F.col("x"), size).alias("bx"), _bucket(F.col("y"), size).alias("by"))
        d2 = (F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x")) + (F.col("y") - F.col("__y")) * (F.col("y") - F.col("__y"))
        pairs = a.join(b, [*group, "bx", "by"]).withColumn("d2", d2)
        if exclude_self:
            pairs = pairs.where("query_id <> target_id")
        if skip_equal:
            pairs = pairs.where("d2 > 0")
        w = Window.partitionBy(*group, "query_id").orderBy("d2", "target_id")
        ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*group, "query_id", "target_id", "d2", "rank")
        if last:
            found.append(ranked)
            break
        ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
        done = ranked.where((F.col("rank") == k) & (F.col("d2") <= size * size)).select(*group, "query_id")
        found.append(ranked.join(done, [*group, "query_id"], "left_semi"))
        left = left.join(done.withColumnRenamed("query_id", "id"), [*group, "id"], "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
        if left.isEmpty():
            break
        size *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def nearest(queries: DataFrame, targets: DataFrame, group: Sequence[str] = (), cell: float | None = None) -> DataFrame:
    return nearest_k(queries, targets, 1, group, cell).drop("rank")


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, group: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs, each the other's nearest, at most radius apart (inclusive): candidates are within the radius only."""
    pairs = radius_pairs(left, right, radius, group)
    a = pairs.withColumn("__a", F.row_number().over(Window.partitionBy(*group, "left_id").orderBy("d2", "right_id")))
    b = a.withColumn("__b", F.row_number().over(Window.partitionBy(*group, "right_id").orderBy("d2", "left_id")))
    return b.where("__a = 1 AND __b = 1").select(*group, "left_id", "right_id", F.sqrt("d2").alias("distance"))


def nearest_within(points: DataFrame, holes: DataFrame, tolerance: float, group: Sequence[str] = ()) -> DataFrame:
    """Each point goes to its nearest hole if nearer than the tolerance (exclusive); a hole keeps its closest point."""
    pairs = radius_pairs(points, holes, tolerance, group).where(F.col("d2") < tolerance * tolerance)
    own = pairs.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "left_id").orderBy("d2", "right_id"))).where("__k = 1")
    best = own.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "right_id").orderBy("d2", "left_id"))).where("__k = 1")
    return best.select(*group, F.col("right_id").alias("hole_id"), F.col("left_id").alias("point_id"), F.sqrt("d2").alias("distance"))


def unique_matches(points: DataFrame, truth: DataFrame, radius: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """Points whose nearest truth is nearer than the radius; truths hit twice give none."""
    pairs = radius_pairs(points, truth, radius, group).where(F.col("d2") < radius * radius)
    own = pairs.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "left_id").orderBy("d2", "right_id"))).where("__k = 1")
    hits = own.withColumn("__n", F.count("*").over(Window.partitionBy(*group, "right_id"))).where("__n = 1")
    return hits.select(*group, F.col("left_id").alias("point_id"), F.col("right_id").alias("truth_id"), F.sqrt("d2").alias("distance"))


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): smallest node that each one with an edge reaches, by hooking to the least neighbour and halving paths.

    edges: a, b (long).  Every round is materialised by checkpoint() if the session names
    a checkpoint folder, else cached; components of n nodes need about log n rounds.
    """
    spark = edges.sparkSession
    keep = (lambda d: d.checkpoint()) if spark.conf.get("spark.checkpoint.dir", None) else (lambda d: d.persist(StorageLevel.MEMORY_AND_DISK))
    e = edges.select("a", "b").where("a <> b")
    both = keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    before = None
    for _ in range(rounds):
        near = both.join(root.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = root.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("low"))
        # the old root of a node takes over the least root that any of its members saw
        low = hooked.groupBy("root").agg(F.min("low").alias("low"))
        moved = hooked.select("node", "root").join(low, "root").select("node", F.col("low").alias("up"))
        jump = moved.join(moved.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up", "left")
        root = keep(jump.select("node", F.coalesce("upper", "up").alias("root")))
        now = tuple(root.agg(F.bit_xor(F.xxhash64("node", "root")), F.sum(F.col("root").cast("decimal(38,0)"))).first())
        if now == before:
            return root
        before = now
    raise RuntimeError("components did not settle")


def _near_box(box: str) -> Column:
    """Squared distance of the point (x, y) to a struct of bounds."""
    out = [F.greatest(F.col(f"{box}.{c}0") - F.col(c), F.col(c) - F.col(f"{box}.{c}1"), F.lit(0.0)) for c in "xy"]
    return out[0] * out[0] + out[1] * out[1]


def _cell_links(points: DataFrame, eps: float, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, roots): cells whose points are all within eps of each other, named by their smallest id, and connected() of them.

    Neighbouring cells are first held against each other by their outermost points; only
    cells that this leaves in different components, and of those only the points within
    eps of the other cell's bounds, are compared in pairs.
    """
    size = eps * 0.7071  # a cell's diagonal is just below eps
    p = points.withColumns({"__bx": _bucket(F.col("x"), size), "__by": _bucket(F.col("y"), size)})
    lone = F.when(F.greatest(F.lit(False), F.lit(False), *[F.col(g).isNull() for g in group]), F.col("id"))  # no group: near nothing
    p, xy = p.withColumn("__lone", lone), F.struct("x", "y")
    far = [f(xy, F.struct(*order)) for order in (("x", "y"), ("y", "x")) for f in (F.min_by, F.max_by)]
    box = F.struct(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    cells = p.groupBy(*group, "__bx", "__by", "__lone").agg(
        F.min("id").alias("node"), F.count("*").alias("n"), *[f(F.col(c)).alias(f"{n}{c}") for c in "xy" for f, n in ((F.sum, "s"), (exact_sum, "e"))], box.alias("box"), F.array(*far).alias("far")
    )
    cells = materialised(cells)
    steps = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    a = cells.select(*group, F.col("node").alias("a"), F.col("box").alias("abox"), F.col("far").alias("afar"), F.explode(F.array(*[F.struct((F.col("__bx") + i).alias("i"), (F.col("__by") + j).alias("j")) for i, j in steps])).alias("__s"))
    b = cells.select(*group, F.col("node").alias("b"), F.col("box").alias("bbox"), F.col("far").alias("bfar"), F.col("__bx").alias("i"), F.col("__by").alias("j"))
    met = a.select(*group, "a", "abox", "afar", "__s.i", "__s.j").join(b, [*group, "i", "j"])
    gap = [F.greatest(F.col(f"abox.{c}0") - F.col(f"bbox.{c}1"), F.col(f"bbox.{c}0") - F.col(f"abox.{c}1"), F.lit(0.0)) for c in "xy"]
    d2 = lambda u, v: (u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"])
    sure = F.exists("afar", lambda u: F.exists("bfar", lambda v: d2(u, v) <= eps * eps))
    # bounds are compared a little wider: only d2 decides
    met = materialised(met.where(gap[0] * gap[0] + gap[1] * gap[1] <= eps * eps * 1.0001).select(*group, "a", "b", "abox", "bbox", sure.alias("sure")))
    links = met.where("sure").select("a", "b")
    roots = connected(links)
    for c in "ab":
        met = met.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"__r{c}")), c, "left")
    apart = materialised(met.where("NOT sure").where(F.coalesce("__ra", "a") != F.coalesce("__rb", "b")).select("a", "b", "abox", "bbox"))
    if apart.isEmpty():
        return cells, roots
    named = p.join(cells.select(*group, "__bx", "__by", "node"), [*group, "__bx", "__by"])  # rows without a group are near nothing
    reach = eps * eps * 1.0001
    left = apart.join(named.select(F.col("node").alias("a"), "x", "y"), "a").where(_near_box("bbox") <= reach).select("a", "b", F.struct("x", "y").alias("u"))
    right = apart.join(named.select(F.col("node").alias("b"), "x", "y"), "b").where(_near_box("abox") <= reach).select("a", "b", F.struct("x", "y").alias("v"))
    exact = left.distinct().join(right.distinct(), ["a", "b"]).where(d2(F.col("u"), F.col("v")) <= eps * eps).select("a", "b").distinct()
    return cells, connected(links.unionByName(exact))


def dedupe(points: DataFrame, eps: float = 1.5, group: Sequence[str] = ()) -> DataFrame:
    """Points within eps of each other, transitively, become their mean; (group, root, x, y, n), ids unique over all groups.

    Work grows with the points and the cells of about eps that they lie in, not with the pairs within eps.
    """
    cells, roots = _cell_links(_usable(points).select(*group, "id", "x", "y"), eps, group)
    labelled = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    exact = lambda c: F.when(F.count(f"e{c}") == F.count("*"), (F.try_sum(f"e{c}") / F.sum("n")).cast("double"))  # noqa: E731  whatever the order of the rows
    mean = [F.coalesce(exact(c), F.sum(f"s{c}") / F.sum("n")).alias(c) for c in "xy"]
    return labelled.groupBy(*group, "root").agg(*mean, F.sum("n").alias("n"))


def nearest_seed_cells(pixels: DataFrame, seeds: DataFrame, page: str = "page") -> DataFrame:
    """(page, x, y, v, seed_id): each pixel's nearest seed of its page, ties to the lowest id; -1 on a page without seeds.

    Pixels of one place and page are one query, whatever their number.
    """
    key = F.struct(F.col(page), F.col("x"), F.col("y"))
    places = pixels.select(page, "x", "y").distinct().select(page, F.xxhash64(key).alias("id"), "x", "y")
    found = nearest(places, seeds.select(page, F.col("seed_id").alias("id"), "x", "y"), [page])
    found = places.join(found.withColumnRenamed("query_id", "id"), [page, "id"], "left").select(page, "x", "y", F.coalesce("target_id", F.lit(-1)).alias("seed_id"))
    return pixels.join(found, [page, "x", "y"])


def median_spacing(points: DataFrame, group: Sequence[str] = (), skip_equal: bool = True) -> DataFrame:
    """Median distance to the nearest other point; exact duplicates can be passed over."""
    near = nearest_k(points, points, 1, group, exclude_self=True, skip_equal=skip_equal)
    return near.groupBy(*group).agg(F.percentile(F.sqrt("d2"), F.lit(0.5)).alias("spacing"), F.count("*").alias("n"))


def hole_at(points: DataFrame, cells: DataFrame, seeds: DataFrame, spacing: float, page: str = "page") -> DataFrame:
    """The hole whose cell holds a point's pixel, else the nearest within 3/4 of the spacing, else -1."""
    p = points.withColumn("__px", F.floor(F.col("x") + 0.5)).withColumn("__py", F.floor(F.col("y") + 0.5))
    labels = cells.select(page, F.col("x").alias("__px"), F.col("y").alias("__py"), F.col("seed_id").alias("__cell"))
    p = p.join(labels, [page, "__px", "__py"], "left")
    near = nearest(points.select(page, "id", "x", "y"), seeds.select(page, F.col("seed_id").alias("id"), "x", "y"), [page])
    near = near.where(F.col("d2") <= (0.75 * spacing) ** 2).select(page, F.col("query_id").alias("id"), F.col("target_id").alias("__near"))
    p = p.join(near, [page, "id"], "left")
    return p.select(page, "id", F.coalesce(F.when(F.col("__cell") >= 0, F.col("__cell")), F.col("__near"), F.lit(-1)).alias("hole"))


def pixel_neighbours(pixels: DataFrame, eight: bool = True) -> DataFrame:
    """(page, x, y, v, nx, ny, nv) for the 4 or 8 neighbours of each pixel that exist: an equi-join on the place."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    out = pixels.select("page", "x", "y", "v", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s"))
    out = out.select("page", "x", "y", "v", (F.col("x") + F.col("s.i")).alias("nx"), (F.col("y") + F.col("s.j")).alias("ny"))
    return out.join(pixels.select("page", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("v").alias("nv")), ["page", "nx", "ny"])


def local_maxima(pixels: DataFrame) -> DataFrame:
    """Pixels above all their 8 neighbours (ties fall to the first by y, x)."""
    n = pixel_neighbours(pixels)
    beaten = (F.col("nv") > F.col("v")) | ((F.col("nv") == F.col("v")) & (F.struct("ny", "nx") < F.struct("y", "x")))
    return n.groupBy("page", "x", "y", "v").agg(F.bool_or(beaten).alias("b")).where("NOT b").drop("b")


def boundary_pixels(labels: DataFrame) -> DataFrame:
    """Pixels (v is their label) with a 4-neighbour of another label."""
    return pixel_neighbours(labels, eight=False).where("nv <> v").select("page", "x", "y", "v").distinct()


def dilate(mask: DataFrame, size: int = 1) -> DataFrame:
    """Places (page, x, y) within a square of the given radius around any."""
    near = range(-size, size + 1)
    spread = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in near for j in near])).alias("p")
    return mask.select("page", spread).select("page", "p.x", "p.y").distinct()


def unmodelled_pixels(labels: DataFrame, modelled: DataFrame, size: int = 2) -> DataFrame:
    """Pixels of components that no model has, dilated."""
    return dilate(labels.where("label > 0").join(modelled, ["page", "label"], "left_anti").select("page", "x", "y"), size)
