"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it reaches.

    edges: one row per link, columns a and b (long); direction, repeats, loops and
    null ends don't matter.  Returns (node, root); nodes without a link are absent.
    Each round writes its edges to the shared folder, so the plan never grows and a
    lost executor costs one round.  Star contraction (Kiveris et al., "Connected
    Components in MapReduce and Beyond") needs O(log^2 n) rounds and never holds
    more rows than the edges it began with; hubs are pre-aggregated before joins.
    """
    spark = edges.sparkSession
    path = scratch.new_path(spark, "edges")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = scratch.save_at(e, path)
    sign = _signature(e)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = scratch.new_path(spark, "star")
        large = scratch.save_at(large, star)  # read twice: without this, its join runs twice
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.new_path(spark, "edges")
        e = scratch.save_at(small, new)
        scratch.drop(spark, path)
        scratch.drop(spark, star)
        path, before, sign = new, sign, _signature(e)
        if sign == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def through_lowest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what edges (a, b) do: every node and its lower neighbours link to the lowest of these.

    Members of a group that meet in many buckets, each with the smallest as its centre, have a link a node and bucket; what is left
    is one a node and those among the centres.  Null ends and loops go.  A node's distinct lower neighbours (one a bucket
    in such stars) are held as one list, so graphs with nodes of very many lower neighbours should go to connected_components as they are.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    lists = e.groupBy("b").agg(F.collect_set("a").alias("lower"))
    ends = lists.select(F.array_min("lower").alias("a"), F.explode(F.array_append("lower", F.col("b"))).alias("b"))
    return ends.where("a < b")


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
