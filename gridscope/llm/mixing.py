"""Mixing sources to target weights by hash-random keys, range sorts and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources up to this number are sent to every executor (under 100 bytes each); beyond it they are joined.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_col: Column, seed: int) -> Column:
    """60 pseudo-random bits of an id, the same in every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """df with, for each (value column -> name), the sum of all rows before it in its group.

    The rows are range-partitioned by (group, order), so that a group of any size spreads
    over as many partitions as it fills, and written once, which fixes the partitions.
    Sums run inside each partition, and partition totals (at most partitions + groups
    rows) give each one its offset.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = scratch.save(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    across = Window.partitionBy(*group).orderBy("__part")
    totals = placed.groupBy(*group, "__part").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    totals = totals.select(
        *group, "__part", *[(F.sum(f"__t{i}").over(across) - F.col(f"__t{i}")).alias(f"__b{i}") for i in range(len(values))]
    )
    rows = placed.select("*", *[(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)).alias(f"__r{i}") for i, v in enumerate(values)])
    out = rows.join(totals, [*group, "__part"])
    for i, name in enumerate(values.values()):
        out = out.withColumn(name, F.col(f"__b{i}") + F.col(f"__r{i}"))
    return out.drop("__part", *[f"__{p}{i}" for i in range(len(values)) for p in "br"])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, rank) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn.  All sizes
    together are shared by weight; no target exceeds epochs times its source's size,
    and what is cut off is shared again by weight.  That fixed point is a water level:
    with sources ordered by limit / weight, those below the level are at their limits,
    and the first source that its share doesn't fill shows the level.
    """
    n, total = scratch.save(sizes, "sources"), None
    n = n.withColumn("__null", F.col("source").isNull()).withColumn("__key", F.coalesce("source", F.lit("")))
    n = running_sums(n.withColumn("__one", F.lit(1).cast("long")), [], ["__null", "__key"], {"__one": "rank"})
    table = F.array(*[F.lit(float(w)) for w in weights])
    n = n.withColumn("weight", F.get(table, (F.col("rank") % len(weights)).cast("int")))
    n = n.withColumn("limit", (F.col("source_size") * epochs).cast("double")).withColumn("full_at", F.col("limit") / F.col("weight"))
    n = running_sums(n, [], ["full_at", "rank"], {"limit": "limits_below", "weight": "weights_below"})
    n = scratch.save(n, "levels")
    total = n.agg(F.sum("source_size").cast("double").alias("__total"), F.sum("weight").alias("__weights"))
    level = (
        n.crossJoin(total)  # one row
        .withColumn("level", (F.col("__total") - F.col("limits_below")) / (F.col("__weights") - F.col("weights_below")))
        .where(F.col("level") <= F.col("full_at"))
        .agg(F.min_by("level", F.struct("full_at", "rank")).alias("__level"))
    )
    target = F.least("limit", F.coalesce("__level", F.lit(float("inf"))) * F.col("weight"))
    return n.crossJoin(level).select("source", "source_size", target.alias("target"), "rank")  # one row


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    ).withColumn("key", hash_key(F.col("id"), seed))


def _with_sources(rows: DataFrame, sources: DataFrame, columns: list[str], source: str = "source") -> DataFrame:
    """rows joined to their source's columns; sources are broadcast only below a checked number."""
    name = scratch.fresh(rows, "source")
    small = sources.select(F.col("source").alias(name), *columns)
    if sources.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return rows.join(small, F.col(source).cast("string").eqNullSafe(F.col(name))).drop(name)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """(id, source, size, source_size, target, before, taken): how many words the mix takes of each row.

    Every source gives floor(target) words exactly: whole epochs of all its rows, then
    rows in the order of their hash keys until the rest is met, the last one in part.
    Null texts have size 0; a null source is a source; null and repeated ids are rows
    like others; equal rows can stand for each other; an empty table gives an empty
    result; other columns are ignored.
    """
    sized = scratch.save(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = scratch.save(source_targets(sizes, weights, epochs), "targets")
    rows = _with_sources(sized, sources, ["source_size", "target", "rank"])
    rows = running_sums(rows, ["rank"], ["key", "id", "size"], {"size": "before"})
    budget = F.floor("target")
    whole = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
    return rows.select("id", "source", "key", "size", "source_size", "target", "before", (whole * F.col("size") + rest).alias("taken"))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """docs as the mix has them: whole rows, repeated by epoch; all columns kept.

    A row is in the last, partial epoch if its middle word is; so a source misses its
    target by half a document at most.  Each source's cut is one key, so texts meet
    only one row per source and aren't sorted.
    """
    taken = mix(docs, id_col, text_col, source_col, weights, epochs, seed)
    whole = F.coalesce(F.floor(F.try_divide(F.floor("target"), F.col("source_size"))), F.lit(0).cast("long"))
    rest = F.floor("target") - whole * F.col("source_size")
    at = F.struct(F.col("key"), F.col("id"), F.col("size"))
    inside = (F.col("before") * 2 + F.col("size") <= rest * 2) & (rest > 0)
    cuts = taken.groupBy("source").agg(
        F.max(whole).alias("__whole"), F.max(F.when(inside, at)).alias("__cut")
    )
    cuts = scratch.save(cuts, "cuts")
    size, key, times, epoch, whole, cut = (scratch.fresh(docs, c) for c in ("size", "key", "times", "epoch", "whole", "cut"))
    cuts = cuts.withColumnsRenamed({"__whole": whole, "__cut": cut})
    rows = docs.withColumn(size, word_count(F.col(text_col).cast("string"))).withColumn(key, hash_key(F.col(id_col).cast("long"), seed))
    rows = _with_sources(rows, cuts, [whole, cut], source_col)
    here = F.struct(F.col(key), F.col(id_col).cast("long"), F.col(size))
    rows = rows.withColumn(times, F.col(whole) + F.when(here <= F.col(cut), 1).otherwise(0)).where(F.col(times) > 0)
    return rows.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   (source_size * 3)::DOUBLE AS lim FROM ranked),
below AS (SELECT *, lim / weight AS full_at,
                 sum(lim) OVER w - lim AS limits_below, sum(weight) OVER w - weight AS weights_below
          FROM weighed WINDOW w AS (ORDER BY lim / weight, rank ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT arg_min(l, (full_at, rank)) AS lev FROM (
          SELECT full_at, rank, ((SELECT sum(source_size)::DOUBLE FROM src) - limits_below)
                 / ((SELECT sum(weight) FROM weighed) - weights_below) AS l FROM below) WHERE l <= full_at),
tgt AS (SELECT source, source_size, least(lim, lev * weight) AS target FROM below, lev),
run AS (SELECT doc_id, size, source_size, target,
               sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
        FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source),
cut AS (SELECT *, floor(target)::BIGINT AS budget,
               CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM run)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM cut
"""
