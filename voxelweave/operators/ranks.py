"""Ranks and quantiles within groups from range-sorted counts, so that no group passes through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, partitions


def running(counts: DataFrame, keys: Sequence[str], order: str, n: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the rows of the same ``keys`` with a smaller ``order``.

    Rows are ranged by keys and order; sums run within a range, and the
    totals of a group's ranges, one row each, give each range its start.
    """
    blocks = cut(counts.repartitionByRange(partitions(counts.sparkSession), *keys, order).withColumn("_block", F.spark_partition_id()))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*keys, "_block").agg(F.sum(n).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier(*keys).orderBy("_block")), F.lit(0)))
    inside = blocks.withColumn("_inside", F.coalesce(F.sum(n).over(earlier(*keys, "_block").orderBy(order)), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_block")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = inside.alias("l").join(totals.alias("r"), on)
    return out.select(*[F.col(f"l.{c}").alias(c) for c in counts.columns], (F.col("_inside") + F.col("_start")).alias("before"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each of ``shares``; nulls do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running(counts, keys, value, "_c")
    size = ranked.groupBy(*keys).agg(F.sum("_c").alias("_size"))
    ranked = ranked.join(size, list(keys)) if keys else ranked.crossJoin(F.broadcast(size))  # one row
    cols = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_size") - 1)
        pick = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_c")), F.col(value).cast("double")))
        low, high, part = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        cols.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*cols)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``rank`` within the group, ties sharing their mean, and ``ties``, how many share it."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    ranks = running(counts, keys, value, "ties").withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")
    return df.join(ranks, [*keys, value])
