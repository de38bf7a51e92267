"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, free


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: the smallest id reachable, for every id on an edge.

    Alternates large-star and small-star steps. Each step is a grouped
    minimum (combined before the shuffle) joined back to the edges, so a hub
    that touches a third of all rows is never gathered in one task. Every
    round is cut to the shared folder. Loops and repeated or null-ended edges
    are ignored; an empty table gives an empty table.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .distinct()
    )
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
            .select("p.a", "p.b")
            .filter("a <> b")
            .distinct()
        )
        old, e = e, cut(small)
        free(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
