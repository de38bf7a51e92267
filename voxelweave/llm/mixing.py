"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, partitions

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``docs(source, size)`` -> ``(source, source_size, target)``.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size;
    what it leaves is shared again by weight. The table of sources is small
    next to the rows, but is not assumed to fit one task: it is range-sorted,
    and each round of sharing is one aggregate. No rows give no rows; if all
    sizes are 0, all targets are 0.
    """
    spark = docs.sparkSession
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = cut(
        by_source.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", F.monotonically_increasing_id().alias("id"))
        .select("source", "source_size", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(2**33 - 1).alias("row"))
    )
    before, start = 0, []
    for part, n in sorted((r.part, r.n) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):
        start.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(start, "part long, before long"))  # a row per partition
    weight = F.array(*map(F.lit, weights))[((F.col("before") + F.col("row")) % len(weights)).cast("int")]
    ranked = ranked.join(starts, "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    total, share, level = ranked.agg(F.sum("source_size")).first()[0] or 0, None, 0.0
    while share != level:  # rises; a round caps at least one more source
        share = level
        free = F.col("cap") > F.col("weight") * F.lit(share)
        full, w = ranked.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        level = (total - (full or 0.0)) / w if w else share
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def mix_copies(docs: DataFrame, seed: str = "mix", weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, and size, source_size, target, copies.

    A document of a source with rate r = target / source_size is taken
    floor(r) times, and once more if a coin with probability r - floor(r),
    seeded by ``seed`` and doc_id, says so. Size: words of the text (null: 0).
    Copies of a doc_id share their coin, so reruns agree; rows with a null
    doc_id share one coin per source.
    """
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sized, weights, most).select(F.col("source").alias("_source"), "source_size", "target")
    coin = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") / float(2**48)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rate", rate)
        .select("row", "doc_id", "size", "source_size", "target", (F.floor("rate") + F.when(coin < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, all columns as they are.

    A source without words (null and empty texts only) has the rate 0, so its rows go. Repeated rows of a doc_id share
    its coin; null is a source like others. No rows give no rows; other columns may have any name.
    """
    taken = mix_copies(docs, **options).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words)."""
    return mix_copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
