"""Region trees: closure tables, ancestors at a level, roll-ups and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut


def closure(tree: DataFrame) -> DataFrame:
    """``tree(id, parent)`` -> ``(ancestor, descendant, depth)``, each node its own ancestor at depth 0.

    One join with the tree for each level; stops at the first level without rows.
    A node that is its own ancestor is an error.
    """
    up = tree.select(F.col("id").alias("_id"), F.col("parent").alias("_up"))
    step = tree.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"))
    out = step
    while True:
        step = cut(step.join(up, F.col("ancestor") == F.col("_id")).filter("_up is not null").select(F.col("_up").alias("ancestor"), "descendant", (F.col("depth") + 1).alias("depth")))
        n, rings = step.agg(F.count("*"), F.count(F.when(F.col("ancestor") == F.col("descendant"), 1))).first()
        if rings:
            raise ValueError("the tree has a cycle")
        if not n:
            return out
        out = out.unionByName(step)


def lookup(tree: DataFrame, closed: DataFrame) -> DataFrame:
    """id, name, level, parent and the root-first list of ancestors."""
    path = closed.filter("depth > 0").groupBy("descendant").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))), lambda x: x["ancestor"]).alias("ancestors"))
    return tree.join(path, tree.id == path.descendant, "left").select("id", "name", "level", "parent", F.coalesce("ancestors", F.array().cast("array<bigint>")).alias("ancestors"))


def descendants(closed: DataFrame, ids: list[int], itself: bool = True) -> DataFrame:
    return closed.filter(F.col("ancestor").isin(ids) & (F.col("depth") >= (0 if itself else 1))).select("ancestor", "descendant", "depth")


def at_level(labels: DataFrame, tree: DataFrame, closed: DataFrame, level: int) -> DataFrame:
    """The ancestor at exactly ``level``, else null; the sign of ``label`` is ignored."""
    exact = closed.join(tree.filter(F.col("level") == level).select(F.col("id").alias("ancestor")), "ancestor").select("descendant", "ancestor")
    return labels.join(exact, F.abs("label") == F.col("descendant"), "left").select("label", F.col("ancestor").alias("at_level"))


def parent_at_most(labels: DataFrame, tree: DataFrame, closed: DataFrame, level: int | None) -> DataFrame:
    """The nearest ancestor whose level is at most ``level`` (None: one above the label's own); 0 if there is none."""
    up = closed.join(tree.select(F.col("id").alias("ancestor"), F.col("level").alias("up_level")), "ancestor").join(tree.select(F.col("id").alias("descendant"), F.col("level").alias("own")), "descendant")
    fits = F.col("up_level") <= (F.col("own") - 1 if level is None else F.lit(level))
    near = up.filter(fits).groupBy("descendant").agg(F.min_by("ancestor", "depth").alias("near"))
    return labels.join(near, F.abs("label") == F.col("descendant"), "left").select("label", F.coalesce("near", F.lit(0)).alias("parent_label"))


def ids_to_level(tree: DataFrame, closed: DataFrame, level: int) -> DataFrame:
    """Every id of at most ``level`` with itself and all its descendants."""
    return closed.join(tree.filter(F.col("level") <= level).select(F.col("id").alias("ancestor")), "ancestor").select("ancestor", "descendant")


def roll_up(leaves: DataFrame, closed: DataFrame, sums: list[str], means: dict[str, str]) -> DataFrame:
    """Sums, and means weighted by a sum column, of all descendants of each id; ``leaves`` has ``region``."""
    joined = closed.join(leaves, F.col("descendant") == F.col("region"))
    weighted = [F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(F.when(F.col(c).isNotNull(), F.col(w)))).alias(c) for c, w in means.items()]
    return joined.groupBy(F.col("ancestor").alias("id")).agg(*[F.sum(c).alias(c) for c in sums], *weighted)


def relabel(voxels: DataFrame, tree: DataFrame, closed: DataFrame, level: int, label: str = "label") -> DataFrame:
    """Labels below a region of exactly ``level`` take its id with their sign; others stay."""
    exact = closed.join(tree.filter(F.col("level") == level).select(F.col("id").alias("ancestor")), "ancestor").select("descendant", "ancestor")
    return voxels.join(exact, F.abs(label) == F.col("descendant"), "left").withColumn(label, F.coalesce(F.signum(label).cast("long") * F.col("ancestor"), F.col(label).cast("long"))).drop("descendant", "ancestor")


def translate(voxels: DataFrame, pairs: DataFrame, closed: DataFrame, children: bool = True, clear: bool = False) -> DataFrame:
    """``pairs(from_label, to_label)`` applied to labels, to their children too; others stay or become 0."""
    wide = closed.join(pairs, F.col("ancestor") == F.col("from_label")).filter("true" if children else "depth = 0").groupBy("descendant").agg(F.min_by("to_label", "depth").alias("to_label"))
    return voxels.join(wide, F.col("label") == F.col("descendant"), "left").withColumn("label", F.coalesce("to_label", F.lit(0) if clear else F.col("label"))).drop("descendant", "to_label")


def network(listed: DataFrame, closed: DataFrame) -> DataFrame:
    """Each listed node's nearest listed ancestor and that node's list of children."""
    up = closed.filter("depth > 0").join(listed.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").join(listed.select(F.col("id").alias("descendant")), "descendant", "left_semi")
    near = up.groupBy("descendant").agg(F.min_by("ancestor", "depth").alias("parent"))
    return near.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("descendant").alias("first_child"))


def mirrored_ids(ids: DataFrame, combine: bool = False) -> DataFrame:
    """Ids of the other side, negated; with ``combine`` those of both sides, each once."""
    other = ids.select((-F.col("id")).alias("id"))
    return ids.select("id").unionByName(other).distinct() if combine else other


def side(label: Column) -> Column:
    """Aggregate: R if all labels are positive, L if all are negative, else both."""
    return F.when(F.min(label) > 0, "R").when(F.max(label) < 0, "L").otherwise("both")


def side_name(name: Column, label: Column) -> Column:
    """A region's name with its hemisphere."""
    return F.concat(name, F.when(label > 0, " (R)").when(label < 0, " (L)").otherwise(""))
