"""Composed region jobs: variation within regions and segments, weighted roll-ups, atlases compared, and tables over samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .hierarchy import translate
from .ranks import quantiles

CELL = ["z", "y", "x"]

#: How each metric of a region comes from those of its parts. sum: added up; else the column that weighs its mean.
ROLL_UP = {
    "volume": "sum", "intensity": "sum", "nuclei": "sum", "edge_size": "sum", "edge_dist_sum": "sum",
    "var_intensity": "volume", "mean_intensity": "volume", "median_intensity": "volume", "low_intensity": "volume", "high_intensity": "volume", "entropy_intensity": "volume",
    "coef_var_intensity": "volume", "var_intensity_in": "volume", "var_intensity_out": "volume", "var_intensity_match": "volume", "var_intensity_diff": "volume",
    "var_nuclei": "nuclei", "mean_nuclei": "nuclei", "coef_var_nuclei": "nuclei", "var_nuclei_in": "nuclei", "var_nuclei_out": "nuclei", "var_nuclei_match": "nuclei",
    "edge_dist_mean": "edge_size",
}


def weight_of(metric: str) -> str | None:
    """The column that weighs a metric's mean; None for sums and unknown metrics."""
    how = ROLL_UP.get(metric)
    return None if how == "sum" else how


def _compiled(columns: Sequence[str], table: dict[str, str]) -> list[Column]:
    """An aggregate for each of the columns that the table names.

    A weighted mean is the sum of metric times weight over the whole weight, also
    of parts that lack the metric; 0 becomes null.
    """
    out = []
    for c in columns:
        how = table.get(c)
        if how == "sum":
            out.append(F.sum(c).alias(c))
        elif how is not None and how in columns:
            out.append(F.nullif(F.try_divide(F.sum(F.col(c) * F.col(how)), F.sum(how)), F.lit(0.0)).alias(c))
    return out


def rolled_up(metrics: DataFrame, key: Sequence[str], table: dict[str, str] | None = None) -> DataFrame:
    """``metrics`` of parts grouped by ``key``: all columns of the table in one aggregation."""
    return metrics.groupBy(*key).agg(*_compiled(metrics.columns, table or ROLL_UP))


def rolled_up_to_parents(metrics: DataFrame, closed: DataFrame, by: Sequence[str] = (), label: str = "label", table: dict[str, str] | None = None) -> DataFrame:
    """Every ancestor's metrics from those of its regions, one join with the closure: (by, id, ...)."""
    joined = closed.select(F.col("ancestor").alias("id"), "descendant").join(metrics, F.col("descendant") == F.abs(label))
    return joined.groupBy(*by, "id").agg(*_compiled([c for c in metrics.columns if c not in by], table or ROLL_UP))


def variation(v: DataFrame, value: str, heat: str | None = None, interior: DataFrame | None = None, by: Sequence[str] = ("label",)) -> DataFrame:
    """Variation of intensities (and nuclei a voxel) within each group of ``by``, as a label and its segment.

    ``interior``: places that the label keeps when eroded; with it the deviations
    inside and outside of them, their difference and its size. Label 0 is left out.
    """
    d = v.filter(F.col(by[0]) != 0)
    inside = F.lit(None).cast("boolean")
    if interior is not None:
        d = d.join(interior.select(*CELL, F.lit(True).alias("_in")).distinct(), CELL, "left")
        inside = F.coalesce("_in", F.lit(False))
    spread = lambda c, on=None: F.stddev_pop(F.col(c) if on is None else F.when(on, F.col(c)))

    def within(c: str, name: str, diff: bool) -> list[Column]:
        if interior is None:
            return []
        inner, outer = spread(c, inside), spread(c, ~inside)
        out = [inner.alias(f"var_{name}_in"), outer.alias(f"var_{name}_out"), F.abs(outer - inner).alias(f"var_{name}_match")]
        return [*out, (outer - inner).alias(f"var_{name}_diff")] if diff else out

    sums = [F.count("*").alias("volume"), spread(value).alias("var_intensity"), F.avg(value).alias("mean_intensity"), F.try_divide(spread(value), F.avg(value)).alias("coef_var_intensity"), *within(value, "intensity", True)]
    if heat:
        sums += [F.sum(heat).alias("nuclei"), spread(heat).alias("var_nuclei"), F.avg(heat).alias("mean_nuclei"), F.try_divide(spread(heat), F.avg(heat)).alias("coef_var_nuclei"), *within(heat, "nuclei", False)]
    ends = quantiles(d, list(by), value, {"median_intensity": 0.5, "low_intensity": 0.05, "high_intensity": 0.95})
    return d.groupBy(*by).agg(*sums).join(ends, list(by), "left")


def region_variation(v: DataFrame, value: str, segment: str, heat: str | None = None, interior: DataFrame | None = None, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """A label's variation as the weighted mean over its segments, so that edges between segments don't count as variation."""
    return rolled_up(variation(v, value, heat, interior, (label, segment, *by)), [*by, label])


OVERLAP = {"volume": "sum", "volume_alt": "sum", "volume_out": "sum", "nuclei": "sum", "nuclei_out": "sum", "volume_dsc": "volume", "nuclei_dsc": "nuclei"}


def label_overlaps(v: DataFrame, a: str, b: str, heat: str | None = None) -> DataFrame:
    """Per label of ``a``: its volume there and in ``b``, their Dice coefficient, and the volume of ``b`` outside; the same for nuclei with ``heat``.

    One aggregation: each voxel counts once for its label in ``a``, once for that in ``b``.
    """
    n = F.col(heat) if heat else F.lit(None).cast("double")
    one = v.filter(F.col(a) != 0).select(F.col(a).alias("label"), F.lit(1).alias("first"), F.lit(0).alias("second"), (F.col(a) == F.col(b)).cast("int").alias("both"), n.alias("n"))
    two = v.filter(F.col(b) != 0).select(F.col(b).alias("label"), F.lit(0).alias("first"), F.lit(1).alias("second"), F.lit(0).alias("both"), n.alias("n"))
    s = one.unionByName(two).groupBy("label").agg(*[F.sum(c).alias(f"v_{c}") for c in ("first", "second", "both")], *[F.sum(F.col(c) * F.col("n")).alias(f"n_{c}") for c in ("first", "second", "both")])
    s = s.filter("v_first > 0")
    dice = lambda k: F.try_divide(2.0 * F.col(f"{k}_both"), F.col(f"{k}_first") + F.col(f"{k}_second"))
    out = [F.col("v_first").alias("volume"), F.col("v_second").alias("volume_alt"), dice("v").alias("volume_dsc"), (F.col("v_second") - F.coalesce("v_both", F.lit(0))).alias("volume_out")]
    if heat:
        out += [F.col("n_first").alias("nuclei"), dice("n").alias("nuclei_dsc"), (F.coalesce("n_second", F.lit(0)) - F.coalesce("n_both", F.lit(0))).alias("nuclei_out")]
    return s.select("label", *out)


def overlaps_of_parents(overlaps: DataFrame, closed: DataFrame) -> DataFrame:
    """``label_overlaps`` of every ancestor: sums, and Dice coefficients weighted by volume and by nuclei where there are any."""
    joined = closed.select(F.col("ancestor").alias("id"), "descendant").join(overlaps, F.col("descendant") == F.abs("label"))
    have = [c for c in OVERLAP if c in overlaps.columns]
    mean = lambda c, w: F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(F.when(F.col(c).isNotNull(), F.col(w))))
    return joined.groupBy("id").agg(*[(F.sum(c) if OVERLAP[c] == "sum" else mean(c, OVERLAP[c])).alias(c) for c in have])


def compared_atlases(one: DataFrame, two: DataFrame, closed: DataFrame, heat: DataFrame | None = None, crop: tuple[str, int, int] | None = None, mask: DataFrame | None = None, pairs: tuple[DataFrame | None, DataFrame | None] = (None, None), children: bool = True, parents: bool = False) -> DataFrame:
    """Two labelled volumes cropped, masked, translated and compared label by label (see ``label_overlaps``).

    ``crop``: an axis and the half-open range that stays; ``mask``: places that
    stay; ``pairs``: for either volume (from_label, to_label), applied to children
    too unless told otherwise, labels without a pair become 0. ``parents``: rows for every ancestor.
    """
    images = []
    for v, table, name in ((one, pairs[0], "one"), (two, pairs[1], "two")):
        v = v.select(*CELL, F.col("label").cast("long").alias("label"))
        if crop:
            v = v.filter(F.col(crop[0]).between(crop[1], crop[2] - 1))
        if mask is not None:
            v = v.join(mask.select(*CELL).distinct(), CELL, "left_semi")
        if table is not None:
            v = translate(v, table, closed, children, clear=True)
        images.append(v.select(*CELL, F.col("label").cast("long").alias(name)))
    both = images[0].join(images[1], CELL, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("one", "two")})
    if heat is not None:
        both = both.join(heat.select(*CELL, F.col("n").alias("heat")), CELL, "left").withColumn("heat", F.coalesce("heat", F.lit(0)))
    found = label_overlaps(both, "one", "two", "heat" if heat is not None else None)
    return overlaps_of_parents(cut(found), closed) if parents else found


def development(df: DataFrame, ages: DataFrame, regions: DataFrame, metric: str, whole: int, outside: Sequence[int], closed: DataFrame) -> DataFrame:
    """A metric per age, condition and region with that of the brain tissue: (age, condition, region, name, level, value, base, fraction).

    ``df(sample, condition, region, metric)``; ``ages(sample, age)``; ``regions(id, name, level)``.
    The base of an age and condition is the whole region's value less those
    of the large regions ``outside``; regions below these have no fraction.
    """
    d = df.join(ages, "sample").groupBy("age", "condition", "region").agg(F.sum(metric).alias("value"))
    d = cut(d)
    less = F.sum(F.when(F.col("region") == whole, F.col("value"))) - F.coalesce(F.sum(F.when(F.col("region").isin(*outside), F.col("value"))), F.lit(0.0)) if outside else F.sum(F.when(F.col("region") == whole, F.col("value")))
    base = d.filter(F.col("region").isin(whole, *outside)).groupBy("age", "condition").agg(less.alias("base"))
    away = closed.filter(F.col("ancestor").isin(*outside)).select(F.col("descendant").alias("region"), F.lit(True).alias("_away")).distinct()
    out = d.join(base, ["age", "condition"], "left").join(away, "region", "left").join(regions.select(F.col("id").alias("region"), "name", "level"), "region", "left")
    return out.select("age", "condition", "region", "name", "level", "value", "base", F.when(F.col("_away").isNull(), F.try_divide("value", "base")).alias("fraction"))


def side_by_side(tables: dict[str, DataFrame], key: str, volume: str, tag: str = "_mean") -> DataFrame:
    """Means of several statistics tables in one, as ``label_condition`` from ``condition_mean`` columns, and each over the volume of the first: ``label_density_condition``."""
    first = next(iter(tables.values()))
    out = first.select(key, volume)
    for label, df in tables.items():
        means = [c for c in df.columns if c.lower().endswith(tag)]
        part = df.select(key, *[F.col(c).alias(f"{label}_{c[: -len(tag)]}") for c in means])
        out = out.join(part, key, "left")
        out = out.withColumns({f"{label}_density_{c[: -len(tag)]}": F.try_divide(F.col(f"{label}_{c[: -len(tag)]}"), F.col(volume)) for c in means})
    return out
