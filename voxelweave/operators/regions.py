"""Region metrics from labelled voxels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles
from .volumes import nearest_voxel

CELL = ["z", "y", "x"]


def region_counts(v: DataFrame, group: list[str], value: str = "atlas") -> DataFrame:
    """Volume, summed and described intensity of each region; quantiles from sorted counts."""
    sums = v.groupBy(*group).agg(F.count("*").alias("volume"), F.sum(value).alias("intensity"), F.stddev_pop(value).alias("std"), F.avg(value).alias("mean"))
    return sums.join(quantiles(v, group, value, {"median": 0.5, "low": 0.05, "high": 0.95}), group, "left")


def entropy(v: DataFrame, group: list[str], value: str) -> DataFrame:
    """Shannon entropy, base 2, over the distinct values of each group."""
    n = v.groupBy(*group, value).agg(F.count("*").alias("_n"))
    total = F.sum("_n")
    return n.groupBy(*group).agg((F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total).alias("entropy"))


def physical(df: DataFrame, spacing: tuple[float, ...], unit: float = 1000.0) -> DataFrame:
    """``volume`` in units and the density of ``nuclei``."""
    factor = 1.0
    for s in spacing:
        factor *= s / unit
    return df.withColumn("volume_phys", F.col("volume") * factor).withColumn("density", F.try_divide(F.col("nuclei"), F.col("volume") * factor))


def with_total(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds the row "all" of each group: sums, and means weighted by volume."""
    total = df.groupBy(*by).agg(F.sum("volume").alias("volume"), F.sum("intensity").alias("intensity"), F.try_divide(F.sum(F.col("mean") * F.col("volume")), F.sum("volume")).alias("mean"))
    return df.select(*by, F.col("label").cast("string").alias("label"), "volume", "intensity", "mean").unionByName(total.withColumn("label", F.lit("all")))


def overlap(v: DataFrame, a: str, b: str) -> DataFrame:
    """Per label id: sizes in both labelings, intersection and Dice coefficient."""
    one = v.filter(F.col(a) != 0).select(F.col(a).alias("label"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"), (F.col(a) == F.col(b)).cast("int").alias("both"))
    two = v.filter(F.col(b) != 0).select(F.col(b).alias("label"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"), F.lit(0).alias("both"))
    s = one.unionByName(two).groupBy("label").agg(F.sum("in_a").alias("volume"), F.sum("in_b").alias("volume_alt"), F.sum("both").alias("shared"))
    return s.withColumn("dsc", F.try_divide(2 * F.col("shared"), F.col("volume") + F.col("volume_alt"))).withColumn("out", F.col("volume_alt") - F.col("shared"))


def dice(mask_a: Column, mask_b: Column, weight: Column | None = None) -> Column:
    """Aggregate 2I / (A + B) of two masks; null if both are empty."""
    w = F.lit(1.0) if weight is None else weight
    s = lambda m: F.sum(F.when(m, w).otherwise(0.0))
    return F.try_divide(2 * s(mask_a & mask_b), s(mask_a) + s(mask_b))


def boxes(v: DataFrame, label: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Bounding box, centroid and extent of each label."""
    aggs = [f(c).alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mid"))]
    out = v.filter(F.col(label) != 0).groupBy(label).agg(*aggs, F.count("*").alias("volume"))
    return out.withColumns({f"{c}_extent": (F.col(f"{c}_max") - F.col(f"{c}_min") + 1) * s for c, s in zip(CELL, spacing, strict=True)})


def centroid_distance(v: DataFrame, a: str, b: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Distance of the centroids of each label in two labelings; null where one lacks it."""
    mid = lambda c, n: v.filter(F.col(c) != 0).groupBy(F.col(c).cast("long").alias("label")).agg(*[F.avg(k).alias(f"{k}_{n}") for k in CELL])
    d = sum((((F.col(f"{k}_a") - F.col(f"{k}_b")) * s) ** 2 for k, s in zip(CELL, spacing, strict=True)), F.lit(0.0))
    return mid(a, "a").join(mid(b, "b"), "label", "full_outer").select("label", F.sqrt(d).alias("distance"))


def labels_lost(v: DataFrame, a: str, b: str) -> DataFrame:
    """Labels of the first labeling that the second has nowhere, with their sizes."""
    new = v.select(F.col(b).alias("label")).distinct()
    return v.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("volume")).join(new, "label", "left_anti")


def heat_map(points: DataFrame, scale: tuple[float, float, float], shape: tuple[int, int, int], by: list[str] | None = None) -> DataFrame:
    """Points per scaled voxel: rounded half-even, clipped at the far side."""
    to = [F.least(F.bround(F.col(c) * s).cast("int"), F.lit(n - 1)).alias(c) for c, s, n in zip(CELL, scale, shape, strict=True)]
    return points.select(*(by or []), *to).groupBy(*(by or []), *CELL).agg(F.count("*").alias("n"))


def region_change(df: DataFrame, metric: str, conditions: tuple[str, str]) -> DataFrame:
    """Mean of the second condition less that of the first, per region."""
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col(metric)))
    return df.groupBy("region").agg((mean(conditions[1]) - mean(conditions[0])).alias("change"))


def projection(v: DataFrame, axes: tuple[str, str], value: str) -> DataFrame:
    """Maximum along the axis that is left."""
    return v.groupBy(*axes).agg(F.max(value).alias(value))


def shrink(v: DataFrame, factor: int, value: str, label: str) -> DataFrame:
    """Mean intensity and most frequent label (the smaller of equals) of blocks."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in CELL]
    n = v.select(*block, value, label).groupBy(*CELL, label).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    return n.groupBy(*CELL).agg((F.sum("_s") / F.sum("_n")).alias(value), F.max(F.struct("_n", (-F.col(label)).alias("_l"))).alias("_top")).select(*CELL, value, (-F.col("_top._l")).alias(label))


def region_middle(v: DataFrame, label: str) -> DataFrame:
    """Axis by axis the middle of a label's sorted coordinates, restricted to it for the next axis."""
    cells = v.select(label, *CELL)
    for i, c in enumerate(CELL):
        keys = [label]
        count = cells.groupBy(*keys, c).agg(F.count("*").alias("n"))
        flat = count.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c, "n"))).alias("h"), F.sum("n").alias("total"))
        # the first coordinate whose running count passes the middle; a histogram has few distinct coordinates
        mid = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] > F.floor(F.col("total") / 2), x[c])).alias("at")), lambda a: a["at"])
        cells = cells.join(flat.select(label, mid.alias("_at")), label).filter(F.col(c) == F.col("_at")).drop("_at")
    return cells.select(label, *CELL).distinct()


def verification(df: DataFrame, by: list[str], radius: float = 0.001) -> DataFrame:
    """Positives, true and false positives and negatives from flags, with sensitivity and precision."""
    n = lambda on: F.count(F.when(on, 1))
    pos, tp = n(F.col("truth") >= 0), n((F.col("truth") == -1) & (F.col("confirmed") == 1))
    fp, fn = n((F.col("truth") == -1) & (F.col("confirmed") == 0)), n(F.col("truth") == 0)
    out = df.groupBy(*by).agg(pos.alias("pos"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("sensitivity", F.try_divide("tp", "pos")).withColumn("ppv", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))


def unlabeled_planes(v: DataFrame, label: str, axis: str, extent: tuple[int, int], by: list[str]) -> DataFrame:
    """1 - planes of the axis with any label / planes within the extent that have voxels at all, per group."""
    planes = v.filter(F.col(axis).between(extent[0], extent[1] - 1)).groupBy(*by, axis).agg(F.max((F.col(label) != 0).cast("int")).alias("_on"))
    return planes.groupBy(*by).agg((1 - F.try_divide(F.sum("_on"), F.count("*"))).alias("unlabeled"))


def edge_total(df: DataFrame, by: list[str]) -> DataFrame:
    """The row "all" of edge distances: the mean weighted by edge size, and their sum as the sum of each sum times its edge size."""
    size = F.col("edge_size")
    total = df.groupBy(*by).agg(F.sum("edge_size").alias("edge_size"), F.sum(F.col("edge_dist_sum") * size).alias("edge_dist_sum"), F.try_divide(F.sum(F.col("edge_dist_mean") * size), F.sum(size)).alias("edge_dist_mean"))
    return total.withColumn("label", F.lit("all"))


def unlabeled_share(v: DataFrame, label: str, extent: tuple[int, int]) -> DataFrame:
    """1 - (labelled foreground before the first extent + all foreground between the two) / foreground."""
    fore = F.col("atlas") > 0
    before = F.sum((fore & (F.col("x") < extent[0]) & (F.col(label) != 0)).cast("int"))
    between = F.sum((fore & (F.col("x") >= extent[0]) & (F.col("x") < extent[1])).cast("int"))
    return v.groupBy("sample").agg((1 - F.try_divide(before + between, F.sum(fore.cast("int")))).alias("unlabeled"))


def intensity_bounds(v: DataFrame, by: str, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return quantiles(v, [by], value, {"near_min": low, "near_max": high})


def merged_bounds(planes: DataFrame, by: str) -> DataFrame:
    """Per-plane bounds as those of the whole volume."""
    return planes.groupBy(by).agg(F.min("near_min").alias("near_min"), F.max("near_max").alias("near_max"))


def unmixed(v: DataFrame, parts: dict[int, dict[int, float]], channels: list[int]) -> DataFrame:
    """Per voxel: each channel less the given shares of others, at least 0."""
    wide = v.groupBy("sample", *CELL).pivot("channel", channels).agg(F.avg("atlas"))
    cols = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in channels}
    return wide.select("sample", *CELL, *[F.greatest(cols[c] - sum((cols[o] * f for o, f in parts.get(c, {}).items()), F.lit(0.0)), F.lit(0.0)).alias(f"channel_{c}") for c in channels])


def point_labels(points: DataFrame, v: DataFrame, scale: tuple[float, float, float], label: str = "label") -> DataFrame:
    """Each point with the label at its truncated scaled place; null beyond the volume."""
    at = points.select("*", *[(F.col(c) * f).cast("int").alias(f"{c}_index") for c, f in zip(CELL, scale, strict=True)])
    cells = v.select(*[F.col(c).alias(f"{c}_index") for c in CELL], F.col(label).alias("label"))
    return at.join(cells, [f"{c}_index" for c in CELL], "left").select(*points.columns, "label")


def edge_distances(edges: DataFrame, distances: DataFrame, label: str = "label") -> DataFrame:
    """Sum, mean and number of the distances on each label's edge voxels."""
    return edges.join(distances, CELL).groupBy(label).agg(F.sum("dist").alias("edge_dist_sum"), F.avg("dist").alias("edge_dist_mean"), F.count("*").alias("edge_size"))


def inside_outside(v: DataFrame, interior: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Deviation of all voxels, of the interior and of the border of each label, their difference, and the coefficient of variation."""
    d = v.filter(F.col(label) != 0).join(interior.select(*CELL, F.lit(True).alias("_in")), CELL, "left")
    inner, outer = F.stddev_pop(F.when(F.col("_in"), F.col(value))), F.stddev_pop(F.when(F.col("_in").isNull(), F.col(value)))
    return d.groupBy(label).agg(F.stddev_pop(value).alias("var"), inner.alias("var_in"), outer.alias("var_out"), (outer - inner).alias("var_diff"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("coef_var"))


def region_metrics(v: DataFrame, points: DataFrame, distances: DataFrame, group: list[str], value: str = "atlas", label: str = "label") -> DataFrame:
    """One row per region: counts, intensity, points, density and edge distances; a region without points or edges has 0 and null.

    ``v`` has ``group`` and voxels, ``points`` has ``group`` and a row a point, ``distances`` has ``group`` and ``dist``.
    """
    n = points.groupBy(*group).agg(F.count("*").alias("nuclei"))
    e = distances.groupBy(*group).agg(F.sum("dist").alias("edge_dist_sum"), F.avg("dist").alias("edge_dist_mean"), F.count("*").alias("edge_size"))
    out = region_counts(v, group, value).join(n, group, "left").join(e, group, "left")
    nuclei = F.coalesce("nuclei", F.lit(0))
    return out.withColumn("nuclei", nuclei).withColumn("density", F.try_divide(nuclei, F.col("volume")))


def combined_sides(df: DataFrame, by: list[str]) -> DataFrame:
    """Volumes and nuclei of both sides of a region together, the density anew."""
    out = df.withColumn("region", F.abs("region")).groupBy(*by).agg(F.sum("volume").alias("volume"), F.sum("nuclei").alias("nuclei"))
    return out.withColumn("density", F.try_divide("nuclei", "volume"))


def thresholded_overlap(v: DataFrame, a: str, b: str, low_a: float | None = None, low_b: float | None = None) -> DataFrame:
    """Dice coefficient and sizes of the two foregrounds; a threshold defaults to the mean."""
    means = v.agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    d = v.crossJoin(F.broadcast(means))  # one row
    one = F.col(a) > (F.col("_a") if low_a is None else low_a)
    two = F.col(b) > (F.col("_b") if low_b is None else low_b)
    n = lambda m: F.count(F.when(m, 1))
    return d.agg(dice(one, two).alias("dsc"), n(one).alias("size_a"), n(two).alias("size_b"))


def mean_label_overlap(v: DataFrame, a: str, b: str) -> DataFrame:
    """One Dice coefficient over all labels: twice the voxels of equal label over those labelled in either."""
    return v.agg(F.try_divide(2 * F.sum(((F.col(a) == F.col(b)) & (F.col(a) != 0)).cast("int")), F.sum((F.col(a) != 0).cast("int")) + F.sum((F.col(b) != 0).cast("int"))).alias("dsc"))


def value_map(v: DataFrame, df: DataFrame, value: str, condition: str | None = None, fn: Callable[[str], Column] = F.avg, label: str = "label") -> DataFrame:
    """Voxels with their region's averaged value, or with the second condition's less the first's (in order); by the label without its sign."""
    if condition is None:
        by = df.groupBy("region").agg(fn(value).alias("value"))
    else:
        ends = df.agg(F.min(condition).alias("_lo"), F.max(condition).alias("_hi"))
        each = df.groupBy("region", condition).agg(fn(value).alias("_v")).crossJoin(F.broadcast(ends))  # one row
        of = lambda end: F.max(F.when(F.col(condition) == F.col(end), F.col("_v")))
        by = each.groupBy("region").agg((of("_hi") - of("_lo")).alias("value"))
    return v.join(by, F.abs(label) == F.col("region"), "left").select(*v.columns, "value")


def pair_heat_maps(points: DataFrame, scale: tuple[float, float, float], shape: tuple[int, int, int], flags: list[str]) -> DataFrame:
    """Points per scaled voxel for each pair of channels whose flags both are 1."""
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    on = F.filter(F.array(*[F.when((F.col(a) == 1) & (F.col(b) == 1), F.lit(f"{a}-{b}")) for a, b in pairs]), lambda x: x.isNotNull())
    return heat_map(points.select(*CELL, F.explode(on).alias("pair")), scale, shape, ["pair"])


def combination_heat_maps(points: DataFrame, scale: tuple[float, float, float], shape: tuple[int, int, int], flags: list[str], chosen: Sequence[str] = ()) -> DataFrame:
    """Points per scaled voxel for each combination of two or more channels that holds all ``chosen`` ones, where all its flags are 1.

    A point's raised flags are expanded into their subsets, so all combinations are
    counted in one pass; the number of combinations grows with the flags alone.
    """
    sets = [c for n in range(2, len(flags) + 1) for c in combinations(flags, n) if set(chosen) <= set(c)]
    if not sets:
        return heat_map(points.limit(0).select(*CELL, F.lit("").alias("channels")), scale, shape, ["channels"])
    all_on = lambda c: reduce(lambda a, b: a & b, [F.col(f) == 1 for f in c])
    on = F.filter(F.array(*[F.when(all_on(c), F.lit("-".join(c))) for c in sets]), lambda x: x.isNotNull())
    return heat_map(points.select(*CELL, F.explode(on).alias("channels")), scale, shape, ["channels"])


def merged_values(images: Sequence[DataFrame], value: str, fn: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Images of one size as one: ``fn`` of the values at each place."""
    both = reduce(lambda a, b: a.unionByName(b), [v.select(*CELL, value) for v in images])
    return both.groupBy(*CELL).agg(fn(F.col(value)).alias(value))


def detection_accuracy(df: DataFrame, by: list[str], verified: bool = False, maybes: str = "ignore", radius: float = 0.001) -> DataFrame:
    """Positives, true and false positives, misses, sensitivity and precision per group.

    ``verified``: truths are positives, confirmed others true. Otherwise confirmed
    points are positives, and true if they were detected: hand-made ones have
    a radius under ``radius``. Points that are maybes (confirmed 2) count by
    ``maybes`` then: ``ignore``; ``correct``: detected ones are positive and true;
    ``incorrect``: detected ones are false and the others positive.
    """
    if maybes not in ("ignore", "correct", "incorrect"):
        raise ValueError("maybes is ignore, correct or incorrect")
    n = lambda on: F.count(F.when(on, 1))
    sure, found, maybe = F.col("confirmed") == 1, F.col("radius") >= radius, F.col("confirmed") == 2
    pos, tp, fp = (n(F.col("truth") >= 0), n((F.col("truth") == -1) & sure), n(F.col("confirmed") == 0)) if verified else (n(sure), n(sure & found), n(F.col("confirmed") == 0))
    if not verified and maybes == "correct":
        pos, tp = pos + n(maybe & found), tp + n(maybe & found)
    elif not verified and maybes == "incorrect":
        pos, fp = pos + n(maybe & ~found), fp + n(maybe & found)
    out = df.groupBy(*by).agg(pos.alias("pos"), tp.alias("tp"), fp.alias("fp"))
    return out.select(*by, "pos", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), F.try_divide("tp", "pos").alias("sensitivity"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"))


def scaled_boxes(boxes_of: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    """Boxes and centroids over the scaling, rounded half-even."""
    return boxes_of.withColumns({f"{c}_{n}": F.bround(F.col(f"{c}_{n}") / f).cast("int") for c, f in zip(CELL, scale, strict=True) for n in ("min", "max", "mid")})


def radial_distance(borders: DataFrame, centre: DataFrame) -> DataFrame:
    """Distance of each border voxel to the truncated centre (one row of z, y, x)."""
    mid = centre.select(*[F.col(c).cast("int").alias(f"_{c}") for c in CELL])
    return borders.crossJoin(F.broadcast(mid)).select(*CELL, F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in CELL), F.lit(0.0))).alias("radial"))  # one row


def radial_difference(original: DataFrame, shifted: DataFrame) -> DataFrame:
    """``(z, y, x, radial)`` of two border sets -> shifted places with radial less that of the nearest original place (ties by place; less 0 where radial is 0)."""
    near = nearest_voxel(shifted, original.select(*CELL, F.col("radial").alias("_orig")), carry=["_orig"])
    away = F.col("radial") - F.when(F.col("radial") <= 0, 0.0).otherwise(F.col("_orig"))
    return shifted.join(near.drop("dist"), list(CELL), "left").select(*CELL, "radial", away.alias("difference"))


def saturated(v: DataFrame, by: list[str], value: str, near_max: DataFrame | None = None, factor: float = 0.5, low: float = 0.05, high: float = 0.995) -> DataFrame:
    """Values clipped at two quantiles of their group (a tile's channel) and stretched to 0 .. 1; a flat group stays as it is.

    The upper end is at least ``factor`` times the channel's ``near_max``, a
    table of some of ``by`` and that column, so that dim tiles are not
    stretched to the full range.
    """
    ends = quantiles(v, by, value, {"_lo": low, "_hi": high})
    flat = F.col("_hi") == F.col("_lo")
    if near_max is not None:
        ends = ends.join(near_max, [c for c in by if c in near_max.columns], "left")
        ends = ends.withColumn("_hi", F.when(flat, F.col("_hi")).otherwise(F.greatest("_hi", F.col("near_max") * factor))).drop("near_max")
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return v.join(ends, by).withColumn(value, F.when(flat, F.col(value)).otherwise((clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).select(*v.columns)


def otsu(v: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The threshold of greatest variance between the classes below and above it, from a histogram of ``bins`` bins."""
    ends = v.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    h = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row; at most ``bins`` rows
    before, every = Window.orderBy("bin"), Window.partitionBy()
    mid = F.col("n") * (F.col("bin") + 0.5)
    c = h.select("bin", F.sum("n").over(before).alias("w0"), F.sum(mid).over(before).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(mid).over(every).alias("s")).filter("w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    best = c.agg(F.max_by("bin", F.col("w0") * (F.col("w") - F.col("w0")) * gap**2).alias("bin"))
    return ends.crossJoin(best).select((F.col("lo") + (F.col("bin") + 0.5) / bins * (F.col("hi") - F.col("lo"))).alias("threshold"))
