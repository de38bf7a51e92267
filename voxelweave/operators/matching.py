"""Points in boxes, one-to-one matches, co-localization, and the tables that hold experiments, boxes and matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import shuffled
from .points import AXES, near_pairs, squared
from .ranks import running


def match_tolerances(tolerance: Sequence[float]) -> tuple[float, tuple[float, ...], tuple[int, ...]]:
    """Threshold, scaling of each axis to it, and the inner padding (axes reversed, rounded down)."""
    top = max(tolerance)
    return top, tuple(top / t for t in tolerance), tuple(int(t) for t in reversed(tolerance))


def in_rois(points: DataFrame, rois: DataFrame, margin: Sequence[float] = (0, 0, 0), cell: int = 32) -> DataFrame:
    """Points with every box (roi_id, z0, y0, x0, nz, ny, nx) that holds them, half-open, shrunk by ``margin`` on each side.

    An equi-join on grid cells: a box is copied to each cell that it touches.
    """
    return _in_boxes(points, rois, margin, cell).select("roi_id", *points.columns)


def _in_boxes(points: DataFrame, rois: DataFrame, margin: Sequence[float] = (0, 0, 0), cell: int = 32) -> DataFrame:
    """``in_rois`` with the box's columns."""
    boxes, at = rois, points
    for c in AXES:
        last = F.floor((F.col(f"{c}0") + F.col(f"n{c}") - 1) / cell)
        boxes = boxes.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.greatest(last, F.floor(F.col(f"{c}0") / cell)))))
        at = at.withColumn(f"_{c}", F.floor(F.col(c) / cell))
    out = at.join(shuffled(boxes), [f"_{c}" for c in AXES])
    for c, m in zip(AXES, margin, strict=True):
        out = out.filter((F.col(c) >= F.col(f"{c}0") + m) & (F.col(c) < F.col(f"{c}0") + F.col(f"n{c}") - m))
    return out


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least total cost of one-to-one pairs, by shortest augmenting paths; rows are not more than columns."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        low, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            free = ~used[1:]
            now = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = free & (now < low[1:])
            low[1:][better], back[1:][better] = now[better], at
            following = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            step = low[following]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            at = following
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[back[at]], back[at]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def _least(one: np.ndarray, two: np.ndarray, top: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``one`` and of ``two`` that the assignment of their scaled places pairs under ``top``, with their distances."""
    if max(len(one), len(two)) > most:
        raise ValueError(f"a group of {max(len(one), len(two))} points; at most {most}")
    if not len(one) or not len(two):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    gap = np.sqrt(((one[:, None] - two[None]) ** 2).sum(axis=2))
    pairs = assignment(gap) if len(one) <= len(two) else [(i, j) for j, i in assignment(gap.T)]
    i, j = np.array([(i, j) for i, j in pairs if gap[i, j] < top], int).reshape(-1, 2).T
    return i, j, gap[i, j]


def _match_groups(rows: DataFrame, group: str, pairs: Sequence[tuple[int, int]], tolerance: Sequence[float], key: str, most: int = 2000) -> DataFrame:
    """``rows(group, _side, _in, key, z, y, x)`` -> (group, pair, a, b, dist): sides of each of ``pairs`` (a, b) matched within a group.

    First the inner a with all b, then the outer a with the inner b that are left. A group is one row with its points
    as an array, so all of its pairs and both steps are one pass, and a task takes many groups a batch.
    """
    top, scale, _ = match_tolerances(tolerance)
    point = F.struct(F.col(key).cast("long").alias("k"), F.col("_side").cast("int").alias("s"), F.col("_in").alias("i"), *[F.col(c).cast("double").alias(c) for c in AXES])
    held = rows.groupBy(F.col(group).cast("long").alias(group)).agg(F.collect_list(point).alias("_p"))

    def run(batches):
        for batch in batches:
            lists, names = batch.column("_p"), batch.column(group).to_numpy()
            ends, flat = lists.offsets.to_numpy(), lists.values
            ids, side, inner = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("k", "s", "i"))
            place = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in AXES], axis=1) * scale
            out: list[tuple] = []
            for g, start, end in zip(names, ends[:-1], ends[1:], strict=True):
                own = start + np.argsort(ids[start:end], kind="stable")
                for n, (s_a, s_b) in enumerate(pairs):
                    a, b = own[side[own] == s_a], own[side[own] == s_b]
                    near, rest = a[inner[a]], a[~inner[a]]
                    i, j, gap = _least(place[near], place[b], top, most)
                    left = np.delete(b, j)
                    left = left[inner[left]]
                    k, m, more = _least(place[rest], place[left], top, most)
                    one, two = ids[np.concatenate([near[i], rest[k]])], ids[np.concatenate([b[j], left[m]])]
                    out.append((np.full(len(one), g), np.full(len(one), n, np.int32), one, two, np.concatenate([gap, more])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], [group, "pair", "a", "b", "dist"])

    return held.mapInArrow(run, f"{group} long, pair int, a long, b long, dist double")


def optimal_matches(a: DataFrame, b: DataFrame, group: str, tolerance: Sequence[float], key: str = "blob_id", most: int = 2000) -> DataFrame:
    """One-to-one matches of least total distance within each ``group``; then those under the tolerance (strictly): (group, a, b, dist).

    Distances are Euclidean on coordinates scaled to the largest tolerance. A
    group is one box or tile; one of over ``most`` points on a side is an
    error, as the assignment takes cubic time: cut it into tiles.
    """
    side = lambda d, n: d.select(group, F.lit(n).alias("_side"), F.lit(n == 0).alias("_in"), key, *AXES)
    return _match_groups(side(a, 0).unionByName(side(b, 1)), group, [(0, 1)], tolerance, key, most).drop("pair")


def _sided(points: DataFrame, side: Column, rois: DataFrame, tolerance: Sequence[float]) -> DataFrame:
    """Points in boxes with their side and whether they are in the box's inside (see ``roi_matches``)."""
    inner = F.lit(True)
    for c, t in zip(AXES, tolerance, strict=True):
        pad = F.least(F.lit(int(t)), F.ceil(F.col(f"n{c}") / 2 - 1))
        inner = inner & (F.col(c) >= F.col(f"{c}0") + pad) & (F.col(c) < F.col(f"{c}0") + F.col(f"n{c}") - pad)
    boxes = rois.select("roi_id", *[f"{c}0" for c in AXES], *[f"n{c}" for c in AXES])
    return _in_boxes(points.select("blob_id", *AXES, side.cast("int").alias("_side")), boxes).select("roi_id", "_side", inner.alias("_in"), "blob_id", *AXES)


def roi_matches(test: DataFrame, base: DataFrame, rois: DataFrame, tolerance: Sequence[float]) -> DataFrame:
    """Per box: points of ``test`` in its inside matched with all of ``base`` there, then base points of the inside that
    were missed with the other test points: (roi_id, a, b, dist), b of ``base``.

    The inside leaves out the tolerance on each side, but no more than keeps the box's middle.
    """
    rows = _sided(test, F.lit(0), rois, tolerance).unionByName(_sided(base, F.lit(1), rois, tolerance))
    return _match_groups(rows, "roi_id", [(0, 1)], tolerance, "blob_id").drop("pair")


def channel_matches(points: DataFrame, rois: DataFrame, tolerance: Sequence[float], channels: Sequence[int]) -> DataFrame:
    """Co-localization by matches: (roi_id, channel_a, channel_b, a, b, dist) for each pair of channels, the lower first.

    The higher channel's points are matched with the lower one's in each box as by ``roi_matches``, all pairs in one pass.
    """
    pairs = [(high, low) for i, low in enumerate(sorted(channels)) for high in sorted(channels)[i + 1 :]]  # a few channels
    found = _match_groups(_sided(points.filter(F.col("channel").isin(*channels)), F.col("channel"), rois, tolerance), "roi_id", pairs, tolerance, "blob_id")
    of = lambda n: F.element_at(F.array(*[F.lit(p[n]) for p in pairs]), F.col("pair") + 1)
    return found.select("roi_id", of(1).alias("channel_a"), of(0).alias("channel_b"), F.col("b").alias("a"), F.col("a").alias("b"), "dist")


def match_table(matches: DataFrame, points: DataFrame) -> DataFrame:
    """Matches for storing: match_id (by box and points), roi_id, blob1, blob2, dist, with both points' flags reset to -1."""
    end = lambda n, e: points.select(F.col("blob_id").alias(e), F.struct(*[F.lit(-1).alias(c) if c in ("confirmed", "truth") else F.col(c) for c in points.columns]).alias(n))
    keyed = matches.withColumn("match_id", F.xxhash64("roi_id", "a", "b"))
    return keyed.join(end("blob1", "a"), "a").join(end("blob2", "b"), "b").select("match_id", "roi_id", "blob1", "blob2", "dist")


def colocalized(points: DataFrame, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """(a, b, channel_a, channel_b, dist): points of two channels within the tolerance (strictly), lower channel first.

    For each pair of channels every a keeps its nearest b, and then every b its nearest a; ties by id.
    """
    cols = ["blob_id", "channel", *keys, *AXES]
    pairs = near_pairs(points.select(*cols), points.select(*cols), (tolerance,) * 3, keys).filter("channel_a < channel_b").withColumn("dist", F.sqrt(squared())).filter(F.col("dist") < tolerance)
    one = pairs.groupBy(F.col("blob_id_a").alias("a"), "channel_a", "channel_b").agg(F.min(F.struct("dist", F.col("blob_id_b").alias("b"))).alias("_m")).select("a", "_m.b", "channel_a", "channel_b", "_m.dist")
    two = one.groupBy("b", "channel_a", "channel_b").agg(F.min(F.struct("dist", "a")).alias("_m"))
    return two.select("_m.a", "b", "channel_a", "channel_b", "_m.dist")


def matched_points(matches: DataFrame, points: DataFrame, where: Column | None = None) -> DataFrame:
    """Matches (a, b, dist) with both points as structs; ``where`` filters points."""
    p = points if where is None else points.filter(where)
    end = lambda e: p.select(F.col("blob_id").alias(e), F.struct(*p.columns).alias(f"blob_{e}"))
    return matches.join(end("a"), "a").join(end("b"), "b")


def midpoints(found: DataFrame) -> DataFrame:
    """Means of the coordinates of each match's points."""
    return found.select("a", "b", "dist", *[((F.col(f"blob_a.{c}") + F.col(f"blob_b.{c}")) / 2).alias(c) for c in AXES])


def of_channels(found: DataFrame, one: int, two: int) -> DataFrame:
    low, high = min(one, two), max(one, two)
    return found.filter((F.col("channel_a") == low) & (F.col("channel_b") == high))


def of_points(found: DataFrame, ids: DataFrame, end: str = "a") -> DataFrame:
    return found.join(ids.select(F.col("blob_id").alias(end)).distinct(), end, "left_semi")


def colocalized_by_intensity(points: DataFrame, v: DataFrame, channels: Sequence[int], radius: int = 2) -> DataFrame:
    """Per point and channel 1 where the mean intensity around the point reaches the channel's threshold.

    A voxel that several balls hold belongs to the greatest point id. Points' ids and the voxels' sums are combined by place before
    any shuffle, so crowded places stay small. The threshold is the least mean of the channel's own points.
    """
    r = range(-radius, radius + 1)
    ball = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(AXES, o, strict=True)]) for o in ((a, b, c) for a in r for b in r for c in r) if sum(x * x for x in o) <= radius * radius])
    around = points.select("blob_id", F.col("channel").alias("own"), *AXES, F.explode(ball).alias("o")).select("blob_id", "own", *[(F.col(c).cast("int") + F.col(f"o.{c}")).alias(c) for c in AXES])
    held = around.groupBy(*AXES).agg(F.max_by("own", "blob_id").alias("own"), F.max("blob_id").alias("blob_id"))
    sums = v.groupBy(*AXES, "channel").agg(F.sum("atlas").alias("_s"), F.count("atlas").alias("_n"))
    mean = shuffled(held).join(sums, list(AXES)).groupBy("blob_id", "own", "channel").agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean"))
    least = mean.filter("own = channel").groupBy("channel").agg(F.min("mean").alias("least"))
    return mean.filter(F.col("channel").isin(*channels)).join(least, "channel").select("blob_id", "channel", (F.col("mean") >= F.col("least")).cast("int").alias("coloc"))


def scored_patches(points: DataFrame, v: DataFrame, reach: int, score: Callable[[pd.Series], pd.Series], value: str = "atlas") -> DataFrame:
    """Points with the score of the window of 2 * reach + 1 voxels in y and x around them, as lists of (y, x, value over the maximum).

    ``score`` takes the windows of a batch; a score over 0.5 confirms the point.
    """
    sides = [F.explode(F.sequence(F.col(c).cast("int") - reach, F.col(c).cast("int") + reach)) for c in ("y", "x")]
    cells = points.select("blob_id", F.col("z").cast("int").alias("z"), "x", sides[0].alias("y"), F.col("y").cast("int").alias("y0")).select("blob_id", "z", "y", "y0", F.col("x").cast("int").alias("x0"), sides[1].alias("x"))
    found = shuffled(cells).join(v.select(*AXES, value), list(AXES)).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct((F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.col(value).cast("double").alias("v")))).alias("patch"), F.max(value).alias("_top"))
    scaled = found.select("blob_id", F.transform("patch", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), F.try_divide(p["v"], F.col("_top")).alias("v"))).alias("patch"))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"blob_id": pdf.blob_id, "score": score(pdf.patch).astype(float)})

    return scaled.mapInPandas(run, "blob_id long, score double").withColumn("confirmed", (F.col("score") > 0.5).cast("int"))


def numbered(new: DataFrame, old: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """The id of every key of ``old`` and ``new``: known keys keep theirs, new ones follow the greatest in order of key."""
    fresh = new.select(key).distinct().join(shuffled(old), key, "left_anti").withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    top = old.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("_top"))
    ids = running(fresh, ["_all"], key, "_one").crossJoin(F.broadcast(top)).select(key, (F.col("before") + F.col("_top") + 1).alias(id_))  # one row
    return old.select(key, F.col(id_).cast("long").alias(id_)).unionByName(ids)


def merged_stores(experiments: Sequence[DataFrame], rois: Sequence[DataFrame]) -> DataFrame:
    """Boxes of several stores, their experiments joined by name: (name, experiment_id, roi columns), ids anew by name."""
    out = None
    for e, r in zip(experiments, rois, strict=True):
        part = r.join(e.select(F.col("id").alias("experiment_id"), "name"), "experiment_id").drop("experiment_id")
        out = part if out is None else out.unionByName(part)
    out = out.distinct()
    names = out.select("name")
    return out.join(numbered(names, names.limit(0).withColumn("experiment_id", F.lit(0).cast("long")), "name", "experiment_id"), "name")


def roi_table(rois: DataFrame, points: DataFrame, v: DataFrame, unit: float) -> DataFrame:
    """Per box: volume, summed intensity, points, confirmed points and densities; boxes without rows have zeros.

    Intensities are summed by place before they meet the boxes, so the rows of a crowded cell are combined first.
    """
    n = in_rois(points, rois).groupBy("roi_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("confirmed") == 1, 1)).alias("n_confirmed"))
    i = in_rois(v.groupBy(*AXES).agg(F.sum("atlas").alias("atlas")), rois).groupBy("roi_id").agg(F.sum("atlas").alias("intensity"))
    d = rois.join(n, "roi_id", "left").join(i, "roi_id", "left").withColumn("volume", F.col("nz") * F.col("ny") * F.col("nx") * unit)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_confirmed")}
    return d.select("roi_id", "volume", F.coalesce("intensity", F.lit(0.0)).alias("intensity"), *[x.alias(c) for c, x in zero.items()], F.try_divide(zero["n"], F.col("volume")).alias("density"), F.try_divide(zero["n_confirmed"], F.col("volume")).alias("density_confirmed"))


def verified_rois(rois: DataFrame, points: DataFrame, truth: DataFrame, tolerance: Sequence[float]) -> DataFrame:
    """Per box from ``roi_matches``: positives, true and false positives and false negatives."""
    m = roi_matches(points, truth, rois, tolerance).groupBy("roi_id").agg(F.count("*").alias("tp"))
    n = lambda p, name: in_rois(p, rois).groupBy("roi_id").agg(F.count("*").alias(name))
    d = rois.select("roi_id").join(n(truth, "pos"), "roi_id", "left").join(n(points, "found"), "roi_id", "left").join(m, "roi_id", "left").na.fill(0)
    return d.select("roi_id", "pos", "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"))


def experiments_named(experiments: DataFrame, name: str, extension: bool = True) -> DataFrame:
    """Experiments of a name; without ``extension`` what follows the last dot of either is ignored."""
    if extension:
        return experiments.filter(F.col("name") == name)
    bare = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    return experiments.filter(bare(F.col("name")) == bare(F.lit(name)))


def merged_boxes(boxes: DataFrame, points: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, points and matches of several stores as one: boxes of one experiment and place become the first (by store and id), and
    points and matches follow with new ids.

    ``boxes(store, roi_id, experiment, z0, y0, x0, ...)``, ``points(store, roi_id, blob_id, ...)``, ``matches(store, roi_id, a, b, ...)``.
    New ids are hashes of store and id, so nothing is numbered in one task.
    """
    place = ["experiment", "z0", "y0", "x0"]
    first = boxes.groupBy(*place).agg(F.min(F.struct("store", "roi_id")).alias("_f"))
    keyed = boxes.join(first, place).withColumn("_new", F.xxhash64("_f.store", "_f.roi_id"))
    of = keyed.select("store", "roi_id", "_new").distinct()
    kept = keyed.filter((F.col("store") == F.col("_f.store")) & (F.col("roi_id") == F.col("_f.roi_id"))).withColumn("roi_id", F.col("_new")).select(*boxes.columns).drop("store")
    new = lambda c: F.xxhash64("store", c)
    moved = points.join(of, ["store", "roi_id"]).withColumns({"roi_id": F.col("_new"), "blob_id": new("blob_id")}).select(*[c for c in points.columns if c != "store"])
    links = matches.join(of, ["store", "roi_id"]).withColumns({"roi_id": F.col("_new"), "a": new("a"), "b": new("b")}).select(*[c for c in matches.columns if c != "store"])
    return kept, moved, links
