"""Preprocessing of image volumes and detection of blobs on halo blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, shuffled
from .blocks import CELL, block_tasks, blurred, extents, fitted, laplacian, on_blocks, reach
from .points import greedy_matches, kept_first, near_pairs, squared
from .tables import grid_statistics


@dataclass(frozen=True)
class Profile:
    """Settings of a channel. Lengths are in micrometres where ``resolution`` is given."""

    clip_low: float = 5.0  # percentiles of a tile
    clip_high: float = 99.5
    near_max_factor: float = 0.5
    clip_min: float = 0.0
    clip_max: float = 1.0
    total_variation: float = 0.0  # weight of the denoiser; 0: none
    unsharp: float = 0.3
    blur: float = 8.0
    erosion_over: float = 0.2  # of a tile's mean; 0: never
    min_sigma: float = 2.6
    max_sigma: float = 4.0
    sigmas: int = 10
    threshold: float = 0.1
    overlap: float = 0.5
    tile: float = 500.0
    denoise_tile: float = 25.0
    tolerance: tuple[float, float, float] = (1.0, 1.0, 1.0)
    exclude_border: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class BlockSettings:
    """Tile sizes, overlaps and tolerances in voxels, in z, y, x."""

    tile: tuple[int, ...]
    denoise_tile: tuple[int, ...]
    overlap: tuple[int, ...]
    tolerance: tuple[int, ...]
    padding: tuple[int, ...]


def scaling_factor(resolution: Sequence[float]) -> list[float]:
    """Voxels per micrometre on each axis."""
    return [1.0 / r for r in resolution]


def overlap_voxels(resolution: Sequence[float], factor: float = 5.0) -> list[int]:
    return [math.ceil(f * factor) for f in scaling_factor(resolution)]


def isotropic_factor(resolution: Sequence[float], scale: Sequence[float] = (1.0, 1.0, 1.0)) -> list[float]:
    """By how much each axis is stretched so that voxels become cubes of the finest resolution."""
    return [r / min(resolution) * s for r, s in zip(resolution, scale, strict=True)]


def block_settings(profile: Profile, resolution: Sequence[float]) -> BlockSettings:
    """Overlaps are at least twice an excluded border and one voxel more, and such axes need no pruning past it."""
    scale, base = scaling_factor(resolution), overlap_voxels(resolution)
    tolerance = tuple(int(b * t) for b, t in zip(base, profile.tolerance, strict=True))
    border = profile.exclude_border or (0, 0, 0)
    overlap = tuple(max(b, 2 * e) + (1 if e > 0 else 0) for b, e in zip(base, border, strict=True))
    padding = tuple(0 if e > 0 else t for t, e in zip(tolerance, border, strict=True))
    sized = lambda n: tuple(math.ceil(f * n) for f in scale)
    return BlockSettings(sized(profile.tile), sized(profile.denoise_tile), overlap, tolerance, padding)


def saturate(a: np.ndarray, profile: Profile, near_max: float) -> np.ndarray:
    """Clipped at two percentiles of the tile and stretched to 0..1; a flat tile stays. The upper end is never below a part of ``near_max``."""
    low, high = np.percentile(a, (profile.clip_low, profile.clip_high))
    if low == high:
        return a
    high = max(high, near_max * profile.near_max_factor)
    return (np.clip(a, low, high) - low) / (high - low)


def total_variation(a: np.ndarray, weight: float, eps: float = 2e-4, rounds: int = 200) -> np.ndarray:
    """Chambolle's (2004) dual projection for the total variation of an array; ends when the energy changes by under ``eps`` of the first."""
    p, step, before, first = np.zeros((a.ndim, *a.shape)), 1.0 / (2 * a.ndim), 0.0, 0.0
    out = a
    for i in range(rounds):
        if i:
            away = -p.sum(axis=0)
            for axis in range(a.ndim):
                to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
                to[axis], of[axis] = slice(1, None), slice(0, -1)
                away[tuple(to)] += p[(axis, *of)]
            out = a + away
        else:
            away = np.zeros_like(a)
        rise = np.zeros_like(p)
        for axis in range(a.ndim):
            of = [slice(None)] * a.ndim
            of[axis] = slice(0, -1)
            rise[(axis, *of)] = np.diff(out, axis=axis)
        norm = np.sqrt((rise**2).sum(axis=0))
        energy = ((away**2).sum() + weight * norm.sum()) / a.size
        p = (p - step * rise) / (1 + step / weight * norm)
        if i == 0:
            first = energy
        elif abs(before - energy) < eps * first:
            break
        before = energy
    return out


def denoise(a: np.ndarray, profile: Profile) -> np.ndarray:
    """Clip, total variation, unsharp mask, and erosion by face neighbours where the tile's mean is high."""
    mean, out = a.mean(), np.clip(a, profile.clip_min, profile.clip_max)
    if profile.total_variation:
        out = total_variation(out, profile.total_variation)
    if profile.unsharp:
        out = 2 * out - profile.unsharp * blurred(out, profile.blur)
    if profile.erosion_over and mean > profile.erosion_over:
        wide = np.pad(out, 1, constant_values=np.inf)
        for axis in range(3):
            for k in (0, 2):
                index = [slice(1, -1)] * 3
                index[axis] = slice(k, k + out.shape[axis])
                out = np.minimum(out, wide[tuple(index)])
    return out


def preprocessed(v: DataFrame, profile: Profile, near_max: float = 1.0, value: str = "value", tile: Sequence[int] = (25, 25, 25), steps: Sequence[str] = ("saturate", "denoise"), shape: Sequence[int] | None = None) -> DataFrame:
    """``v(z, y, x, value)`` -> the same with each tile preprocessed on its own by ``steps`` in order.

    Percentiles, means and blurs are of a tile without its surroundings (the
    last tiles may be smaller); the result has a row for every place of a tile that
    has a voxel. Nulls count as 0. ``near_max``: the volume's value near its
    maximum (see ``near_maxima``).
    """
    work = {"saturate": lambda a: saturate(a, profile, near_max), "denoise": lambda a: denoise(a, profile)}

    def run(arrays, low, core, key):
        a = arrays[value]
        for s in steps:
            a = work[s](a)
        z, y, x = np.indices(a.shape).reshape(3, -1)
        return {"z": (z + low[0]).astype(np.int32), "y": (y + low[1]).astype(np.int32), "x": (x + low[2]).astype(np.int32), value: a.ravel()}

    return on_blocks(v, {value: "f8"}, shape or extents(v), tile, (0, 0, 0), run, f"z int, y int, x int, {value} double")


#: Voxels of a block of the scale space, and those of its planes that are filtered at a time, so that they stay in a core's cache.
VOXELS, PLANES = 2**20, 2**15


def responses(a: np.ndarray, profile: Profile, within: Sequence[slice] | None = None) -> np.ndarray:
    """Scale-normalized negative Laplacians of Gaussians, one for each scale, at the places ``within``, between a layer of -inf on all sides."""
    within = within or [slice(0, n) for n in a.shape]
    sigmas = np.linspace(profile.min_sigma, profile.max_sigma, profile.sigmas)
    out = np.full([n + 2 for n in (len(sigmas), *(w.stop - w.start for w in within))], -np.inf)
    first, step = within[0].start, max(PLANES // max(a[0].size, 1), 1)
    for z in range(first, within[0].stop, step):
        planes = slice(z, min(z + step, within[0].stop))
        for i, s in enumerate(sigmas):
            np.multiply(laplacian(a, s, (planes, *within[1:])), -s * s, out=out[i + 1, 1 + planes.start - first : 1 + planes.stop - first, 1:-1, 1:-1])
    return out


def peaks(cube: np.ndarray, threshold: float, core: Sequence[slice]) -> tuple[np.ndarray, ...]:
    """Indices of the entries of ``core`` over the threshold that are greatest among their neighbours in scale and space; the first of equal ones.

    The outermost layer only counts as neighbours. Few entries are over the threshold, and fewer with each neighbour they are held against.
    """
    flat, steps = cube.ravel(), np.array(cube.strides) // cube.itemsize
    inner = (slice(1, -1), *core)
    found = np.nonzero(cube[inner] > threshold)
    at = sum((i + s.start) * n for i, s, n in zip(found, inner, steps, strict=True))
    around = [o for o in product((-1, 0, 1), repeat=4) if any(o)]
    for o in sorted(around, key=lambda o: sum(map(abs, o))):
        other = flat[at + int(np.dot(o, steps))]
        at = at[flat[at] > other if o < (0, 0, 0, 0) else flat[at] >= other]
    return np.unravel_index(at, cube.shape)


def scale_space_peaks(v: DataFrame, profile: Profile, value: str = "value", size: Sequence[int] | None = None, shape: Sequence[int] | None = None) -> DataFrame:
    """``v(z, y, x, value)`` -> (z, y, x, scale, sigma, response): local maxima of the response over scales and places.

    Blocks have a halo as wide as the largest kernel and one voxel more, so
    the result is the same for any ``size``. Beyond the volume it is mirrored.
    """
    wide = (reach(profile.max_sigma) + 1,) * 3
    sigmas = np.linspace(profile.min_sigma, profile.max_sigma, profile.sigmas)
    shape = shape or extents(v)
    size = size or fitted(shape, VOXELS)

    def run(arrays, low, core, key):
        a = arrays[value]
        within = [slice(max(c.start - 1, 0), min(c.stop + 1, n)) for c, n in zip(core, a.shape, strict=True)]
        cube = responses(a, profile, within)
        s, *place = peaks(cube, profile.threshold, [slice(c.start - w.start + 1, c.stop - w.start + 1) for c, w in zip(core, within, strict=True)])
        response = cube[(s, *place)]
        place = [(p + w.start - 1 + lo).astype(np.int32) for p, w, lo in zip(place, within, low, strict=True)]
        return dict(zip(CELL, place, strict=True)) | {"scale": (s - 1).astype(np.int32), "sigma": sigmas[s - 1], "response": response}

    return on_blocks(v, {value: "f8"}, shape, size, wide, run, "z int, y int, x int, scale int, sigma double, response double", parts=block_tasks(v.sparkSession, shape, size), lists=True)


def sphere_overlap(distance: Column, a: Column, b: Column) -> Column:
    """Shared part of the smaller of two spheres with radii ``a`` and ``b``."""
    small, large = F.least(a, b), F.greatest(a, b)
    lens = (large + small - distance) ** 2 * (distance**2 + 2 * distance * (large + small) - 3 * (large**2 + small**2) + 6 * large * small) / (16 * distance * small**3)
    return F.when(distance >= a + b, 0.0).when(distance <= large - small, 1.0).otherwise(lens)


def _named(blobs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """With ``_id``, by which the largest of its ``keys`` come first, then by place."""
    return blobs.withColumn("_id", F.struct(*keys, (-F.col("radius")).alias("r"), *[F.col(c).cast("long").alias(c) for c in CELL]))


def _overlapping(named: DataFrame, most: float, overlap: float | Column, keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """Pairs of blobs of radii up to ``most`` that share more than ``overlap``, ``_id_a`` the later one: (_id_a, _id_b, share, and ``more`` of both)."""
    spots = named.select("_id", *keys, *[F.col(c).cast("double").alias(c) for c in CELL], "radius", *more)
    pairs = near_pairs(spots, spots, (2 * most,) * 3, keys).filter("_id_b < _id_a").withColumnsRenamed({f"{k}_a": k for k in keys})
    share = sphere_overlap(F.sqrt(squared()), F.col("radius_a"), F.col("radius_b"))
    return pairs.filter(share > overlap).select("_id_a", "_id_b", share.alias("share"), *[f"{c}_{e}" for c in more for e in "ab"])


def without_overlaps(blobs: DataFrame, most: float, overlap: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Largest first (ties by place): a blob goes if a kept one of its ``keys`` shares more than ``overlap`` of the smaller of both.

    ``blobs(keys, z, y, x, radius, ...)``, at most one of each radius at a place, radii up to ``most``; ``overlap`` may depend on the keys.
    """
    named = _named(blobs, keys)
    gone = kept_first(_overlapping(named, most, overlap, keys).select(F.col("_id_a").alias("later"), F.col("_id_b").alias("earlier")))
    return named.join(shuffled(gone.withColumnRenamed("later", "_id")), "_id", "left_anti").drop("_id")


def detected(v: DataFrame, profile: Profile, value: str = "value", size: Sequence[int] | None = None, shape: Sequence[int] | None = None, channel: int = 0) -> DataFrame:
    """Blobs of a volume: z, y, x, radius, confirmed, truth, channel, abs_z, abs_y, abs_x (as ``formatted``).

    Peaks of the scale space, without those that larger blobs overlap; the
    radius is sigma times the root of 3. ``exclude_border`` drops blobs that are
    nearer to the volume's faces. No voxels give no blobs.
    """
    shape = shape or extents(v)
    found = cut(scale_space_peaks(v, profile, value, size, shape).select(*CELL, (F.col("sigma") * math.sqrt(3)).alias("radius")))  # the volume is filtered once
    found = without_overlaps(found, profile.max_sigma * math.sqrt(3), profile.overlap)
    if profile.exclude_border:
        for c, b, n in zip(CELL, profile.exclude_border, shape, strict=True):
            found = found.filter(F.col(c).between(b, n - 1 - b))
    return formatted(found.select(*CELL, "radius"), channel)


def detection_grid(v: DataFrame, truth: DataFrame, profile: Profile, thresholds: Sequence[float], overlaps: Sequence[float], tolerance: Sequence[float], value: str = "value", size: Sequence[int] | None = None, shape: Sequence[int] | None = None) -> DataFrame:
    """``detected`` for every pair of threshold and overlap, held against ``truth(z, y, x)``: (threshold, overlap, pos, tp, fp, ppv, sensitivity, fdr).

    The volume is filtered once: a peak is one at any threshold under its
    response, so settings differ in the peaks they take and in what overlaps. Peaks are one row for all settings, and
    overlaps are looked for once. Detected and true points are
    matched one to one, smallest sum of axis distances first, within the tolerance.
    Settings without points keep their row.
    """
    shape = shape or extents(v)
    settings = [(i, float(t), float(o)) for i, (t, o) in enumerate(product(thresholds, overlaps))]
    every = F.array(*[F.lit(i) for i, _, _ in settings])
    of = lambda n, i: F.element_at(F.array(*[F.lit(s[n]) for s in settings]), i + 1)
    found = scale_space_peaks(v, replace(profile, threshold=min(thresholds)), value, size, shape)
    found = _named(cut(found.select(*CELL, (F.col("sigma") * math.sqrt(3)).alias("radius"), "response")))
    pairs = cut(_overlapping(found, profile.max_sigma * math.sqrt(3), float(min(overlaps)), more=("response",)))  # else each further filter works out all shares again
    pairs = pairs.withColumn("setting", F.explode(every)).filter((F.least("response_a", "response_b") > of(1, F.col("setting"))) & (F.col("share") > of(2, F.col("setting"))))
    gone = kept_first(pairs.select(*[F.struct("setting", F.col(f"_id_{e}").alias("_id")).alias(n) for e, n in (("a", "later"), ("b", "earlier"))]))
    gone = gone.groupBy("later._id").agg(F.collect_set("later.setting").alias("_gone"))
    over = F.filter(every, lambda i: F.col("response") > of(1, i))
    left = F.when(F.col("_gone").isNull(), over).otherwise(F.array_except(over, "_gone"))
    found = found.join(shuffled(gone), "_id", "left").select(*CELL, "radius", left.alias("settings")).filter(F.size("settings") > 0)
    if profile.exclude_border:
        for c, b, n in zip(CELL, profile.exclude_border, shape, strict=True):
            found = found.filter(F.col(c).between(b, n - 1 - b))
    place = [F.col(c).cast("double").alias(c) for c in CELL]
    found = cut(found.select(*place, "radius", "settings"))
    real = cut(truth.groupBy(*place).agg(F.count("*").alias("_c")))
    hits = _setting_matches(found, real, tolerance, every).groupBy("setting").agg(F.sum("_n").alias("tp"))
    each = found.select(F.explode("settings").alias("setting")).groupBy("setting").agg(F.count("*").alias("_n"))
    rows = v.sparkSession.createDataFrame(settings, "setting int, threshold double, overlap double").crossJoin(F.broadcast(real.agg(F.sum("_c").alias("pos"))))  # one row
    counts = rows.join(each, "setting", "left").join(hits, "setting", "left").na.fill(0)
    return grid_statistics(counts.select("threshold", "overlap", "pos", "tp", (F.col("_n") - F.col("tp")).alias("fp")), ["threshold", "overlap"])


def _setting_matches(found: DataFrame, real: DataFrame, tolerance: Sequence[float], every: Column) -> DataFrame:
    """Numbers of one-to-one matches (setting, _n), to be summed, of ``found(z, y, x, radius, settings)`` with ``real(z, y, x, _c)``.

    Places that are near each other and near no others match as many points as both have, in any
    setting; only the rest, setting by setting, needs an order.
    """
    one, two = [f"{c}_a" for c in CELL], [f"{c}_b" for c in CELL]
    near = cut(near_pairs(found.select(*CELL).distinct(), real.select(*CELL), tolerance))
    single = lambda own, other: near.groupBy(*own).agg(F.count("*").alias("_k"), *[F.max(c).alias(c) for c in other]).filter("_k = 1").drop("_k")
    alone = cut(single(one, two).join(shuffled(single(two, one)), [*one, *two]))
    at = lambda d, own: d.select(*[F.col(o).alias(c) for o, c in zip(own, CELL, strict=True)])
    most = alone.join(shuffled(real.withColumnsRenamed(dict(zip(CELL, two, strict=True)))), two)
    most = most.select(*[F.col(o).alias(c) for o, c in zip(one, CELL, strict=True)], "_c")
    settled = found.join(shuffled(most), list(CELL)).select(*CELL, "_c", F.explode("settings").alias("setting")).groupBy(*CELL, "setting").agg(F.least(F.count("*"), F.max("_c")).alias("_n"))
    rest = lambda d, own: d.join(shuffled(at(near, own).distinct().join(shuffled(at(alone, own)), list(CELL), "left_anti")), list(CELL), "left_semi")
    numbered = lambda d: d.select("setting", *CELL, F.struct("setting", *CELL, "n").alias("blob_id"))
    dots = rest(found, one).select(*CELL, F.col("radius").alias("n"), F.explode("settings").alias("setting"))
    true = rest(real, two).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int")))).withColumn("setting", F.explode(every))
    ordered = greedy_matches(cut(numbered(dots)), cut(numbered(true)), tolerance, ("setting",))
    return settled.select("setting", "_n").unionByName(ordered.select(F.col("a.setting").alias("setting"), F.lit(1).cast("long").alias("_n")))


#: Columns of a blob table beside its place and radius, and what they hold where nothing is known.
UNKNOWN = {"confirmed": -1, "truth": -1, "channel": 0}


def formatted(points: DataFrame, channel: int | None = 0) -> DataFrame:
    """Blobs with all columns: flags default to -1, the channel to the given one, absolute places to the relative ones."""
    out = points
    for c, unknown in UNKNOWN.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(channel if c == "channel" else unknown).cast("int"))
    for c in CELL:
        if f"abs_{c}" not in out.columns:
            out = out.withColumn(f"abs_{c}", F.col(c))
    return out


def located(points: DataFrame) -> DataFrame:
    """Absolute places take the place of relative ones, and their columns go."""
    return points.withColumns({c: F.col(f"abs_{c}") for c in CELL}).drop(*[f"abs_{c}" for c in CELL])
