"""Smoothing of labels: erosion, opening and closing at any radius as thresholds on exact distances in halo blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .blocks import CELL, dealt, extents, fitted, nearest_places, on_blocks, squared_distances
from .volumes import nearest_voxel

MODES = ("opening", "closing", "adaptive_opening", "adaptive_closing", "adaptive_erosion")
#: Fraction of a label's voxels that an adaptive filter must keep, and under which an opening gives way to a closing.
LEAST_KEPT, LOST = 0.2, 0.01
#: A label's own filter: eight bits for each size, of which the highest says closing (1) or else opening or erosion.
BITS = 8
_NONE = np.int64(-(2**62))
#: Voxels within which gaps between smoothed labels are filled in blocks.
REACH = 16


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    """Voxels whose whole ball is in the mask; beyond the array all is in it."""
    return mask & (squared_distances(~mask, radius) > radius * radius) if radius else mask


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    return squared_distances(mask, radius) <= radius * radius if radius else mask


def filtered(mask: np.ndarray, radius: int, how: str) -> np.ndarray:
    if how == "erosion":
        return eroded(mask, radius)
    return eroded(dilated(mask, radius), radius) if how == "closing" else dilated(eroded(mask, radius), radius)


def _around(mask: np.ndarray, by: int) -> tuple[slice, ...]:
    """The box of a mask, ``by`` voxels wider where the array goes on."""
    out = []
    for axis in range(3):
        on = np.flatnonzero(mask.any(axis=tuple(a for a in range(3) if a != axis)))
        out.append(slice(max(int(on[0]) - by, 0), min(int(on[-1]) + 1 + by, mask.shape[axis])))
    return tuple(out)


def kept_sizes(v: DataFrame, radii: Sequence[int], how: str, shape: Sequence[int], size: Sequence[int] = (32, 32, 32), background: bool = True, label: str = "label", parts: int = 0) -> DataFrame:
    """(label, radius, kept): voxels of each label that filtering it alone by each of ``radii`` leaves, all in one pass.

    A label's distances to its outside are found once for all radii.
    """
    most = max(radii)

    def run(arrays, low, core, key):
        a, out = arrays[label], []
        inside = np.zeros(a.shape, bool)
        inside[core] = True
        for x in np.unique(a).tolist():
            if x == 0 and not background:
                continue
            box = _around(a == x, 2 * most + 1)
            mask, own = a[box] == x, inside[box]
            for r in radii:
                out.append((x, r, int(filtered(mask, r, how)[own].sum())))
        labels, at, kept = zip(*out, strict=True) if out else ((), (), ())
        return {label: np.array(labels, np.int64), "radius": np.array(at, np.int32), "kept": np.array(kept, np.int64)}

    found = on_blocks(v, {label: "i8"}, shape, size, (2 * most + 1,) * 3, run, f"{label} long, radius int, kept long", parts=parts)
    return found.groupBy(label, "radius").agg(F.sum("kept").alias("kept"))


def own_filters(v: DataFrame, sizes: Sequence[int], mode: str, shape: Sequence[int], size: Sequence[int], small: int, background: bool, label: str = "label", parts: int = 0) -> DataFrame:
    """(label, volume, codes): for each of ``sizes`` the radius that a label is filtered by, and whether it is closed.

    ``opening``: the size, half of it (rounded down) for labels under ``small``
    voxels; a label of which under ``LOST`` would be left is closed by the same.
    ``adaptive_*``: the largest radius up to the size that changes the label and keeps over ``LEAST_KEPT``
    of it (0 if none does). ``closing``: the size.
    """
    how = "erosion" if mode == "adaptive_erosion" else "closing" if "closing" in mode else "opening"
    volume = v.filter(F.col(label) != 0).groupBy(F.col(label).cast("long").alias(label)).agg(F.count("*").alias("volume"))
    if background:
        rest = volume.agg((F.lit(int(np.prod([int(n) for n in shape]))) - F.coalesce(F.sum("volume"), F.lit(0))).alias("volume"))
        volume = volume.unionByName(rest.select(F.lit(0).cast("long").alias(label), "volume").filter("volume > 0"))
    volume = cut(volume)
    if mode == "closing":
        code = sum(F.lit((n | 0x80) << (BITS * i)) for i, n in enumerate(sizes))
        return volume.select(label, "volume", code.cast("long").alias("codes"))
    radii = sorted({*range(1, max(sizes) + 1)} if mode != "opening" else {r for n in sizes for r in (n, n // 2)})
    kept = kept_sizes(v, radii, how, shape, size, background, label, parts)
    wide = volume.join(kept.groupBy(label).agg(*[F.max(F.when(F.col("radius") == r, F.col("kept"))).alias(f"kept_{r}") for r in radii]), label, "left")
    code = F.lit(0).cast("long")
    for i, n in enumerate(sizes):
        if mode == "opening":
            own = F.when(F.col("volume") < small, n // 2).otherwise(n)
            left = F.when(F.col("volume") < small, F.coalesce(F.col(f"kept_{n // 2}"), F.lit(0))).otherwise(F.coalesce(F.col(f"kept_{n}"), F.lit(0)))
            one = own + F.when(left / F.col("volume") < LOST, 0x80).otherwise(0)
        else:
            fits = lambda r: (F.col(f"kept_{r}") != F.col("volume")) & (F.col(f"kept_{r}") / F.col("volume") > LEAST_KEPT)
            one = F.coalesce(*[F.when(fits(r), r) for r in range(n, 0, -1)], F.lit(0)) + (0x80 if how == "closing" else 0)
        code = code + F.shiftleft(one.cast("long"), BITS * i)
    return wide.select(label, "volume", code.alias("codes"))


def _stored(v: DataFrame, label: str) -> DataFrame:
    """Places and labels, written once, as several passes read them."""
    return cut(v.select(*CELL, F.col(label).cast("long").alias(label)))


def _by_size(v: DataFrame, sizes: Sequence[int], mode: str, shape: Sequence[int], block: Sequence[int] | None, small: int, crop: int | None, background: bool, label: str) -> tuple[DataFrame, list[str]]:
    """A table of ``_stored`` -> (z, y, x, was, to_0, to_1, ...), one row a place, and the names of the labels by each of ``sizes``; see ``smoothed_labels``."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if len(sizes) > 7 or max(sizes, default=0) > 100 or min(sizes, default=0) < 0:
        raise ValueError("up to 7 sizes from 0 to 100")
    most = max([*sizes, crop or 0, 1])
    box, parts = block or fitted(shape, 2**16), dealt(v)
    filters = cut(own_filters(v, sizes, mode, shape, box, small, background, label, parts))
    behind = filters.filter(F.col(label) == 0).first()  # one row
    how = "erosion" if mode == "adaptive_erosion" else "opening"
    rows = v.filter(F.col(label) != 0).join(filters, label)
    far = 2 * most if how == "erosion" else most  # of the nearest; erosion itself reaches half as far as an opening
    names = [f"to_{i}" for i in range(len(sizes))]

    def written(was: np.ndarray, new: list[np.ndarray], low: Sequence[int], core: Sequence[slice]) -> dict[str, np.ndarray]:
        at = np.nonzero(np.logical_or.reduce([was != 0, *[a != 0 for a in new]]))
        place = [(p + c.start + lo).astype(np.int32) for p, c, lo in zip(at, core, low, strict=True)]
        return dict(zip((*CELL, "was", *names), [*place, was[at], *[a[at] for a in new]], strict=True))

    def run(arrays, low, core, key):
        a, wide = arrays[label], tuple(slice(max(c.start - far, 0), c.stop + far) for c in core)
        near = tuple(slice(c.start - w.start, c.stop - w.start) for c, w in zip(core, wide, strict=True))
        present, first = np.unique(a, return_index=True)
        own = {x: (int(arrays["volume"].flat[i]), int(arrays["codes"].flat[i])) for x, i in zip(present.tolist(), first.tolist(), strict=True)}
        if 0 in own:
            own[0] = (behind["volume"], behind["codes"]) if behind is not None else (1 << 62, 0)
        order = sorted(own, key=lambda x: (-own[x][0], x))
        clear = None
        if crop is not None:
            clear = filtered(a == 0, crop, "opening")[core]
        out = []
        for i in range(len(sizes)):
            new = np.full(a.shape, _NONE)
            for x in order:
                code = own[x][1] >> (BITS * i) & 0xFF
                r, closed = code & 0x7F, code >> 7
                box = _around(a == x, 2 * r + 1)
                new[box][filtered(a[box] == x, r, "closing" if closed else how)] = x
            new = _nearest(new[wide], new[wide] != _NONE, near, far)
            if clear is not None:
                new[clear] = 0
            out.append(new)
        return written(a[core], out, low, core)

    def fill(arrays, low, core, key):
        return written(arrays["was"][core], [_nearest(a, (a != 0) & (a != _NONE), core, REACH) for a in (arrays[n] for n in names)], low, core)

    schema = f"z int, y int, x int, was long, {', '.join(f'{n} long' for n in names)}"
    gaps = F.greatest(*[(F.col(n) == int(_NONE)).cast("int") for n in names], F.lit(0)) == 1
    done = cut(on_blocks(rows, {label: "i8", "codes": "i8", "volume": "i8"}, shape, box, (3 * most + 1,) * 3, run, schema, parts=parts))
    if done.filter(gaps).isEmpty():
        return done, names
    filled = cut(on_blocks(done, dict.fromkeys(("was", *names), "i8"), shape, block or fitted(shape), (REACH,) * 3, fill, schema, parts=dealt(done)))
    if filled.filter(gaps).isEmpty():
        return filled, names
    for n in names:  # a few sizes
        rest = filled.filter(F.col(n) == int(_NONE)).select(*CELL)
        if not rest.isEmpty():  # further than blocks reach
            found = nearest_voxel(rest, done.filter(~F.col(n).isin(0, int(_NONE))).select(*CELL, F.col(n).alias("_near")), float(most), ["_near"])
            one = filled.join(found.drop("dist"), list(CELL), "left")
            filled = cut(one.withColumn(n, F.when(F.col(n) == int(_NONE), F.coalesce("_near", F.lit(0))).otherwise(F.col(n))).select(*done.columns))
    return filled, names


def _nearest(a: np.ndarray, held: np.ndarray, core: tuple[slice, ...], most: int) -> np.ndarray:
    """The core, whose gaps take the value of the nearest voxel of ``held`` within ``most`` (of equally near ones the first)."""
    out = a[core].copy()
    gap = out == _NONE
    if gap.any():
        d, place = nearest_places(held, most)
        gap &= d[core] <= most * most
        out[gap] = a.ravel()[place[core][gap]]
    return out


def smoothed_labels(v: DataFrame, sizes: Sequence[int], mode: str = "opening", shape: Sequence[int] | None = None, block: Sequence[int] | None = None, small: int = 5000, crop: int | None = None, background: bool = True, label: str = "label") -> DataFrame:
    """``v(z, y, x, label)`` -> (filter_size, z, y, x, was, label): the volume smoothed by each of ``sizes``, in two passes for all.

    Places without a row have label 0, which is filtered as any label if
    ``background``. All labels are filtered as they are in ``v``; where closed
    labels meet others the label of fewer voxels wins (of equal ones the greater).
    Voxels that no filtered label holds take the label of the nearest one that
    does (ties by place): within the largest size (twice that for erosion) of any,
    background included, else of the labelled ones. ``crop``: the background of ``v``, opened by that radius, stays
    background. Size 0 changes nothing. Rows that were and are background are left
    out. No voxels give no rows; rows that repeat a place are an error of the table.

    A place is one row for all sizes until the end; labels beyond the largest size are looked for in a third pass over
    blocks, and only places without any within ``REACH`` voxels are joined with the rest.
    """
    v = _stored(v, label)
    wide, names = _by_size(v, sizes, mode, shape or extents(v), block, small, crop, background, label)
    each = F.array(*[F.struct(F.lit(n).cast("int").alias("filter_size"), F.col(c).alias("to")) for n, c in zip(sizes, names, strict=True)])
    out = wide.select(*CELL, "was", F.explode(each).alias("_one")).select("_one.filter_size", *CELL, "was", F.col("_one.to").alias(label))
    return out.filter((F.col("was") != 0) | (F.col(label) != 0))


def _measured(a: np.ndarray, core: tuple[slice, ...], area: Sequence[float], was: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Labels of the core that are not 0, their voxels, surface, and voxels that ``was`` another label."""
    a = np.pad(a, 1, constant_values=_NONE)
    here = a[tuple(slice(c.start + 1, c.stop + 1) for c in core)]
    labels, at = np.unique(here, return_inverse=True)
    at = at.ravel()
    surface = np.zeros(len(labels))
    for axis in range(3):
        for step in (0, 2):
            other = a[tuple(slice(c.start + (step if i == axis else 1), c.stop + (step if i == axis else 1)) for i, c in enumerate(core))]
            surface += np.bincount(at, (here != other).ravel() * area[axis], len(labels))
    away = np.bincount(at, (was[core] != here).ravel(), len(labels)) if was is not None else np.zeros(len(labels))
    some = labels != 0
    return labels[some], np.bincount(at, minlength=len(labels))[some], surface[some], away[some]


def label_measures(v: DataFrame, by: Sequence[str] = (), spacing: Sequence[float] = (1.0, 1.0, 1.0), shape: Sequence[int] | None = None, block: Sequence[int] | None = None, label: str = "label", was: str | None = None) -> DataFrame:
    """Per label (and ``by``): volume, surface of the voxel faces that its own voxels don't cover, and displaced, the volume that ``was`` another label.

    One pass over blocks with a halo of one voxel; beyond the volume faces are open.
    """
    sz, sy, sx = spacing
    area, voxel = (sy * sx, sz * sx, sz * sy), sz * sy * sx
    names, shape = [label, *([was] if was else [])], shape or extents(v)

    def run(arrays, low, core, key):
        labels, n, surface, away = _measured(arrays[label], core, area, arrays[was] if was else None)
        return {label: labels, "volume": n * voxel, "surface": surface, "displaced": away * voxel}

    kinds = "".join(f"{k} {v.schema[k].dataType.simpleString()}, " for k in by)
    found = on_blocks(v, dict.fromkeys(names, "i8"), shape, block or fitted(shape), (1, 1, 1), run, f"{kinds}{label} long, volume double, surface double, displaced double", by)
    return found.groupBy(*by, label).agg(*[F.sum(c).alias(c) for c in ("volume", "surface", "displaced")])


def _measures_by_size(wide: DataFrame, names: Sequence[str], sizes: Sequence[int], spacing: Sequence[float], shape: Sequence[int], label: str) -> tuple[DataFrame, DataFrame]:
    """``label_measures`` of what the volume was, and of each size, from one pass over a table of ``_by_size``."""
    sz, sy, sx = spacing
    area, voxel = (sy * sx, sz * sx, sz * sy), sz * sy * sx
    turns = [(-1, "was"), *zip(sizes, names, strict=True)]

    def run(arrays, low, core, key):
        found = [(n, *_measured(arrays[c], core, area, arrays["was"])) for n, c in turns]
        cols = [np.concatenate([f[i] for f in found]) for i in range(1, 5)]
        at = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found])
        return {"filter_size": at, label: cols[0], "volume": cols[1] * voxel, "surface": cols[2], "displaced": cols[3] * voxel}

    found = on_blocks(wide, dict.fromkeys(("was", *names), "i8"), shape, fitted(shape), (1, 1, 1), run, f"filter_size int, {label} long, volume double, surface double, displaced double", parts=dealt(wide))
    both = cut(found.groupBy("filter_size", label).agg(*[F.sum(c).alias(c) for c in ("volume", "surface", "displaced")]))
    return both.filter("filter_size < 0").drop("filter_size"), both.filter("filter_size >= 0")


def smoothing_quality(before: DataFrame, after: DataFrame, by: Sequence[str] = ("filter_size",), label: str = "label") -> DataFrame:
    """Per ``by`` and label of two ``label_measures``: compaction, displacement, their difference, and surface to volume.

    Compaction is the fraction of compactness (surface ^ 3 / volume ^ 2) that
    goes; displacement the fraction of the new volume that was not the label's.
    A label without new volume keeps its row, with nulls.
    """
    groups = after.select(*by).distinct()
    old = before.select(label, F.col("volume").alias("volume_orig"), F.col("surface").alias("surface_orig"))
    d = old.crossJoin(F.broadcast(groups)) if by else old  # a row for each size
    d = d.join(after, [*by, label], "left")
    compact = lambda s, n: F.try_divide(F.col(s) ** 3, F.col(n) ** 2)
    d = d.withColumns({"compactness_orig": compact("surface_orig", "volume_orig"), "compactness": compact("surface", "volume")})
    d = d.withColumns({
        "compaction": F.try_divide(F.col("compactness_orig") - F.col("compactness"), F.col("compactness_orig")),
        "displacement": F.try_divide("displaced", "volume"),
        "sa_to_vol_orig": F.try_divide("surface_orig", "volume_orig"),
        "sa_to_vol": F.try_divide("surface", "volume"),
    })
    return d.select(
        *by, label, "compaction", "displacement", (F.col("compaction") - F.col("displacement")).alias("quality"), "volume_orig", F.coalesce("volume", F.lit(0.0)).alias("volume"), "compactness_orig", "compactness", "sa_to_vol_orig", "sa_to_vol", F.try_divide("sa_to_vol", "sa_to_vol_orig").alias("sa_to_vol_frac")
    )


def aggregate_quality(raw: DataFrame, by: Sequence[str] = ("filter_size",)) -> DataFrame:
    """Means of ``smoothing_quality`` weighted by the original volume, the compactness' deviation and variation, and the fraction of labels lost."""
    w = F.col("volume_orig")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    names = ["compaction", "displacement", "quality", "compactness", "sa_to_vol", "sa_to_vol_frac"]
    out = raw.groupBy(*by).agg(
        *[mean(c).alias(c) for c in names],
        F.sum(F.when(F.col("compactness").isNotNull(), w)).alias("_w"),
        F.try_divide(F.count(F.when((w > 0) & (F.col("volume") <= 0), 1)), F.count(F.when(w > 0, 1))).alias("label_loss"),
    )
    apart = raw.join(out.select(*by, F.col("compactness").alias("_m")), list(by)).groupBy(*by).agg(F.sum(w * (F.col("compactness") - F.col("_m")) ** 2).alias("_s"))
    sd = F.sqrt(F.try_divide("_s", "_w"))
    return out.join(apart, list(by)).select(*by, *names, sd.alias("compactness_sd"), F.try_divide(sd, "compactness").alias("compactness_cv"), "label_loss")


def smoothing_sweep(
    v: DataFrame, sizes: Sequence[int], spacing: Sequence[float] = (1.0, 1.0, 1.0), label: str = "label", mode: str = "opening", shape: Sequence[int] | None = None, block: Sequence[int] | None = None, small: int = 5000, crop: int | None = None, background: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Smooth by each size and measure: (aggregate per size, rows per size and label). The volume is filtered and measured once for all sizes."""
    v, sizes = _stored(v, label), list(dict.fromkeys(sizes))
    shape = shape or extents(v)
    wide, names = _by_size(v, sizes, mode, shape, block, small, crop, background, label)
    before, after = _measures_by_size(wide, names, sizes, spacing, shape, label)
    raw = cut(smoothing_quality(before, after, label=label))
    return aggregate_quality(raw), raw


def refinement_row(v: DataFrame, atlas: str, label: str, threshold: float, threshold_all: float, spacing: Sequence[float] = (1.0, 1.0, 1.0), label_range: tuple[int, int] | None = None) -> DataFrame:
    """One row for a whole volume: Dice coefficient of atlas and labels, the volumes of both in voxels, and the atlas' compactness.

    The atlas' foreground is over ``threshold``, that of the compactness over
    ``threshold_all``; labels are those that are not 0, with ``label_range`` only those within it (ends included) beside.
    """
    one = F.col(atlas) > threshold
    two = F.col(label) != 0 if label_range is None else (F.col(label) != 0) | F.col(label).between(*label_range)
    n = lambda m: F.count(F.when(m, 1))
    overlap = v.agg(F.try_divide(2 * n(one & two), n(one) + n(two)).alias("dsc"), n(one).alias("volume_atlas"), n(two).alias("volume_labels"))
    whole = label_measures(v.filter(F.col(atlas) > threshold_all).select(*CELL, F.lit(1).cast("long").alias("label")), (), spacing, extents(v))
    shape = whole.agg(F.try_divide(F.sum("surface") ** 3, F.sum("volume") ** 2).alias("compactness"))
    return overlap.crossJoin(F.broadcast(shape))  # one row each


def extracted_labels(v: DataFrame, value: str, label: str = "label", radius: int = 2, padding: int = 5, mask: str | None = None, shape: Sequence[int] | None = None, block: Sequence[int] = (32, 32, 32)) -> DataFrame:
    """``v(z, y, x, label, value)`` -> the box around its labels with ``padding``, moved to the corner, ``value`` 0 beyond ``radius`` voxels of them.

    ``mask``: a column whose voxels that are not 0 stand for the labels in both steps. The
    dilation is a threshold on exact distances in halo blocks and does not reach
    from voxels outside of the box. Rows of label and value 0 are left out; without labels there are no rows.
    """
    shape, on = shape or extents(v), mask or label
    ends = v.filter(F.col(on) != 0).agg(*[f(c).alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()  # one row
    if ends is None or ends[0] is None:
        return v.select(*CELL, label, value).limit(0)
    low = [max(ends[f"{c}_lo"] - padding, 0) for c in CELL]
    size = [min(ends[f"{c}_hi"] + padding + 1, n) - lo for c, n, lo in zip(CELL, shape, low, strict=True)]
    kind = v.schema[label].dataType.simpleString()
    rows = v.select(*[(F.col(c) - lo).cast("int").alias(c) for c, lo in zip(CELL, low, strict=True)], F.col(label).cast("long").alias("_label"), F.col(value).cast("double").alias("_value"), (F.col(on) != 0).cast("int").alias("_on"))

    def run(arrays, corner, core, key):
        near = dilated(arrays["_on"] != 0, radius)[core]
        labels, values = arrays["_label"][core], np.where(near, arrays["_value"][core], 0.0)
        at = np.nonzero((labels != 0) | (values != 0))
        place = [(p + c.start + lo).astype(np.int32) for p, c, lo in zip(at, core, corner, strict=True)]
        return dict(zip((*CELL, "_label", "_value"), [*place, labels[at], values[at]], strict=True))

    out = on_blocks(rows.na.fill(0), {"_label": "i8", "_value": "f8", "_on": "i1"}, size, block, (radius,) * 3, run, "z int, y int, x int, _label long, _value double")
    return out.select(*CELL, F.col("_label").cast(kind).alias(label), F.col("_value").alias(value))
