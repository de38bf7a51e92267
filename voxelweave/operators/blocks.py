"""Dense blocks of a voxel table with a halo: the one shuffle behind filters, detection and morphology.

A volume is a table of voxels, one row a place; places without a row have the
value 0. A block is a box of ``size`` voxels; with its halo it holds all that a
filter of that reach needs, so results don't depend on the size of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import partitions

CELL = ("z", "y", "x")
BLOCK = ("block_z", "block_y", "block_x")
#: Voxels of a stored table for one task.
ROWS = 2**20
#: Places of a block whose voxels are one row of lists.
RUN = 2**12

#: A function of a block: the arrays of its values by name, the place of their first voxel, and where the core lies in them.
Work = Callable[[dict[str, np.ndarray], tuple[int, int, int], tuple[slice, slice, slice], tuple], dict[str, np.ndarray]]


def extents(v: DataFrame, axes: Sequence[str] = CELL) -> tuple[int, int, int]:
    """One past the largest place on each axis; 0 without voxels."""
    ends = v.agg(*[F.max(c).alias(c) for c in axes]).first()
    return tuple(int(e) + 1 if e is not None else 0 for e in ends)


def fitted(shape: Sequence[int], voxels: int = 2**17) -> tuple[int, int, int]:
    """A block of about ``voxels``, long where the volume is thin, so that halos copy little."""
    size, left = [1, 1, 1], float(voxels)
    for rest, i in zip((3, 2, 1), sorted(range(3), key=lambda i: shape[i]), strict=True):
        size[i] = max(min(shape[i], int(left ** (1 / rest))), 1)
        left /= size[i]
    return tuple(size)


def in_blocks(v: DataFrame, shape: Sequence[int], size: Sequence[int], halo: Sequence[int]) -> DataFrame:
    """Each voxel with every block that holds it in its core or its halo."""
    for c, b, n, s, h in zip(CELL, BLOCK, shape, size, halo, strict=True):
        last = max(n - 1, 0) // s
        if last == 0:
            v = v.withColumn(b, F.lit(0))
            continue
        first = F.greatest(F.floor((F.col(c) - h) / s), F.lit(0)).cast("int")
        v = v.withColumn(b, F.explode(F.sequence(first, F.least(F.floor((F.col(c) + h) / s), F.lit(last)).cast("int"))))
    return v


def dealt(v: DataFrame) -> int:
    """Partitions for the blocks of a stored table, so that a task's share stays the same however many voxels there are; 0 for the session's setting."""
    n = v.count() // ROWS
    return max(n + 1, partitions(v.sparkSession)) if n else 0


def block_tasks(spark: SparkSession, shape: Sequence[int], size: Sequence[int], each: int = 4, most: int = 4096) -> int:
    """Partitions for about ``each`` blocks a task, where that is more than the session's setting; 0 for that one."""
    n = -(-math.prod(max(-(-n // s), 1) for n, s in zip(shape, size, strict=True)) // each)
    return min(n, most) if n > partitions(spark) else 0


def on_blocks(v: DataFrame, values: dict[str, str], shape: Sequence[int], size: Sequence[int], halo: Sequence[int], work: Work, schema: str, keys: Sequence[str] = (), parts: int = 0, lists: bool = False) -> DataFrame:
    """``work`` on every block that has a voxel; ``values``: column -> NumPy type of its array.

    Rows outside of ``shape`` are ignored. ``work`` also gets the group's ``keys``, which
    stand first in ``schema``; it returns columns of equal length. A task holds
    one block of (size + 2 halo) voxels at a time. ``parts``: partitions of the shuffle, the session's if 0. Its rows
    are narrow: a block's number and the place within it are one number each. ``lists``: after the shuffle, voxels of ``RUN`` places
    are one row of lists, which costs less than a row each on the way to Python where voxels lie close; nulls are 0 then.
    """
    inside = F.lit(True)
    for c, n in zip(CELL, shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    names = list(values)
    many = [max(-(-n // s), 1) for n, s in zip(shape, size, strict=True)]
    widths = [min(s + 2 * h, max(n, 1)) for s, h, n in zip(size, halo, shape, strict=True)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds = [table.schema.field(k).type for k in keys]
        key = tuple(k.as_py() for k in key)
        at = [int(i) for i in np.unravel_index(key[-1], many)]
        low = [max(b * s - h, 0) for b, s, h in zip(at, size, halo, strict=True)]
        high = [min((b + 1) * s + h, n) for b, s, h, n in zip(at, size, halo, shape, strict=True)]
        core = tuple(slice(b * s - lo, min((b + 1) * s, n) - lo) for b, s, lo, n in zip(at, size, low, shape, strict=True))
        if lists:
            table = pa.table({name: table.column(name).combine_chunks().flatten() for name in ("_place", *names)})
        place = np.unravel_index(table.column("_place").to_numpy(), widths)
        arrays = {}
        for name in names:
            arrays[name] = np.zeros([hi - lo for lo, hi in zip(low, high, strict=True)], values[name])
            arrays[name][place] = np.nan_to_num(table.column(name).to_numpy(zero_copy_only=False).astype(values[name])) if values[name].startswith("f") else table.column(name).to_numpy(zero_copy_only=False)
        out = work(arrays, tuple(low), core, key[: len(keys)])
        n = len(next(iter(out.values())))
        return pa.table({k: pa.array([x] * n, kind) for k, x, kind in zip(keys, key, kinds, strict=False)} | {k: pa.array(x) for k, x in out.items()})

    rows = in_blocks(v.filter(inside).select(*keys, *CELL, *names), shape, size, halo)
    block = place = F.lit(0).cast("long")
    for c, b, n, s, h, w in zip(CELL, BLOCK, many, size, halo, widths, strict=True):
        block = block * n + F.col(b)
        place = place * w + F.col(c) - F.greatest(F.col(b).cast("long") * s - h, F.lit(0))
    rows = rows.select(*keys, block.alias("_block"), place.cast("long").alias("_place"), *names)
    if parts or lists:
        rows = rows.repartition(parts or partitions(v.sparkSession), *keys, "_block")
    if lists:
        rows = rows.groupBy(*keys, "_block", F.floor(F.col("_place") / RUN).alias("_run")).agg(F.collect_list("_place").alias("_place"), *[F.collect_list(F.coalesce(c, F.lit(0))).alias(c) for c in names])
    return rows.groupBy(*keys, "_block").applyInArrow(run, schema)


def correlated(a: np.ndarray, taps: np.ndarray, axis: int, mode: str) -> np.ndarray:
    """``taps`` along an axis; ``mode`` of ``numpy.pad`` beyond the ends."""
    r = len(taps) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    wide = np.pad(a, pad, mode=mode)
    out = np.zeros_like(a)
    for i, t in enumerate(taps.tolist()):
        index = [slice(None)] * a.ndim
        index[axis] = slice(i, i + a.shape[axis])
        out += t * wide[tuple(index)]
    return out


def reach(sigma: float) -> int:
    """Voxels to each side of a Gaussian's kernel: four deviations."""
    return int(4.0 * sigma + 0.5)


def gaussian_taps(sigma: float, order: int = 0) -> np.ndarray:
    """A sampled Gaussian of sum 1, or its second derivative."""
    x = np.arange(-reach(sigma), reach(sigma) + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    return g if order == 0 else (x**2 / sigma**4 - 1 / sigma**2) * g


def blurred(a: np.ndarray, sigma: float, mode: str = "edge") -> np.ndarray:
    for axis in range(a.ndim):
        a = correlated(a, gaussian_taps(sigma), axis, mode)
    return a


def widened(a: np.ndarray, axis: int, low: int, high: int) -> np.ndarray:
    """``a`` from ``low`` to ``high`` on an axis, mirrored beyond its ends."""
    n = a.shape[axis]
    if 0 <= low and high <= n:
        return a[(slice(None),) * axis + (slice(low, high),)]
    at = np.arange(low, high) % (2 * n)
    return np.take(a, np.where(at < n, at, 2 * n - 1 - at), axis)


def folded(wide: np.ndarray, axis: int, kernels: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``wide`` filtered along an axis by symmetric kernels of one length, where they lie in it whole.

    Kernels share the sums of mirrored places. Sums run from the middle outwards, so a place's
    value is the same to the last bit wherever in an array it lies.
    """
    r = len(kernels[0]) // 2
    n = wide.shape[axis] - 2 * r
    at = lambda i: wide[(slice(None),) * axis + (slice(r + i, r + i + n),)]
    out = [at(0) * k[r] for k in kernels]
    pair, part = np.empty_like(out[0]), np.empty_like(out[0])
    for i in range(1, r + 1):
        np.add(at(-i), at(i), out=pair)
        for o, k in zip(out, kernels, strict=True):
            np.multiply(pair, k[r + i], out=part)
            o += part
    return out


def laplacian(a: np.ndarray, sigma: float, within: Sequence[slice]) -> np.ndarray:
    """The Laplacian of the blurred array at the places ``within``; the array is mirrored beyond its ends."""
    r, g, d = reach(sigma), gaussian_taps(sigma), gaussian_taps(sigma, 2)
    wide = lambda x, axis: widened(x, axis, within[axis].start - r, within[axis].stop + r)
    flat, curved = folded(wide(a, 0), 0, (g, d))
    flat, rest = folded(wide(flat, 1), 1, (g, d))
    rest += folded(wide(curved, 1), 1, (g,))[0]
    (out,), (rest,) = folded(wide(flat, 2), 2, (d,)), folded(wide(rest, 2), 2, (g,))
    out += rest
    return out


def squared_distances(on: np.ndarray, most: int) -> np.ndarray:
    """Squared Euclidean distance from every voxel to the nearest of ``on``, exact up to ``most``; more beyond it.

    Passes along one axis after another, each the lower envelope of parabolas
    within reach.
    """
    far = np.int32((most + 1) ** 2)
    d = np.where(on, np.int32(0), far)
    for axis in range(on.ndim):
        best = d.copy()
        for k in range(1, min(most, on.shape[axis] - 1) + 1):
            ahead, behind = [slice(None)] * on.ndim, [slice(None)] * on.ndim
            ahead[axis], behind[axis] = slice(k, None), slice(None, -k)
            np.minimum(best[tuple(behind)], d[tuple(ahead)] + k * k, out=best[tuple(behind)])
            np.minimum(best[tuple(ahead)], d[tuple(behind)] + k * k, out=best[tuple(ahead)])
        d = best
    return d


def nearest_places(on: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every voxel the squared distance to the nearest of ``on`` and that one's flat place (of equally near ones the first); exact up to ``most``.

    Distance and place are one number, so passes along one axis after another keep the least of both.
    """
    far = 4 * (most + 1) ** 2
    d = np.where(on, np.arange(on.size).reshape(on.shape), np.int64(far) * on.size)
    for axis in range(on.ndim):
        best = d.copy()
        for k in range(1, min(most, on.shape[axis] - 1) + 1):
            ahead, behind = [slice(None)] * on.ndim, [slice(None)] * on.ndim
            ahead[axis], behind[axis] = slice(k, None), slice(None, -k)
            step = k * k * on.size
            np.minimum(best[tuple(behind)], d[tuple(ahead)] + step, out=best[tuple(behind)])
            np.minimum(best[tuple(ahead)], d[tuple(behind)] + step, out=best[tuple(ahead)])
        d = best
    return d // max(on.size, 1), d % max(on.size, 1)
