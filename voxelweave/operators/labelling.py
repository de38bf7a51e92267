"""Connected components of volumes: labelled inside dense blocks, joined over the blocks' faces alone."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .blocks import CELL, extents, on_blocks
from .components import components
from .morphology import filtered

VOXEL, FACE, PROBE, PART = 0, 1, 2, 3


def number(z, y, x):
    """A voxel's number, from which its place can be read back."""
    return z * 2**42 + y * 2**21 + x


def _unnumbered(n: Column) -> list[Column]:
    return [F.shiftright(n, 42).cast("int").alias("z"), F.shiftright(n, 21).bitwiseAND(2**21 - 1).cast("int").alias("y"), n.bitwiseAND(2**21 - 1).cast("int").alias("x")]


def local_components(a: np.ndarray, full: bool) -> np.ndarray:
    """For each voxel of a label other than 0 the first voxel (in order) that it hangs together with; -1 elsewhere.

    Sweeps carry the smallest index along runs of equal labels, axis by axis and back, until nothing changes.
    """
    on = a != 0
    ids = np.where(on, np.arange(a.size).reshape(a.shape), a.size)
    slanted = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) > 1] if full else []
    while True:
        before = ids.copy()
        for axis in range(3):
            m, lab = np.moveaxis(ids, axis, 0), np.moveaxis(a, axis, 0)
            for steps in (range(1, len(m)), range(len(m) - 2, -1, -1)):
                for i in steps:
                    j = i - 1 if steps.step > 0 else i + 1
                    np.minimum(m[i], np.where(lab[i] == lab[j], m[j], a.size), out=m[i])
        for o in slanted:
            to = tuple(slice(max(k, 0), n + min(k, 0)) for k, n in zip(o, a.shape, strict=True))
            of = tuple(slice(max(-k, 0), n + min(-k, 0)) for k, n in zip(o, a.shape, strict=True))
            ids[to] = np.minimum(ids[to], np.where(a[to] == a[of], ids[of], a.size))
        ids[~on] = a.size
        if (ids == before).all():
            return np.where(on, ids, -1)


def _pieces(v: DataFrame, label: str, shape: Sequence[int], size: Sequence[int], full: bool, background: bool) -> DataFrame:
    """(kind, n, id, label, size, open) of every block: voxels, its near faces, what its far faces touch, and its components."""

    def run(arrays, low, core, key):
        a = arrays[label]
        if background:
            a = (a == 0).astype(np.int64)
        ids = local_components(a, full)
        grid = np.indices(a.shape)
        place = number(*[g.astype(np.int64) + lo for g, lo in zip(grid, low, strict=True)])
        own = np.where(ids >= 0, place.ravel()[np.maximum(ids, 0)], -1)
        out = []

        def add(kind, n, i, lab, count=0, is_open=False):
            k = len(n)
            out.append([np.full(k, kind, np.int32), n, i, lab, np.broadcast_to(np.asarray(count, np.int64), k), np.broadcast_to(np.asarray(is_open, bool), k)])

        on = ids >= 0
        add(VOXEL, place[on], own[on], a[on])
        whole, at = np.unique(own[on], return_inverse=True)
        edge = np.zeros(a.shape, bool)
        for axis in range(3):
            first, last = [slice(None)] * 3, [slice(None)] * 3
            first[axis], last[axis] = slice(0, 1), slice(-1, None)
            begin, end = low[axis] == 0, low[axis] + a.shape[axis] == shape[axis]
            if begin:
                edge[tuple(first)] = True
            else:
                f = tuple(first)
                add(FACE, place[f][on[f]], own[f][on[f]], a[f][on[f]])
            if end:
                edge[tuple(last)] = True
            else:
                f = tuple(last)
                sides = [(-1, 0, 1) if full and i != axis else (0,) for i in range(3)]
                sides[axis] = (1,)
                for o in product(*sides):
                    add(PROBE, place[f][on[f]] + number(*o), own[f][on[f]], a[f][on[f]])
        touches = np.bincount(at, edge[on], len(whole)) > 0
        add(PART, whole, whole, np.zeros(len(whole), np.int64), np.bincount(at, minlength=len(whole)), touches)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return dict(zip(("kind", "n", "id", label, "size", "open"), cols, strict=True))

    return cut(on_blocks(v, {label: "i8"}, shape, size, (0, 0, 0), run, f"kind int, n long, id long, {label} long, size long, open boolean"))


def _joined(pieces: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, component) of block components that hang together, and the probes that met no block."""
    face = pieces.filter(F.col("kind") == FACE).select("n", F.col(label).alias("l"), F.col("id").alias("b"))
    probe = pieces.filter(F.col("kind") == PROBE).select("n", F.col(label).alias("l"), F.col("id").alias("a"))
    links = probe.join(face, ["n", "l"]).select("a", "b").distinct()
    return cut(components(links)), probe


def labelled(v: DataFrame, label: str = "label", full: bool = True, size: Sequence[int] = (32, 64, 64), shape: Sequence[int] | None = None) -> DataFrame:
    """Components of equal label: (z, y, x, label, component, size), named by their smallest voxel number; corners connect if ``full``.

    Blocks label their own voxels; only their faces are joined, so what is
    shuffled and iterated grows with the surface of blocks and not with all neighbour pairs.
    Labels of 0 and places without a row are left out.
    """
    pieces = _pieces(v.filter(F.col(label) != 0), label, shape or extents(v), size, full, False)
    named, _ = _joined(pieces, label)
    whole = pieces.filter(F.col("kind") == PART).select("id", "size").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "size")
    whole = cut(whole)
    sizes = whole.groupBy("component").agg(F.sum("size").alias("size"))
    of = whole.drop("size").join(sizes, "component")
    return pieces.filter(F.col("kind") == VOXEL).select("n", "id", label).join(of, "id").select(*_unnumbered(F.col("n")), label, "component", "size")


def holes(v: DataFrame, most: int, size: Sequence[int] = (32, 64, 64), shape: Sequence[int] | None = None) -> DataFrame:
    """Places of ``(z, y, x, on)`` that are not ``on`` but enclosed: face-connected, off the volume's faces and at most ``most`` voxels together.

    ``most`` must be under the voxels of a block, as a hole next to a block without any row counts as open.
    """
    if most >= size[0] * size[1] * size[2]:
        raise ValueError("holes are smaller than a block")
    pieces = _pieces(v.select(*CELL, F.col("on").cast("long").alias("on")), "on", shape or extents(v), size, False, True)
    named, probe = _joined(pieces, "on")
    # a far face with no block behind it is open; so is a near face that no probe of a block reaches
    face = pieces.filter(F.col("kind") == FACE).select("n", F.col("id").alias("b"))
    near = probe.select("n").distinct()
    there = pieces.filter(F.col("kind") == VOXEL).select(F.col("n"))
    blocks = lambda t: t.withColumns({f"_b{i}": F.floor(c / s) for i, (c, s) in enumerate(zip(_unnumbered(F.col("n")), size, strict=True))})
    full = v.select(*CELL).withColumn("n", number(*[F.col(c).cast("long") for c in CELL])).select("n")
    have = cut(blocks(full.unionByName(there)).select("_b0", "_b1", "_b2").distinct())
    open_far = blocks(probe.select("n", F.col("a").alias("id"))).join(have, ["_b0", "_b1", "_b2"], "left_anti").select("id")
    open_near = face.join(near, "n", "left_anti").select(F.col("b").alias("id"), "n")
    back = None
    for i in range(3):  # the block before, on each axis where the voxel is on a near face
        at = blocks(open_near).withColumn("_on", F.pmod(_unnumbered(F.col("n"))[i], F.lit(size[i])) == 0).filter(F.col("_on") & (F.col(f"_b{i}") > 0)).withColumn(f"_b{i}", F.col(f"_b{i}") - 1)
        one = at.join(have, ["_b0", "_b1", "_b2"], "left_anti").select("id")
        back = one if back is None else back.unionByName(one)
    wide = open_far.unionByName(back).distinct().withColumn("_wide", F.lit(True))
    part = pieces.filter(F.col("kind") == PART).select("id", "size", "open").join(wide, "id", "left").join(named, "id", "left")
    part = cut(part.select("id", "size", (F.col("open") | F.coalesce("_wide", F.lit(False))).alias("open"), F.coalesce("component", "id").alias("component")))
    closed = part.groupBy("component").agg(F.sum("size").alias("size"), F.max("open").alias("open")).filter(~F.col("open") & (F.col("size") <= most))
    inside = part.select("id", "component").join(closed.select("component"), "component", "left_semi").select("id")
    return pieces.filter(F.col("kind") == VOXEL).join(inside, "id", "left_semi").select(*_unnumbered(F.col("n")))


def carved(v: DataFrame, value: str, threshold: float | None = None, most: int = 5000, size: Sequence[int] = (32, 64, 64)) -> DataFrame:
    """The foreground over a threshold (the mean of all rows unless given) with its small holes filled: (z, y, x, value), value null in holes without a row."""
    if threshold is None:
        threshold = v.agg(F.avg(value)).first()[0]
    shape = extents(v)
    marked = v.select(*CELL, value, F.coalesce(F.col(value) > F.lit(threshold), F.lit(False)).cast("int").alias("on"))
    filled = holes(marked.select(*CELL, "on"), most, size, shape).withColumn("_hole", F.lit(True))
    both = marked.join(filled, list(CELL), "full_outer")
    return both.filter((F.col("on") == 1) | F.col("_hole")).select(*CELL, value)


def components_over(v: DataFrame, value: str, threshold: float, least: int = 200, full: bool = True) -> DataFrame:
    """Components of the voxels over a threshold with at least ``least`` voxels: component, size, its box and centre, largest first by ``rank``."""
    found = labelled(v.filter(F.col(value) > threshold).select(*CELL, F.lit(1).cast("long").alias("label")), "label", full, shape=extents(v))
    boxes = found.filter(F.col("size") >= least).groupBy("component", "size").agg(*[f(c).alias(f"{c}_{n}") for c in CELL for n, f in (("min", F.min), ("max", F.max), ("mid", F.avg))])
    return boxes


def cropped_to_original(new: DataFrame, original: DataFrame, radius: int, block: Sequence[int] = (32, 32, 32), label: str = "label") -> DataFrame:
    """Labels become 0 where the background of ``original``, opened by a ball of ``radius`` (0: as it is), lies."""
    both = new.select(*CELL, F.col(label).cast("long").alias(label)).join(original.filter(F.col(label) != 0).select(*CELL, F.lit(1).cast("long").alias("_was")), list(CELL), "full_outer")
    shape = extents(both)

    def run(arrays, low, core, key):
        clear = filtered(arrays["_was"] == 0, radius, "opening")[core]
        a = np.where(clear, 0, arrays[label][core])
        z, y, x = np.nonzero(a)
        place = [(p + c.start + lo).astype(np.int32) for p, c, lo in zip((z, y, x), core, low, strict=True)]
        return dict(zip((*CELL, label), [*place, a[z, y, x]], strict=True))

    rows = both.select(*CELL, F.coalesce(label, F.lit(0)).alias(label), F.coalesce("_was", F.lit(0)).alias("_was"))
    return on_blocks(rows, {label: "i8", "_was": "i8"}, shape, block, (2 * radius + 1,) * 3, run, f"z int, y int, x int, {label} long")
