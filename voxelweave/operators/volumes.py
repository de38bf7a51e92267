"""Labelled volumes as voxel tables: tiles, edges, shells, surfaces, components and distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .blocks import fitted, nearest_places, on_blocks, squared_distances
from .components import components
from .points import near_pairs, squared

CELL = ["z", "y", "x"]
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def _neighbours(v: DataFrame, columns: Sequence[str], offsets: Sequence[tuple[int, int, int]] = FACES) -> DataFrame:
    """A row per voxel and offset: the neighbour's place, and the voxel's own columns."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip(CELL, o, strict=True)]) for o in offsets])
    e = v.select(*CELL, *columns, F.explode(steps).alias("o"))
    return e.select(*[F.col(c).alias(f"{c}0") for c in CELL], *columns, *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in CELL])


def tiles(v: DataFrame, size: Sequence[int], overlap: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """Each voxel with every tile that holds it; a tile reaches past its far side by the overlap."""
    for c, s, o, n in zip(CELL, size, overlap, shape, strict=True):
        last = F.least(F.floor(F.col(c) / s), F.lit((n - 1) // s)).cast("int")
        first = F.greatest(F.ceil((F.col(c) - (s + o) + 1) / s), F.lit(0)).cast("int")
        v = v.withColumn(f"tile_{c}", F.explode(F.sequence(first, last)))
    return v


def merged_tiles(t: DataFrame, size: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """The voxels that their owning tile holds: the inverse of ``tiles``."""
    for c, s, n in zip(CELL, size, shape, strict=True):
        t = t.filter(F.col(f"tile_{c}") == F.least(F.floor(F.col(c) / s), F.lit((n - 1) // s))).drop(f"tile_{c}")
    return t


def edges(v: DataFrame, label: str = "label") -> DataFrame:
    """Labelled voxels of which a face neighbour in the volume has another label."""
    own = v.filter(F.col(label) != 0).select(*CELL, F.col(label).alias("_l"))
    near = _neighbours(own, ["_l"]).join(v.select(*CELL, F.col(label).alias("_m")), CELL)
    return near.filter("_l <> _m").select(*[F.col(f"{c}0").alias(c) for c in CELL], F.col("_l").alias(label)).distinct()


def shell(v: DataFrame) -> DataFrame:
    """Places next to the voxels by a face that are not among them."""
    return _neighbours(v, []).select(*CELL).distinct().join(v.select(*CELL).distinct(), CELL, "left_anti")


def surface(v: DataFrame, label: str = "label", spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Area of the voxel faces of each label that its own voxels do not cover."""
    sz, sy, sx = spacing
    area = F.when(F.col("z") != F.col("z0"), sy * sx).when(F.col("y") != F.col("y0"), sz * sx).otherwise(sz * sy)
    own = v.filter(F.col(label) != 0).select(*CELL, label)
    open_faces = _neighbours(own, [label]).join(own, [*CELL, label], "left_anti")
    return open_faces.groupBy(label).agg(F.sum(area).alias("surface"))


def compactness(v: DataFrame, label: str = "label") -> DataFrame:
    """surface ** 3 / volume ** 2 of each label."""
    n = v.filter(F.col(label) != 0).groupBy(label).agg(F.count("*").alias("volume"))
    return surface(v, label).join(n, label).withColumn("compactness", F.col("surface") ** 3 / F.col("volume") ** 2)


def connected(v: DataFrame, label: str = "label", full: bool = True) -> DataFrame:
    """Components of equal label: (z, y, x, label, component, size); corners connect if ``full``."""
    half = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0) and (full or abs(a) + abs(b) + abs(c) == 1)]
    number = lambda p: (F.col(f"z{p}").cast("long") * 2**42 + F.col(f"y{p}").cast("long") * 2**21 + F.col(f"x{p}").cast("long"))
    own = cut(v.filter(F.col(label) != 0).select(*CELL, label))
    links = _neighbours(own, [label], half).join(own, [*CELL, label]).select(number("0").alias("a"), number("").alias("b"))
    named = components(links)
    out = own.withColumn("id", number("")).join(named, "id", "left").select(*CELL, label, F.coalesce("component", "id").alias("component"))
    out = cut(out)
    return out.join(out.groupBy("component").agg(F.count("*").alias("size")), "component")


def eroded(v: DataFrame, label: str, radius: int = 1) -> DataFrame:
    """Voxels whose whole ball of ``radius`` has their label, a whole number, in halo blocks; rows that repeat a place are an error of the table."""
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    own = v.filter(F.col(label) != 0).select(*CELL, label)
    kinds = {c: own.schema[c].dataType for c in (*CELL, label)}
    ends = own.agg(*[f(c).cast("long").alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()  # one row
    if ends[0] is None:
        return own.limit(0)
    low = [ends[f"{c}_lo"] for c in CELL]
    shape = [ends[f"{c}_hi"] - lo + 1 for c, lo in zip(CELL, low, strict=True)]

    def run(arrays, corner, core, key):
        here, wide = arrays["_label"][core], np.pad(arrays["_label"], radius)
        kept = here != 0
        for o in ball:
            kept &= wide[tuple(slice(s.start + radius + d, s.stop + radius + d) for s, d in zip(core, o, strict=True))] == here
        at = np.nonzero(kept)
        return {c: (p + s.start + lo).astype(np.int32) for c, p, s, lo in zip(CELL, at, core, corner, strict=True)} | {"_label": here[at]}

    rows = own.select(*[(F.col(c) - lo).cast("int").alias(c) for c, lo in zip(CELL, low, strict=True)], F.col(label).cast("long").alias("_label"))
    found = on_blocks(rows, {"_label": "i8"}, shape, fitted(shape), (radius,) * 3, run, "z int, y int, x int, _label long")
    return found.select(*[(F.col(c).cast("long") + lo).cast(kinds[c]).alias(c) for c, lo in zip(CELL, low, strict=True)], F.col("_label").cast(kinds[label]).alias(label))


def dilated(v: DataFrame, radius: int = 1) -> DataFrame:
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    return _neighbours(v, [], ball).select(*CELL).distinct()


def nearest_voxel(a: DataFrame, b: DataFrame, radius: float = 2.0, carry: Sequence[str] = (), reach: int = 16) -> DataFrame:
    """For each voxel of ``a`` the distance to the nearest of ``b``, and that one's columns ``carry`` (ties by place); null if ``b`` is empty.

    Halo blocks find those within ``reach`` (or ``radius`` up to 32). For the rest the radius doubles until it spans both sets.
    """
    every = a.select(*CELL, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*CELL, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    both = cut(every.groupBy(*CELL).agg(F.max("_a").cast("byte").alias("_a"), F.max("_b").cast("byte").alias("_b")))
    ends = both.agg(F.max("_b").alias("b"), *[f(c).cast("long").alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()  # one row
    if not ends["b"]:
        return both.filter("_a = 1").select(*CELL, F.lit(None).cast("double").alias("dist"), *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in carry])
    low = [ends[f"{c}_lo"] for c in CELL]
    shape = [ends[f"{c}_hi"] - lo + 1 for c, lo in zip(CELL, low, strict=True)]
    most = min(max(int(radius), reach), 32)

    def run(arrays, corner, core, key):
        d, place = nearest_places(arrays["_b"] != 0, most)
        at = np.nonzero(arrays["_a"][core])
        own = [(p + c.start + lo).astype(np.int32) for p, c, lo in zip(at, core, corner, strict=True)]
        d, place = d[core][at], np.unravel_index(place[core][at], arrays["_b"].shape)
        near = [(p + lo).astype(np.int32) for p, lo in zip(place, corner, strict=True)]
        return dict(zip((*CELL, "_d", *(f"_{c}" for c in CELL)), [*own, np.where(d <= most * most, d, -1).astype(np.int64), *near], strict=True))

    moved = both.select(*[(F.col(c) - lo).cast("int").alias(c) for c, lo in zip(CELL, low, strict=True)], "_a", "_b")
    found = cut(on_blocks(moved, {"_a": "i1", "_b": "i1"}, shape, fitted(shape), (most,) * 3, run, "z int, y int, x int, _d long, _z int, _y int, _x int"))
    kinds = {c: both.schema[c].dataType for c in CELL}
    back = lambda c, lo, of: (F.col(of).cast("long") + lo).cast(kinds[c])
    out = found.filter("_d >= 0").select(*[back(c, lo, c).alias(c) for c, lo in zip(CELL, low, strict=True)], F.sqrt(F.col("_d").cast("double")).alias("dist"), *[back(c, lo, f"_{c}").alias(f"_{c}") for c, lo in zip(CELL, low, strict=True)])
    todo, radius, far = cut(found.filter("_d < 0").select(*[back(c, lo, c).alias(c) for c, lo in zip(CELL, low, strict=True)])), 2.0 * most, sum(n * n for n in shape) ** 0.5
    there = both.filter("_b = 1").select(*CELL)
    while not todo.isEmpty():
        pairs = near_pairs(todo, there, (radius,) * 3).withColumn("d", F.sqrt(squared())).filter(F.col("d") <= radius)
        near = F.min(F.struct("d", *[f"{c}_b" for c in CELL])).alias("_m")
        best = cut(pairs.groupBy(*[F.col(f"{c}_a").alias(c) for c in CELL]).agg(near).select(*CELL, F.col("_m.d").alias("dist"), *[F.col(f"_m.{c}_b").alias(f"_{c}") for c in CELL]))
        out = out.unionByName(best)
        todo = cut(todo.join(best, CELL, "left_anti"))
        if radius > far:
            break
        radius *= 2
    if not carry:
        return out.select(*CELL, "dist")
    held = b.groupBy(*[F.col(c).alias(f"_{c}") for c in CELL]).agg(F.min(F.struct(*carry)).alias("_c"))
    return out.join(held, [f"_{c}" for c in CELL]).select(*CELL, "dist", *[F.col(f"_c.{c}").alias(c) for c in carry])


def mirrored(v: DataFrame, axis: str, middle: int, sign: int = -1, label: str = "label") -> DataFrame:
    """The half before ``middle`` and its mirror image, whose labels are multiplied by ``sign``."""
    half = v.filter(F.col(axis) < middle)
    return half.unionByName(half.withColumn(axis, F.lit(2 * middle - 1) - F.col(axis)).withColumn(label, F.col(label) * sign))


def asymmetric(v: DataFrame, axis: str, middle: int, sign: int = -1, label: str = "label") -> DataFrame:
    """Voxels whose mirror image lacks the label times ``sign``."""
    image = v.select(*[F.lit(2 * middle - 1).__sub__(F.col(c)).alias(c) if c == axis else F.col(c) for c in CELL], (F.col(label) * sign).alias(label))
    return v.select(*CELL, label).join(image, [*CELL, label], "left_anti")


def turned(v: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """A quarter turn in the plane of two axes."""
    return v.withColumns({a: F.col(b), b: F.lit(size - 1) - F.col(a)})


def flipped(v: DataFrame, axis: str, size: int) -> DataFrame:
    """The axis reversed."""
    return v.withColumn(axis, F.lit(size - 1) - F.col(axis))


def transposed(v: DataFrame, a: str, b: str) -> DataFrame:
    """Two axes swapped."""
    return v.withColumns({a: F.col(b), b: F.col(a)})


def truncated(v: DataFrame, bounds: dict[str, tuple[float, float]], shape: dict[str, int], label: str = "label") -> DataFrame:
    """Labels beyond the fractional bounds of any axis become 0."""
    inside = F.lit(True)
    for c, (low, high) in bounds.items():
        inside = inside & (F.col(c) >= int(low * shape[c])) & (F.col(c) < int(high * shape[c]))
    return v.withColumn(label, F.when(inside, F.col(label)).otherwise(0))


def cropped(v: DataFrame, offset: Sequence[int], size: Sequence[int], border: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """The half-open box with its border on both sides, moved to the origin."""
    for c, o, n, b in zip(CELL, offset, size, border, strict=True):
        v = v.filter((F.col(c) >= o - b) & (F.col(c) < o + n + b))
    return v.withColumns({c: F.col(c) - max(o - b, 0) for c, o, b in zip(CELL, offset, border, strict=True)})


def cropped_to_labels(v: DataFrame, padding: int = 0, label: str = "label") -> DataFrame:
    """The box around all labelled voxels with padding, within the volume, moved to its corner."""
    ends = v.filter(F.col(label) != 0).agg(*[f(c).alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))])
    d = v.crossJoin(F.broadcast(ends))  # one row
    for c in CELL:
        d = d.filter(F.col(c).between(F.col(f"{c}_lo") - padding, F.col(f"{c}_hi") + padding))
    return d.select(*[(F.col(c) - F.greatest(F.col(f"{c}_lo") - padding, F.lit(0))).alias(c) if c in CELL else F.col(c) for c in v.columns])


def without_leading_planes(v: DataFrame, axis: str, label: str = "label") -> DataFrame:
    """Planes before the first that has a label are dropped."""
    first = v.filter(F.col(label) != 0).agg(F.min(axis).alias("_first"))
    return v.crossJoin(F.broadcast(first)).filter(F.col(axis) >= F.col("_first")).drop("_first")  # one row


def placed(v: DataFrame, other: DataFrame, offset: Sequence[int], value: str) -> DataFrame:
    """``other``, moved by ``offset``, overwrites the voxels of ``v`` that it covers; beyond ``v`` it is cut off."""
    there = other.select(*[(F.col(c) + o).cast("int").alias(c) for c, o in zip(CELL, offset, strict=True)], F.col(value).alias("_new"))
    return v.join(there, CELL, "left").withColumn(value, F.coalesce("_new", value)).select(*v.columns)


def masked(v: DataFrame, mask: DataFrame, label: str = "label") -> DataFrame:
    """Labels become 0 where ``mask`` has no voxel."""
    on = mask.select(*CELL, F.lit(True).alias("_on")).distinct()
    return v.join(on, CELL, "left").withColumn(label, F.when(F.col("_on"), F.col(label)).otherwise(0)).select(*v.columns)


def combined_masks(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Places of two voxel sets: ``and``, ``or``, ``xor`` or ``not`` (the first without the second)."""
    both = a.select(*CELL, F.lit(1).alias("n")).distinct().unionByName(b.select(*CELL, F.lit(2).alias("n")).distinct()).groupBy(*CELL).agg(F.sum("n").alias("n"))
    return both.filter({"and": "n = 3", "or": "n >= 1", "xor": "n <> 3", "not": "n = 1"}[how]).select(*CELL)


def mask_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(how, n): the number of places of each of ``combined_masks``, from one grouping of both sets."""
    each = a.select(*CELL, F.lit(1).alias("one"), F.lit(0).alias("two")).unionByName(b.select(*CELL, F.lit(0).alias("one"), F.lit(1).alias("two")))
    kinds = each.groupBy(*CELL).agg(F.max("one").alias("one"), F.max("two").alias("two")).groupBy("one", "two").agg(F.count("*").alias("n"))
    n = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    one, two = F.col("one") == 1, F.col("two") == 1
    row = kinds.agg(n(one & two).alias("and"), n(one | two).alias("or"), n(one != two).alias("xor"), n(one & ~two).alias("not"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("how"), F.col(c).alias("n")) for c in row.columns])).alias("r")).select("r.*")


def opened(v: DataFrame, radius: int = 1, label: str = "label") -> DataFrame:
    """Erosion and then dilation of each label; a voxel that several labels reach takes the smallest."""
    return _grown(eroded(v, label, radius), radius, label)


def _grown(v: DataFrame, radius: int, label: str) -> DataFrame:
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    return _neighbours(v, [label], ball).groupBy(*CELL).agg(F.min(label).alias(label))


def closed(v: DataFrame, radius: int = 1) -> DataFrame:
    """Dilation and then erosion of a voxel set, in halo blocks; places beyond the volume are as others."""
    kinds = {c: v.schema[c].dataType for c in CELL}
    ends = v.agg(*[f(c).cast("long").alias(f"{c}_{n}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()  # one row
    if ends[0] is None:
        return v.select(*CELL).limit(0)
    low = [ends[f"{c}_lo"] - 2 * radius for c in CELL]
    shape = [ends[f"{c}_hi"] - lo + 1 + 2 * radius for c, lo in zip(CELL, low, strict=True)]

    def run(arrays, corner, core, key):
        wide = squared_distances(arrays["_on"] != 0, radius) <= radius * radius
        kept = wide & (squared_distances(~wide, radius) > radius * radius)
        at = np.nonzero(kept[core])
        return {c: (p + s.start + lo).astype(np.int32) for c, p, s, lo in zip(CELL, at, core, corner, strict=True)}

    rows = v.select(*[(F.col(c) - lo).cast("int").alias(c) for c, lo in zip(CELL, low, strict=True)], F.lit(1).cast("byte").alias("_on"))
    found = on_blocks(rows, {"_on": "i1"}, shape, fitted(shape), (2 * radius,) * 3, run, "z int, y int, x int")
    return found.select(*[(F.col(c).cast("long") + lo).cast(kinds[c]).alias(c) for c, lo in zip(CELL, low, strict=True)])


def in_painted(v: DataFrame, label: str = "label") -> DataFrame:
    """Voxels without a label take that of the nearest labelled voxel (ties by place); all stay if there is none."""
    v = cut(v)
    own = v.filter(F.col(label) != 0)
    fill = nearest_voxel(v.filter(F.col(label) == 0), own.select(*CELL, F.col(label).alias("_near")), carry=["_near"])
    return v.join(fill.drop("dist"), CELL, "left").withColumn(label, F.coalesce("_near", label)).select(*v.columns)


def largest(named: DataFrame, label: str = "label") -> DataFrame:
    """Of ``connected``: the largest component of each label (the smaller number of equals)."""
    top = named.groupBy(label).agg(F.max(F.struct("size", (-F.col("component")).alias("_c"))).alias("_t")).select(label, (-F.col("_t._c")).alias("component"))
    return named.join(top, [label, "component"])


def zero_crossings(v: DataFrame, value: str) -> DataFrame:
    """Voxels with a face neighbour of the other sign."""
    near = _neighbours(v.select(*CELL, F.signum(value).alias("_s")), ["_s"]).join(v.select(*CELL, F.signum(value).alias("_m")), CELL)
    return near.filter("_s * _m < 0").select(*[F.col(f"{c}0").alias(c) for c in CELL]).distinct()


def erosion_table(v: DataFrame, radii: Sequence[int], least: float, label: str = "label") -> DataFrame:
    """Per label: size, and the largest of ``radii`` (descending) whose erosion keeps over ``least`` of it, with that size; else radius 0."""
    out = v.filter(F.col(label) != 0).groupBy(label).agg(F.count("*").alias("size"))
    for r in radii:
        out = out.join(eroded(v, label, r).groupBy(label).agg(F.count("*").alias(f"_{r}")), label, "left")
    pick = F.coalesce(*[F.when(F.col(f"_{r}") > least * F.col("size"), F.struct(F.lit(r).alias("radius"), F.col(f"_{r}").alias("kept"))) for r in radii], F.struct(F.lit(0).alias("radius"), F.col("size").alias("kept")))
    return out.select(label, "size", pick.alias("p")).select(label, "size", "p.radius", "p.kept")


def painted(points: DataFrame, radius: int) -> DataFrame:
    """Voxels of the balls around points, each with the greatest point id."""
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    cells = points.select(*[F.col(c).cast("int").alias(c) for c in CELL], "blob_id")
    return _neighbours(cells, ["blob_id"], ball).groupBy(*CELL).agg(F.max("blob_id").alias("blob_id"))
