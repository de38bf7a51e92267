"""Block-wise components, holes and crops against plain NumPy on whole volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import labelling as lb
from voxelweave.operators import morphology as m


def table(spark, a, name, kind):
    return spark.createDataFrame([(*map(int, p), a[tuple(p)].item()) for p in np.argwhere(a != 0)], f"z int, y int, x int, {name} {kind}")


def flood(a, full):
    """Component of each place by a stack: the smallest (z, y, x) of those of equal label it hangs together with."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (abs(i) + abs(j) + abs(k) == 1 or full) and (i, j, k) != (0, 0, 0)]
    out = {}
    for p in map(tuple, np.argwhere(np.ones(a.shape, bool)).tolist()):
        if p in out:
            continue
        group, stack = [p], [p]
        out[p] = p
        while stack:
            q = stack.pop()
            for o in steps:
                r = tuple(x + y for x, y in zip(q, o, strict=True))
                if all(0 <= x < n for x, n in zip(r, a.shape, strict=True)) and r not in out and a[r] == a[q]:
                    out[r] = p
                    group.append(r)
                    stack.append(r)
    return out


@pytest.fixture(scope="module")
def volume():
    rng = np.random.default_rng(7)
    a = (rng.random((14, 15, 16)) < 0.35).astype(np.int64) * rng.integers(1, 3, (14, 15, 16))
    a[2, 2, :] = 3  # long ones over many blocks, and a spiral
    a[2, 2:12, 15] = 3
    a[2:12, 11, 15] = 3
    return a


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("size", [(4, 5, 3), (64, 64, 64)])
def test_components_equal_a_flood_fill(spark, volume, full, size):
    want = {p: q for p, q in flood(volume, full).items() if volume[p]}
    got = lb.labelled(table(spark, volume, "label", "long"), "label", full, size, volume.shape).collect()
    assert {(r.z, r.y, r.x): r.component for r in got} == {p: q[0] * 2**42 + q[1] * 2**21 + q[2] for p, q in want.items()}
    count = {}
    for q in want.values():
        count[q] = count.get(q, 0) + 1
    assert all(r.size == count[want[r.z, r.y, r.x]] and r.label == volume[r.z, r.y, r.x] for r in got)


@pytest.mark.parametrize("size", [(5, 4, 6), (20, 20, 20)])
def test_holes_are_enclosed_and_small(spark, size):
    rng = np.random.default_rng(3)
    a = (rng.random((12, 13, 14)) < 0.72).astype(np.int64)
    a[:, :, 12:] = 0
    groups = {}
    for p, q in flood(a, False).items():
        if a[p] == 0:
            groups.setdefault(q, []).append(p)
    want = set()
    for g in groups.values():
        if len(g) <= 6 and not any(x in (0, n - 1) for p in g for x, n in zip(p, a.shape, strict=True)):
            want |= set(g)
    got = {(r.z, r.y, r.x) for r in lb.holes(table(spark, a, "on", "long"), 6, size, a.shape).collect()}
    assert got == want and len(want) > 20
    with pytest.raises(ValueError):
        lb.holes(table(spark, a, "on", "long"), 10**6, size, a.shape)


def test_carving_fills_what_is_inside(spark):
    a = np.zeros((9, 9, 9))
    a[1:8, 1:8, 1:8] = 5.0
    a[4, 4, 4:6] = 1.0
    a[3, 3, 3] = 0.0
    got = {(r.z, r.y, r.x): r.value for r in lb.carved(table(spark, a, "value", "double"), "value").collect()}
    assert len(got) == 343 and got[4, 4, 4] == 1.0 and got[3, 3, 3] is None
    small = {(r.z, r.y, r.x) for r in lb.carved(table(spark, a, "value", "double"), "value", most=1).collect()}
    assert len(small) == 341
    found = lb.components_over(table(spark, a, "value", "double"), "value", 2.0, 100).collect()
    assert len(found) == 1 and (found[0].size, found[0].z_min, found[0].z_max) == (340, 1, 7)


def test_cropping_to_the_original(spark):
    rng = np.random.default_rng(1)
    was, new = (rng.random((10, 9, 8)) < 0.5).astype(np.int64), rng.integers(0, 4, (10, 9, 8))
    was[:5, :4] = 0
    for radius in (0, 1):
        want = np.where(m.filtered(was == 0, radius, "opening"), 0, new)
        got = np.zeros_like(new)
        for r in lb.cropped_to_original(table(spark, new, "label", "long"), table(spark, was, "label", "long"), radius, (4, 5, 3)).collect():
            got[r.z, r.y, r.x] = r.label
        assert (got == want).all()
    assert lb.labelled(table(spark, new, "label", "long").limit(0)).collect() == []
    assert lb.labelled(table(spark, new, "label", "long").filter(F.col("z") == 1), full=False).count() == int((new[1] != 0).sum())
