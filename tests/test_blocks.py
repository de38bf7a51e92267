"""Halo blocks: filters, detection and smoothing against plain NumPy on whole small volumes, for blocks of several sizes."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.functions import views
from voxelweave.operators import blocks as b
from voxelweave.operators import detection as d
from voxelweave.operators import morphology as m
from voxelweave.operators import points, volumes

SIZES = [(7, 7, 7), (5, 40, 9), (64, 64, 64)]


def table(spark, a, name="value", kind="double"):
    at = np.argwhere(a != 0)
    rows = [(*map(int, p), a[tuple(p)].item()) for p in at]
    return spark.createDataFrame(rows, f"z int, y int, x int, {name} {kind}")


def spots(rng, shape, n):
    grid = np.stack(np.indices(shape), axis=-1)
    out = np.zeros(shape)
    for _ in range(n):
        at, s = rng.uniform(2, np.array(shape) - 3), rng.uniform(1.2, 2.4)
        out += rng.uniform(0.4, 1) * np.exp(-((grid - at) ** 2).sum(axis=-1) / (2 * s * s))
    return np.where(out > 0.01, out, 0)


def plain_laplacian(a, sigma):
    """By a direct sum over a mirrored volume for each voxel's axis kernels, as matrices."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    k2 = (x**2 / sigma**4 - 1 / sigma**2) * g

    def matrix(n, taps):
        out = np.zeros((n, n))
        for i in range(n):
            for j, t in zip(x, taps, strict=True):
                at = (i + j) % (2 * n)
                out[i, at if at < n else 2 * n - 1 - at] += t
        return out

    flat, curved = [[matrix(n, t) for n in a.shape] for t in (g, k2)]
    total = 0
    for axis in range(3):
        mats = [curved[i] if i == axis else flat[i] for i in range(3)]
        total = total + np.einsum("ai,bj,ck,ijk->abc", *mats, a)
    return total


PROFILE = d.Profile(min_sigma=1.0, max_sigma=2.5, sigmas=4, threshold=0.08, overlap=0.05)


@pytest.fixture(scope="module")
def image():
    return spots(np.random.default_rng(3), (21, 26, 19), 60)


def plain_blobs(a):
    cube = np.stack([-plain_laplacian(a, s) * s * s for s in np.linspace(1.0, 2.5, 4)])
    found = []
    for s, z, y, x in np.argwhere(cube > PROFILE.threshold):
        near = cube[max(s - 1, 0) : s + 2, max(z - 1, 0) : z + 2, max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
        if cube[s, z, y, x] >= near.max():
            found.append((z, y, x, float(np.linspace(1.0, 2.5, 4)[s] * math.sqrt(3))))
    kept = []
    for blob in sorted(found, key=lambda p: (-p[3], p[:3])):
        for other in kept:
            dist, r, q = math.dist(blob[:3], other[:3]), blob[3], other[3]
            if dist >= r + q:
                continue
            lo, hi = min(r, q), max(r, q)
            # shared volume of two spheres by integration over their axis
            t = np.linspace(-lo, lo, 20001)
            own = np.maximum(lo * lo - t * t, 0)
            far = np.maximum(hi * hi - (t - dist) ** 2, 0)
            if np.trapezoid(np.minimum(own, far), t) / (4 / 3 * lo**3) > PROFILE.overlap:
                break
        else:
            kept.append(blob)
    return found, kept


@pytest.mark.parametrize("size", SIZES)
def test_detection_equals_plain_numpy_for_any_block(spark, image, size):
    found, kept = plain_blobs(image)
    v = table(spark, image)
    got = d.scale_space_peaks(v, PROFILE, size=size, shape=image.shape).collect()
    assert sorted((r.z, r.y, r.x, round(r.sigma * math.sqrt(3), 9)) for r in got) == sorted((*map(int, p[:3]), round(p[3], 9)) for p in found)
    blobs = d.detected(v, PROFILE, size=size, shape=image.shape, channel=2).collect()
    assert sorted((r.z, r.y, r.x, round(r.radius, 9)) for r in blobs) == sorted((*map(int, p[:3]), round(p[3], 9)) for p in kept)
    assert len(found) > len(kept) > 10 and all((r.confirmed, r.truth, r.channel, r.abs_z) == (-1, -1, 2, r.z) for r in blobs)


def test_detection_of_planted_spheres_and_of_nothing(spark):
    a = np.zeros((30, 40, 40))
    grid = np.stack(np.indices(a.shape), axis=-1)
    at = [(8, 9, 10), (8, 28, 12), (20, 12, 30), (21, 30, 30)]
    for p in at:
        a[((grid - p) ** 2).sum(axis=-1) <= 9] = 1.0
    profile = d.Profile(min_sigma=1.2, max_sigma=2.4, sigmas=5, threshold=0.2, exclude_border=(1, 1, 1))
    v = table(spark, a)
    got = d.detected(v, profile, shape=a.shape).collect()
    assert sorted((r.z, r.y, r.x) for r in got) == at and all(2 < r.radius < 4.2 for r in got)
    assert d.detected(v.limit(0), profile).collect() == []
    edge = d.detected(v, d.Profile(min_sigma=1.2, max_sigma=2.4, sigmas=5, threshold=0.2, exclude_border=(9, 1, 1)), shape=a.shape).collect()
    assert sorted((r.z, r.y, r.x) for r in edge) == at[2:3] + ([at[3]] if at[3][0] <= 20 else [])


def test_detection_reads_and_filters_the_volume_once(spark, image):
    v, read = table(spark, image), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = v.count()
    assert len(d.detected(v.mapInArrow(counted, v.schema), PROFILE, shape=image.shape).collect()) > 10
    assert read.value == n


def test_responses_are_the_same_to_the_last_bit_in_any_part():
    a = np.random.default_rng(4).random((40, 30, 35))
    whole = d.responses(a, PROFILE)[1:-1, 1:-1, 1:-1, 1:-1]
    want = np.stack([-plain_laplacian(a, s) * s * s for s in np.linspace(1.0, 2.5, 4)])
    assert np.abs(whole - want).max() < 1e-12
    part = d.responses(a[5:38, :, 12:], PROFILE, (slice(10, 17), slice(0, 30), slice(11, 23)))[1:-1, 1:-1, 1:-1, 1:-1]
    assert (part == whole[:, 15:22, :, 23:35]).all()


@pytest.mark.parametrize("size", [(3, 40, 9), (64, 64, 64)])
def test_lists_of_voxels_are_the_same_blocks_as_rows(spark, size):
    rng = np.random.default_rng(6)
    rows = [(k, *map(int, p), None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i), int(i) - 40) for k in ("a", "b") for i, p in enumerate(np.argwhere(rng.random((9, 30, 25)) < 0.05))]
    v = spark.createDataFrame(rows, "k string, z int, y int, x int, value double, label int")

    def work(arrays, low, core, key):
        there = np.nonzero(arrays["label"])
        return {c: (i + lo).astype(np.int32) for c, i, lo in zip(("z", "y", "x"), there, low, strict=True)} | {"value": arrays["value"][there], "label": arrays["label"][there]}

    def got(**how):
        return sorted(map(tuple, b.on_blocks(v, {"value": "f8", "label": "i8"}, (9, 30, 25), size, (1, 2, 1), work, "k string, z int, y int, x int, value double, label long", ["k"], **how).collect()))

    assert len(got()) >= len(rows) - 2 and got() == got(lists=True) == got(lists=True, parts=3)


def test_detection_hands_lists_of_voxels_to_python(spark, image):
    v = table(spark, image)
    sent = d.scale_space_peaks(v, PROFILE, shape=image.shape)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(_place" in sent
    null = v.unionByName(spark.createDataFrame([(20, 25, 18, None)], v.schema)) if image[20, 25, 18] == 0 else v
    assert sorted(map(tuple, d.scale_space_peaks(null, PROFILE, shape=image.shape).collect())) == sorted(map(tuple, d.scale_space_peaks(v, PROFILE, shape=image.shape).collect()))


def test_of_equal_peaks_the_first_stays():
    cube = np.full((4, 6, 6, 6), -np.inf)
    cube[1:-1, 1:-1, 1:-1, 1:-1] = 0.0
    cube[1, 2, 2, 2:4] = cube[2, 2, 2, 2] = cube[1, 4, 4, 4] = 1.0
    cube[1, 4, 1, 1] = 0.5
    cube[1, 4, 1, 2] = 0.25
    assert list(zip(*(i.tolist() for i in d.peaks(cube, 0.2, [slice(1, -1)] * 3)), strict=True)) == [(1, 2, 2, 2), (1, 4, 1, 1), (1, 4, 4, 4)]
    assert list(zip(*(i.tolist() for i in d.peaks(cube, 0.2, [slice(3, -1)] * 3)), strict=True)) == [(1, 4, 4, 4)]


def test_preprocessing_by_tiles(spark, image):
    a = image.copy()
    profile = d.Profile(blur=2.0, total_variation=0.05)
    tile = (8, 13, 10)
    want = np.zeros_like(a)
    for z in range(0, a.shape[0], 8):
        for y in range(0, a.shape[1], 13):
            for x in range(0, a.shape[2], 10):
                box = (slice(z, z + 8), slice(y, y + 13), slice(x, x + 10))
                t = a[box]
                lo, hi = np.percentile(t, (5, 99.5))
                s = t if lo == hi else (np.clip(t, lo, max(hi, 0.9 * 0.5)) - lo) / (max(hi, 0.9 * 0.5) - lo)
                den = d.total_variation(np.clip(s, 0, 1), 0.05)
                r, g = 8, np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
                g /= g.sum()
                blur = den
                for axis in range(3):
                    blur = np.apply_along_axis(lambda line: np.convolve(np.pad(line, r, mode="edge"), g, "valid"), axis, blur)
                den = den + (den - 0.3 * blur)
                if s.mean() > 0.2:
                    wide = np.pad(den, 1, constant_values=9e9)
                    den = np.min([wide[1 + i : 1 + i + den.shape[0], 1 + j : 1 + j + den.shape[1], 1 + k : 1 + k + den.shape[2]] for i, j, k in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]], axis=0)
                want[box] = den
    got = np.full(a.shape, np.nan)
    for r in d.preprocessed(table(spark, a), profile, 0.9, tile=tile, shape=a.shape).collect():
        got[r.z, r.y, r.x] = r.value
    there = ~np.isnan(got)
    assert there.mean() > 0.9 and np.abs(got - want)[there].max() < 1e-9


def test_total_variation_lowers_the_variation_and_keeps_a_constant():
    rng = np.random.default_rng(0)
    a = np.kron([[[0.0, 1.0], [1.0, 0.0]]] * 2, np.ones((3, 5, 5))) + 0.1 * rng.normal(size=(6, 10, 10))
    tv = lambda x: sum(np.abs(np.diff(x, axis=i)).sum() for i in range(3))
    out = d.total_variation(a, 0.1)
    assert tv(out) < 0.7 * tv(a) and abs(out.mean() - a.mean()) < 1e-9 and np.allclose(d.total_variation(np.ones((4, 4, 4)), 0.1), 1)


def test_block_settings():
    s = d.block_settings(d.Profile(exclude_border=(1, 0, 0), tolerance=(1, 0.9, 0.9)), (5.0, 0.9, 0.9))
    assert s.tile == (100, 556, 556) and s.denoise_tile == (5, 28, 28) and s.overlap == (3, 6, 6) and s.tolerance == (1, 5, 5) and s.padding == (0, 5, 5)
    assert np.allclose(d.isotropic_factor((6.6, 1.1, 1.1)), [6.0, 1.0, 1.0])


def ball(r):
    return [(z, y, x) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1) if z * z + y * y + x * x <= r * r]


def plain_filter(mask, r, how):
    def erode(on):
        out = on.copy()
        for o in ball(r):
            for p in np.argwhere(on):
                q = p + o
                if ((q >= 0) & (q < on.shape)).all() and not on[tuple(q)]:
                    out[tuple(p)] = False
        return out

    def dilate(on):
        out = on.copy()
        for p in np.argwhere(on):
            q = p + np.array(ball(r))
            out[tuple(q[((q >= 0) & (q < on.shape)).all(axis=1)].T)] = True
        return out

    return erode(mask) if how == "erosion" else erode(dilate(mask)) if how == "closing" else dilate(erode(mask))


def plain_smoothing(a, n, mode, small, crop=None):
    """All labels from the original; largest first; then the nearest for what nobody holds."""
    sizes = Counter(a.ravel().tolist())
    new = np.full(a.shape, -(10**9))
    for x in sorted(sizes, key=lambda k: (-sizes[k], k)):
        mask = a == x
        if mode == "opening":
            r = n // 2 if sizes[x] < small else n
            out = plain_filter(mask, r, "opening")
            if out.sum() / sizes[x] < 0.01:
                out = plain_filter(mask, r, "closing")
        elif mode == "closing":
            out = plain_filter(mask, n, "closing")
        else:
            how = mode.split("_")[1]
            out = mask
            for r in range(n, 0, -1):
                one = plain_filter(mask, r, how)
                if one.sum() != sizes[x] and one.sum() / sizes[x] > 0.2:
                    out = one
                    break
        new[out] = x
    have = np.argwhere(new > -(10**9))
    filled = new.copy()
    for p in np.argwhere(new == -(10**9)):
        gap = ((have - p) ** 2).sum(axis=1)
        filled[tuple(p)] = new[tuple(have[np.lexsort([have[:, 2], have[:, 1], have[:, 0], gap])[0]])]
    if crop is not None:
        filled[plain_filter(a == 0, crop, "opening")] = 0
    return filled


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(5)
    a = np.zeros((16, 18, 15), np.int64)
    grid = np.stack(np.indices(a.shape), axis=-1)
    for k in range(1, 6):
        at, r = rng.uniform(2, np.array(a.shape) - 2), rng.uniform(3, 6)
        a[((grid - at) ** 2).sum(axis=-1) <= r * r] = k
    a[3, 4, :] = -7  # a thin one, lost by opening
    noise = rng.random(a.shape) < 0.02
    a[noise] = rng.integers(1, 6, noise.sum())
    return a


@pytest.mark.parametrize("mode", ["opening", "closing", "adaptive_opening", "adaptive_erosion"])
def test_smoothing_equals_plain_numpy_for_any_block(spark, labels, mode):
    v = table(spark, labels, "label", "long")
    want = {n: plain_smoothing(labels, n, mode, 60, 1 if mode == "closing" else None) for n in (1, 2)}
    for size in ((16, 9, 6), (64, 64, 64)):
        got = {n: np.zeros(labels.shape, np.int64) for n in want}
        for r in m.smoothed_labels(v, [1, 2], mode, labels.shape, size, small=60, crop=1 if mode == "closing" else None).collect():
            got[r.filter_size][r.z, r.y, r.x] = r.label
            assert r.was == labels[r.z, r.y, r.x]
        for n in want:
            assert (got[n] == want[n]).all(), (mode, n, size, int((got[n] != want[n]).sum()))
    assert m.smoothed_labels(v.limit(0), [1, 2], mode).collect() == []


def test_sweep_measures(spark, labels):
    v = table(spark, labels, "label", "long")
    total, raw = m.smoothing_sweep(v, [1, 2], (2.0, 1.0, 1.0), shape=labels.shape, small=60, block=(6, 18, 7))
    rows = {(r.filter_size, r.label): r for r in raw.collect()}
    shapes = {}
    for n in (0, 1, 2):
        a = labels if n == 0 else plain_smoothing(labels, n, "opening", 60)
        for x in np.unique(labels)[np.unique(labels) != 0].tolist():
            on = np.pad(a == x, 1)
            area = sum(w * (np.diff(on.astype(int), axis=i) != 0).sum() for i, w in enumerate((1.0, 2.0, 2.0)))
            shapes[n, x] = (2.0 * on.sum(), area, 2.0 * ((a == x) & (labels != x)).sum())
    for (n, x), r in rows.items():
        vol, area, _ = shapes[0, x]
        new, new_area, away = shapes[n, x]
        assert (r.volume_orig, r.volume) == (vol, new)
        if new:
            compaction = 1 - (new_area**3 / new**2) / (area**3 / vol**2)
            assert abs(r.compaction - compaction) < 1e-9 and abs(r.displacement - away / new) < 1e-12 and abs(r.quality - compaction + away / new) < 1e-9 and abs(r.sa_to_vol_frac - new_area / new / (area / vol)) < 1e-9
        else:
            assert r.compaction is None and r.displacement is None and r.sa_to_vol is None
    assert len(rows) == 2 * len(np.unique(labels)[np.unique(labels) != 0])
    for r in total.collect():
        mine = [x for (n, _), x in rows.items() if n == r.filter_size]
        w = np.array([x.volume_orig for x in mine])
        have = np.array([x.compactness is not None for x in mine])
        c = np.array([x.compactness or 0.0 for x in mine])
        mean = (c * w)[have].sum() / w[have].sum()
        sd = (((c - mean) ** 2 * w)[have].sum() / w[have].sum()) ** 0.5
        assert abs(r.compactness - mean) < 1e-9 and abs(r.compactness_sd - sd) < 1e-9 and abs(r.compactness_cv - sd / mean) < 1e-12 and r.label_loss == (~have).mean()


def test_distances_are_exact_within_reach():
    rng = np.random.default_rng(1)
    on = rng.random((9, 8, 11)) < 0.02
    got, have = b.squared_distances(on, 6), np.argwhere(on)
    for p in np.argwhere(np.ones(on.shape)):
        want = ((have - p) ** 2).sum(axis=1).min()
        assert got[tuple(p)] == want if want <= 36 else got[tuple(p)] > 36


@pytest.mark.parametrize("size", SIZES)
def test_extracted_labels_equal_plain_numpy(spark, size):
    rng = np.random.default_rng(8)
    labels, image = np.zeros((20, 24, 18), int), rng.uniform(1, 2, (20, 24, 18))
    labels[8:11, 9:13, 6:9], labels[12, 15, 10] = 3, 4
    at = np.argwhere(labels != 0)
    low, high = np.maximum(at.min(axis=0) - 4, 0), np.minimum(at.max(axis=0) + 5, labels.shape)
    box = tuple(slice(a, b) for a, b in zip(low, high, strict=True))
    near = np.zeros(labels.shape, bool)
    for place in np.argwhere(np.ones(labels.shape)):
        near[tuple(place)] = ((at - place) ** 2).sum(axis=1).min() <= 4
    kept = np.where(near, image, 0)[box]
    rows = [(*map(int, p), int(labels[tuple(p)]), float(image[tuple(p)])) for p in np.argwhere(image > 0)]
    v = spark.createDataFrame(rows, "z int, y int, x int, label int, atlas double")
    got = {(r.z, r.y, r.x): (r.label, r.atlas) for r in m.extracted_labels(v, "atlas", radius=2, padding=4, block=size).collect()}
    assert got == {tuple(map(int, p)): (labels[box][tuple(p)], kept[tuple(p)]) for p in np.argwhere((labels[box] != 0) | (kept != 0))}
    only = v.withColumn("mask", (F.col("label") == 4).cast("int"))
    few = m.extracted_labels(only, "atlas", radius=1, padding=1, mask="mask", block=size).collect()
    assert {(r.z, r.y, r.x) for r in few} == {(1, 1, 1), (0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2)}
    assert m.extracted_labels(v.filter("label = 0"), "atlas").collect() == []


def test_detection_grid_looks_for_neighbours_once_for_all_settings(spark, monkeypatch):
    image = spots(np.random.default_rng(12), (14, 26, 22), 45)
    blobs = [(r.z, r.y, r.x) for r in d.detected(table(spark, image), PROFILE, shape=image.shape).collect()]
    alone = [p for p in blobs if all(max(map(abs, np.subtract(p, q))) > 4 for q in blobs if q != p)]
    assert len(alone) > 2
    real = spark.createDataFrame(alone * 2, "z int, y int, x int")  # two true points at each place, one blob near them
    asked, pairs = [], d.near_pairs
    monkeypatch.setattr(d, "near_pairs", lambda a, b, *rest: asked.append(a.columns) or pairs(a, b, *rest))
    monkeypatch.setattr(d, "greedy_matches", lambda a, b, *rest: (lambda n: points.greedy_matches(a.limit(0), b.limit(0), *rest) if n == 0 else pytest.fail(f"{n} lone points are ordered"))(a.count()))
    got = d.detection_grid(table(spark, image), real, d.replace(PROFILE, threshold=0.3), [PROFILE.threshold, 9.0], [PROFILE.overlap, 0.6], (1, 1, 1), shape=image.shape).collect()
    assert len(asked) == 2 and not any("setting" in c for c in asked)
    assert {(r.threshold, r.overlap): (r.pos, r.tp, r.fp) for r in got}[PROFILE.threshold, PROFILE.overlap] == (2 * len(alone), len(alone), len(blobs) - len(alone))
    assert [(r.pos, r.tp, r.fp) for r in got if r.threshold == 9.0] == [(2 * len(alone), 0, 0)] * 2


def test_detection_grid_equals_single_detections(spark):
    rng = np.random.default_rng(12)
    image = spots(rng, (14, 26, 22), 45)
    v = table(spark, image)
    truth = [tuple(map(float, p)) for p in rng.integers(0, (14, 26, 22), (25, 3))]
    truth += truth[:1] + [(r.z + 1.0, float(r.y), float(r.x)) for r in d.detected(v, PROFILE, shape=image.shape).collect()[:5]]
    real = spark.createDataFrame(truth, "z double, y double, x double")
    got = d.detection_grid(v, real, PROFILE, [0.05, 0.45, 9.0], [0.02, 0.6], (3, 3, 3), shape=image.shape, size=(9, 9, 9)).collect()
    assert len(got) == 6
    seen = set()
    for r in got:
        one = d.detected(v, d.replace(PROFILE, threshold=r.threshold, overlap=r.overlap), shape=image.shape).collect()
        pairs = sorted((sum(map(abs, np.subtract(p, q))), i, j) for i, p in enumerate([(b.z, b.y, b.x) for b in sorted(one, key=lambda b: (b.z, b.y, b.x, b.radius))]) for j, q in enumerate(sorted(truth)) if max(map(abs, np.subtract(p, q))) <= 3)
        left, right = set(), set()
        for _, i, j in pairs:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
        assert (r.pos, r.tp, r.fp) == (len(truth), len(left), len(one) - len(left))
        assert r.sensitivity == pytest.approx(len(left) / len(truth))
        seen.add((r.tp, r.fp))
    assert len(seen) > 2


def test_overlaps_are_pruned_within_their_keys(spark):
    rows = [(k, 0, 0, x, 2.0) for k in (0, 1) for x in (0, 1)] + [(2, 0, 0, 1, 2.0)]
    blobs = spark.createDataFrame(rows, "setting int, z int, y int, x int, radius double")
    most = F.when(F.col("setting") == 0, 0.1).otherwise(0.95)
    assert sorted((r.setting, r.x) for r in d.without_overlaps(blobs, 2.0, most, ("setting",)).collect()) == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_nearest_and_closed_from_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    cells = sorted({tuple(int(x) for x in c) for c in rng.integers((-70, -3, 0), (70, 6, 9), (700, 3))} | {(200, 0, 0), (-20, 4, 4)})
    kind = {c: int(k) for c, k in zip(cells, rng.integers(0, 3, len(cells)), strict=True)} | {(200, 0, 0): 0}
    df = spark.createDataFrame([(*c, kind[c]) for c in cells], "z int, y int, x int, kind int")
    a, b = [c for c in cells if kind[c] < 2], [c for c in cells if kind[c] > 0]  # some are in both
    got = {(r.z, r.y, r.x): (r.dist, r.tag) for r in volumes.nearest_voxel(df.filter("kind < 2"), df.filter("kind > 0").selectExpr("z", "y", "x", "z * 10000 + y * 100 + x as tag"), carry=["tag"]).collect()}
    want = {}
    for p in a:
        d2, q = min((sum((i - j) ** 2 for i, j in zip(p, q, strict=True)), q) for q in b)
        want[p] = (d2**0.5, q[0] * 10000 + q[1] * 100 + q[2])
    assert got == want
    v = df.filter("kind > 0").select("z", "y", "x")
    ball = [o for o in itertools.product(range(-2, 3), repeat=3) if sum(x * x for x in o) <= 4]
    add = lambda p, o: tuple(i + j for i, j in zip(p, o, strict=True))
    wide = {add(p, o) for p in b for o in ball}
    closed = volumes.closed(v, 2)
    assert "FlatMapGroupsInArrow" in closed._jdf.queryExecution().executedPlan().toString()  # blocks, not a row a neighbour
    assert {tuple(r) for r in closed.collect()} == {p for p in wide if all(add(p, o) in wide for o in ball)}


# ---- what smoothing reads, deals and holds ---------------------------------------------------------------------------------


class Passes:
    """Stands for ``on_blocks``: notes the rows of each pass, their copies in blocks, and the partitions."""

    def __init__(self, monkeypatch):
        self.seen, run = [], m.on_blocks

        def noted(v, values, shape, size, halo, *rest, **options):
            self.seen.append((v.count(), b.in_blocks(v, shape, size, halo).count(), options.get("parts", 0)))
            return run(v, values, shape, size, halo, *rest, **options)

        monkeypatch.setattr(m, "on_blocks", noted)


@pytest.fixture(scope="module")
def slabs():
    """A long thin volume of slabs, of which about half the places are background."""
    rng = np.random.default_rng(8)
    a = np.repeat(np.arange(200) // 3 % 3, 16).reshape(200, 4, 4)
    return np.where(rng.random(a.shape) < 0.6, a, 0).astype(np.int64)


def test_smoothing_reads_its_input_once(spark, slabs):  # F13
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(x.num_rows)
            yield x

    v = table(spark, slabs, "label", "long")
    m.smoothed_labels(v.mapInArrow(counted, v.schema), [1, 2], shape=slabs.shape, small=60).collect()
    assert read.value == v.count()


def test_halos_of_thin_volumes_copy_little(spark, slabs, monkeypatch):  # F13
    passes = Passes(monkeypatch)
    m.smoothed_labels(table(spark, slabs, "label", "long"), [1, 2], shape=slabs.shape, small=60).collect()
    assert len(passes.seen) >= 2 and all(copies <= 1.1 * rows for rows, copies, _ in passes.seen), passes.seen


def test_gaps_beyond_the_reach_of_blocks(spark):  # F13
    a = np.indices((60, 3, 3)).sum(axis=0) % 2 + 2  # a chessboard that opening takes away, between whole slabs
    a[:5], a[5:10], a[55:] = 2, 3, 2
    want = plain_smoothing(a, 1, "opening", 60)
    assert set(want[30].ravel().tolist()) == {3} and set(want[40].ravel().tolist()) == {2}
    for size in (None, (7, 2, 3)):
        got = np.zeros(a.shape, np.int64)
        for r in m.smoothed_labels(table(spark, a, "label", "long"), [1], shape=a.shape, block=size, small=60).collect():
            got[r.z, r.y, r.x] = r.label
        assert (got == want).all(), size


def test_sweep_measures_a_place_once_for_all_sizes(spark, slabs, monkeypatch):  # F19
    passes = Passes(monkeypatch)
    total, raw = m.smoothing_sweep(table(spark, slabs, "label", "long"), [1, 2, 3], shape=slabs.shape, small=60)
    assert sorted(r.filter_size for r in total.collect()) == [1, 2, 3] and raw.count() == 6
    assert all(rows <= slabs.size for rows, _, _ in passes.seen), passes.seen


def test_tasks_stay_the_same_size(spark, slabs, monkeypatch):  # F28
    v = table(spark, slabs, "label", "long")
    want = m.smoothing_sweep(v, [1, 2], mode="adaptive_opening")[1].collect()
    monkeypatch.setattr(b, "ROWS", 100)
    passes = Passes(monkeypatch)
    got = m.smoothing_sweep(v, [1, 2], mode="adaptive_opening", block=(10, 4, 4))[1].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert all(parts * 100 > rows for rows, _, parts in passes.seen), passes.seen


def test_planes_of_the_grid_are_dealt_to_tasks_of_the_same_size(spark, monkeypatch):  # F28
    sf, cols = "/root/testdata/sf0.001", ("z", "y", "x", "label", "label2")
    want = sorted(map(tuple, views.grid(spark, sf).select(*cols).collect()))
    monkeypatch.setattr(b, "ROWS", 1000)
    got = views.grid(spark, sf, planes=True).select(*cols, F.spark_partition_id().alias("task")).collect()
    assert sorted(tuple(r)[:5] for r in got) == want and len({r.task for r in got}) > 4
    assert all(len({r.task for r in got if r.z == z}) == 1 for z in {r.z for r in got})
