"""Models with a second factor, quantiles and intervals, clusters and places: against plain NumPy and published values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import matching, models, points, regions, stats, tables
from voxelweave.operators.detection import formatted
from voxelweave.sources import files


def data(rng, cells, noise=1.0):
    rows = []
    for (region, g, s), n in cells.items():
        for _ in range(n):
            v = 3 + 2 * (g == "b") - (s == "r") + 1.5 * (g == "b") * (s == "r") + region + noise * rng.normal()
            rows.append((region, g, s, float(v)))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    cells = {(1, g, s): n for (g, s), n in zip(itertools.product("ab", "lr"), (7, 9, 5, 8), strict=True)}
    cells |= {(2, "a", "l"): 6, (2, "a", "r"): 5}  # one group: sides alone
    cells |= {(3, "a", "l"): 6, (3, "b", "l"): 7}  # one side: the group alone
    cells |= {(4, "a", "l"): 4, (4, "a", "r"): 5, (4, "b", "l"): 6}  # the interaction depends on the others
    cells |= {(5, g, s): 4 for g in "abc" for s in "lr"}  # three levels
    return data(rng, cells) + [(1, "a", "l", None), (1, None, "l", 3.0), (6, "a", "l", None)]


def plain(rows, region, intercept=True):
    mine = [(g, s, v) for r, g, s, v in rows if r == region and g is not None and v is not None]
    gs, ss = sorted({g for g, _, _ in mine}), sorted({s for _, s, _ in mine})
    names, cols = ["intercept"], [[1.0] * len(mine)]
    if len(gs) > 1:
        for x in gs[1:]:
            names.append(f"group:{x}"), cols.append([float(g == x) for g, _, _ in mine])
    if len(ss) > 1:
        for y in ss[1:]:
            names.append(f"side:{y}"), cols.append([float(s == y) for _, s, _ in mine])
    if len(gs) > 1 and len(ss) > 1:
        for y in ss[1:]:
            for x in gs[1:]:
                names.append(f"group:{x}*side:{y}"), cols.append([float(g == x and s == y) for g, s, _ in mine])
    x, y = np.array(cols).T, np.array([v for _, _, v in mine])
    keep = []
    for j in range(x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*keep, j]]) > len(keep):
            keep.append(j)
    x = x[:, keep]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = ((y - x @ beta) ** 2).sum()
    se = np.sqrt(rest / (len(y) - len(keep)) * np.diag(np.linalg.inv(x.T @ x)))
    r2 = 1 - rest / ((y - y.mean()) ** 2).sum()
    return {names[j]: (b, e, r2, beta[0]) for j, b, e in zip(keep, beta, se, strict=True)}


def test_linear_models_equal_least_squares(spark, rows):
    df = spark.createDataFrame(rows, "region int, g string, s string, v double")
    got = models.linear_model(df, "region", "v", "g", "s").collect()
    assert {r.region for r in got} == {1, 2, 3, 4, 5}
    for region in range(1, 6):
        want = plain(rows, region)
        mine = {r.term: r for r in got if r.region == region}
        assert set(mine) == set(want) - {"intercept"}
        for term, (b, e, r2, a) in want.items():
            if term != "intercept":
                r = mine[term]
                assert np.allclose([r.estimate, r.se, r.r_squared, r.intercept, r.t], [b, e, r2, a, b / e], atol=1e-9) and 0 <= r.p <= 1
    assert [r.term for r in sorted((r for r in got if r.region == 1), key=lambda r: r.position)] == ["group:b", "side:r", "group:b*side:r"]
    bare = {r.term: r.estimate for r in models.linear_model(df.filter("region = 3"), "region", "v", "g", "s", intercept=False).collect()}
    means = {g: np.mean([v for r, x, _, v in rows if r == 3 and x == g]) for g in "ab"}
    assert abs(bare["group:a"] - means["a"]) < 1e-9 and abs(bare["group:b"] - means["b"]) < 1e-9
    assert models.linear_model(df.limit(0), "region", "v", "g", "s").collect() == []


def test_logistic_models_equal_newton_on_the_whole(spark):
    rng = np.random.default_rng(4)
    rows = []
    for region, sides in ((1, "lr"), (2, "l"), (3, "lr")):
        for _ in range(300):
            s, v = sides[rng.integers(len(sides))], float(rng.normal(5, 2))
            p = 1 / (1 + math.exp(-(0.4 * (v - 5) + (s == "r") * (0.5 - 0.3 * (v - 5)))))
            rows.append((region, "b" if (rng.random() < p if region < 3 else v > 5) else "a", s, v))
    got = models.logistic_model(spark.createDataFrame(rows, "region int, g string, s string, v double"), "region", "g", "v", ("a", "b"), "s").collect()
    for region in (1, 2):
        mine = [(g == "b", s == "r", v) for r, g, s, v in rows if r == region]
        y = np.array([a for a, _, _ in mine], float)
        x = np.array([[1, v, b, b * v] for _, b, v in mine], float)[:, : 4 if region == 1 else 2]
        beta = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ beta))
            h = x.T @ (x * (p * (1 - p))[:, None])
            beta = beta + np.linalg.solve(h, x.T @ (y - p))
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        r = sorted((r for r in got if r.region == region), key=lambda r: r.position)
        assert np.allclose([q.estimate for q in r], beta[1:], atol=1e-7) and np.allclose([q.se for q in r], se[1:], atol=1e-6)
    assert all(q.estimate is None and q.p is None for q in got if q.region == 3)  # told apart fully


def test_models_by_measure_leave_out_ignored_regions(spark):
    df = spark.createDataFrame([(r, g, float(i + r), float(i * i) if i else float("nan")) for r in (1, 2) for i in range(6) for g in "ab"], "region int, g string, one double, two double")
    got = models.by_measure(df, "region", ["g"], ["one", "two"], lambda d, k, v: models.linear_model(d, k, v, "g"), ignore=[2], where=F.col("one") < 100).collect()
    assert sorted((r.region, r.measure, r.n) for r in got) == [(1, "one", 12), (1, "two", 10)]


def test_quantiles_and_intervals():
    p = np.array([0.975, 0.975, 0.975, 0.95, 0.995])
    assert np.allclose(stats.t_quantiles(p, np.array([1.0, 4, 30, 10, 1000])), [12.7062047, 2.7764451, 2.0422725, 1.8124611, 2.5807547], atol=1e-6)
    # noncentral t: by numerical integration over the chi distribution
    for t, df, shift in ((1.2, 5, 0.7), (-0.5, 9, 1.1), (3.0, 12, 2.5), (2.0, 3, -1.0)):
        w = np.linspace(1e-6, 40, 400_001)
        chi = np.exp((df - 1) * np.log(w) - w * w / 2 - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2))
        below = np.array([0.5 * math.erfc(-(t * x / math.sqrt(df) - shift) / math.sqrt(2)) for x in w[::40]])
        want = np.trapezoid(chi[::40] * below, w[::40])
        assert abs(stats.noncentral_t(t, df, shift) - want) < 1e-6
    t, df = 2.3, 18
    low, high = stats.noncentrality(t, df, 0.975), stats.noncentrality(t, df, 0.025)
    assert low < t < high and abs(stats.noncentral_t(t, df, low) - 0.975) < 1e-9 and abs(stats.noncentral_t(t, df, high) - 0.025) < 1e-9


def test_summary_intervals_and_correction_of_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in tables.group_summary(df, ["g"], "v").collect()}
    assert abs(got["a"].ci - 4.3026527 * got["a"].se) < 1e-6 and got["b"].ci is None and got["c"].ci is None
    p = spark.createDataFrame([(1, 0.01, 5), (2, 0.04, 3), (3, 0.001, 1), (4, None, 9)], "r int, p double, n long")
    for how, want in (("bonferroni", [0.02, 0.08, None, None]), ("bh", [0.02, 0.04, None, None])):
        assert [r.p_corr for r in stats.corrected(p, "p", how, "n").orderBy("r").collect()] == want


def test_cohen_interval_in_results(spark):
    rng = np.random.default_rng(0)
    rows = [(1, c, float(rng.normal(m, 1))) for c, m in (("x", 0), ("y", 1)) for _ in range(12)]
    r = stats.welch(spark.createDataFrame(rows, "r int, c string, v double"), "r", "c", "v", ("x", "y")).first()
    k = math.sqrt(12 * 12 / 24)
    assert r.cohen_low < r.cohen_d < r.cohen_high and abs(stats.noncentral_t(r.cohen_d * k, 22, r.cohen_low * k) - 0.975) < 1e-8


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.normal(c, 1.2, (60, 3)) for c in rng.uniform(0, 22, (4, 3))] + [rng.uniform(0, 25, (40, 3))])
    at = np.round(at * 2) / 2 if seed % 2 else at  # ties, repeated places, distances of exactly eps
    label = rng.integers(0, 2, len(at))
    eps, least = 1.5, 4
    rows = [(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(label, at, strict=True))] + [(9999, 0, None, 1.0, 1.0)]
    near = (((at[:, None] - at[None]) ** 2).sum(axis=2) <= eps * eps) & (label[:, None] == label[None])
    core = near.sum(axis=1) >= least
    low = np.arange(len(at))
    for _ in range(len(at)):
        new = np.array([min([low[i], *low[near[i] & core]]) if core[i] else low[i] for i in range(len(at))])
        if (new == low).all():
            break
        low = new
    want = {i: int(low[i]) if core[i] else min([int(low[j]) for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(at))} | {9999: -1}
    df = spark.createDataFrame(rows, "blob_id long, label int, z double, y double, x double")
    got = {r.blob_id: r.cluster for r in points.dbscan(df, eps, least, points.AXES, "blob_id", ("label",)).collect()}
    assert got == want and len(set(want.values())) > 3


def test_a_crowded_place_is_one_row_of_every_join(spark):
    """Thousands of points at a few places: results as by brute force, and joins that grow with the places alone."""
    rows = [(i, 0, 1.0, 1.0, float(i % 3)) for i in range(3000)] + [(5000 + i, 1, 1.0, 1.0, 4.0 + i % 2) for i in range(3000)] + [(9000, 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "blob_id long, channel int, z double, y double, x double")
    a, b = df.filter("channel = 0"), df.filter("channel = 1")
    stays = {r.blob_id for r in points.without_close(a, b, (1, 1, 2)).collect()}
    assert stays == {i for i in range(3000) if i % 3 < 2} | {9000}
    best = {r.a: (r.b, r.dist) for r in points.closest(a, b, 2.5).collect()}
    assert best == {i: (5000, 2.0) for i in range(3000) if i % 3 == 2}
    tiles = {r.blob_id for r in points.pruned_tiles(df, (4, 4, 4), (1, 1, 2), (1, 1, 2)).collect()}
    assert tiles == {i for i in range(3000)} | {5000 + i for i in range(3000)} | {9000}
    same = df.withColumn("channel", F.lit(0))
    assert {r.blob_id for r in points.pruned_tiles(same, (4, 4, 4), (1, 1, 2), (1, 1, 2)).collect()} == {i for i in range(3000)} | {5000 + i for i in range(3000) if i % 2} | {9000}


def test_blob_tables_of_any_version(spark, tmp_path):
    old = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "z double, y double, x double, radius double")
    old.write.parquet(str(tmp_path / "old"))
    r = files.read_points(spark, str(tmp_path / "old"), 3).first()
    assert (r.confirmed, r.truth, r.channel, r.abs_z, r.abs_x) == (-1, -1, 3, 1.0, 3.0)
    full = formatted(old, 1).withColumn("abs_z", F.col("z") + 7)
    full.write.parquet(str(tmp_path / "new"))
    r = files.read_points(spark, str(tmp_path / "new")).first()
    assert (r.channel, r.abs_z) == (1, 8.0)
    assert points.stored(full).first().z == 8


def test_channel_matches_are_roi_matches_of_each_pair(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 9)), float(rng.integers(0, 30)), float(rng.integers(0, 30))) for i in range(120)]
    df = spark.createDataFrame(rows, "blob_id long, channel int, z double, y double, x double").withColumns({"confirmed": F.lit(1), "truth": F.lit(1)})
    rois = spark.createDataFrame([(1, 0, 0, 0, 9, 15, 30), (2, 0, 15, 0, 9, 15, 30)], "roi_id long, z0 int, y0 int, x0 int, nz int, ny int, nx int")
    got = matching.channel_matches(df, rois, (2, 3, 3), [2, 0, 1])
    for low, high in ((0, 1), (0, 2), (1, 2)):
        one = matching.roi_matches(df.filter(F.col("channel") == high), df.filter(F.col("channel") == low), rois, (2, 3, 3))
        assert sorted((r.roi_id, r.b, r.a) for r in one.collect()) == sorted((r.roi_id, r.a, r.b) for r in got.filter((F.col("channel_a") == low) & (F.col("channel_b") == high)).collect())
    table = matching.match_table(got, df).collect()
    assert len(table) == got.count() > 5 and all(r.blob1.confirmed == r.blob2.truth == -1 for r in table)


def test_all_combinations_of_flags(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1, 1, 1), (1.0, 1.0, 1.0, 1, 1, 0), (9.0, 9.0, 9.0, 0, 1, 1), (0.0, 0.0, 0.0, None, 1, 0)], "z double, y double, x double, a int, b int, c int")
    got = {(r.channels, r.z): r.n for r in regions.combination_heat_maps(df, (1, 1, 1), (5, 5, 5), ["a", "b", "c"], ["b"]).collect()}
    assert got == {("a-b", 1): 2, ("b-c", 1): 1, ("a-b-c", 1): 1, ("b-c", 4): 1}
    assert regions.combination_heat_maps(df, (1, 1, 1), (5, 5, 5), ["a"]).collect() == []


def test_signed_rank_of_sums_does_not_hang_on_their_last_bits(spark):
    rows = [(0, s, c, x) for s, v in enumerate((0.1 + 0.2, 0.3, -0.3, 1.7, 0.0)) for c, x in (("F", 0.0), ("O", v))]
    rows += [(0, 9, "F", 0.3), (0, 9, "O", 0.1 + 0.2)]  # no difference but for the order of the sum
    df = spark.createDataFrame(rows, "region int, sample int, condition string, volume double")
    got = stats.signed_rank(df, "region", "sample", "condition", "volume", ("F", "O"), 2).first()
    assert (got.n, got.w) == (4, 8.0)  # ranks 2, 2, 2 (of which one negative) and 4
