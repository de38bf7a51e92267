"""Every query against its SQL on the smallest tables, and brute force where there is no SQL."""

import itertools
import random

import pytest

from tests.oracle import differences, duck
from voxelweave.functions import views
from voxelweave.operators import hierarchy, matching, points, volumes
from voxelweave.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df())


def _near(a, b, tol):
    return all(abs(x - y) <= t for x, y, t in zip(a, b, tol, strict=True))


def test_thinned_equals_a_sequential_scan(spark):
    rows = views.blobs(spark, SF).collect()
    kept: list = []
    for r in sorted(rows, key=lambda r: (r.z, r.y, r.x, r.blob_id)):
        if not any(k.channel == r.channel and _near((k.z, k.y, k.x), (r.z, r.y, r.x), (2, 3, 3)) for k in kept):
            kept.append(r)
    got = {r.blob_id for r in QUERIES["thinned_points"](spark, SF).collect()}
    assert got == {r.blob_id for r in kept}


def test_greedy_equals_a_sequential_choice(spark):
    rows = views.blobs(spark, SF).collect()
    a, b = [r for r in rows if r.channel == 0], [r for r in rows if r.channel == 1]
    gap = lambda r, s: abs(r.z - s.z) + abs(r.y - s.y) + abs(r.x - s.x)
    pairs = sorted((gap(r, s), r.blob_id, s.blob_id) for r, s in itertools.product(a, b) if _near((r.z, r.y, r.x), (s.z, s.y, s.x), (2, 3, 3)))
    used, want = set(), set()
    for _, i, j in pairs:
        if ("a", i) not in used and ("b", j) not in used:
            used |= {("a", i), ("b", j)}
            want.add((i, j))
    assert {(r.a, r.b) for r in QUERIES["greedy_matches"](spark, SF).collect()} == want


def test_thinned_follows_chains_of_any_length(spark):
    rows = [(i, 0.0, 0.0, float(3 * i)) for i in range(150)] + [(1000 + i, 5.0, 0.0, 3.0 * (i // 2)) for i in range(40)]
    got = {r.blob_id for r in points.thinned(spark.createDataFrame(rows, "blob_id long, z double, y double, x double"), (2, 3, 3)).collect()}
    assert got == {i for i in range(0, 150, 2)} | {1000 + i for i in range(0, 40, 4)}


def test_nearest_with_too_few_points_and_far_ones(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 10_000.0), (3, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "blob_id long, z double, y double, x double")
    assert {r.blob_id: r.dist for r in points.nearest(df, 5, 1.0, points.AXES, "blob_id").collect()} == {1: None, 2: None, 3: None}
    assert {r.blob_id: r.dist for r in points.nearest(df, 2, 1.0, points.AXES, "blob_id").collect()} == {1: 3.0, 2: 10_000.0, 3: 3.0}
    v = df.select(*[points.F.col(c).cast("int").alias(c) for c in points.AXES])
    assert [r.dist for r in volumes.nearest_voxel(v, v.limit(0)).collect()] == [None] * 3
    assert sorted(r.dist for r in volumes.nearest_voxel(v, v.filter("x = 0")).collect()) == [0.0, 0.0, 10_000.0]


def test_optimal_matches_equal_all_permutations(spark):
    rng = random.Random(5)
    schema = "blob_id long, roi_id long, z double, y double, x double"
    a, b = ([(k * 100 + i, k, *(rng.random() * 6 for _ in range(3))) for k in range(4) for i in range(n + k % 2)] for n in (3, 5))
    got: dict = {}
    for r in matching.optimal_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "roi_id", (2, 3, 3)).collect():
        got.setdefault(r.roi_id, set()).add((r.a, r.b))
    gap = lambda r, s: sum(((x - y) * f) ** 2 for x, y, f in zip(r[2:], s[2:], (1.5, 1, 1), strict=True)) ** 0.5
    for k in range(4):
        one, two = [r for r in a if r[1] == k], [r for r in b if r[1] == k]
        best = min(itertools.permutations(two, len(one)), key=lambda p: sum(gap(r, s) for r, s in zip(one, p, strict=True)))
        assert got.get(k, set()) == {(r[0], s[0]) for r, s in zip(one, best, strict=True) if gap(r, s) < 3}
    with pytest.raises(Exception, match="a group of"):
        matching.optimal_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "roi_id", (2, 3, 3), most=2).collect()


def test_boxes_are_verified_by_their_matches(spark):
    schema = "blob_id long, z double, y double, x double"
    test = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (2, 5.0, 9.0, 9.0), (3, 0.0, 0.0, 0.0)], schema)
    truth = spark.createDataFrame([(11, 5.0, 5.0, 6.0), (12, 1.0, 0.0, 0.0), (13, 5.0, 15.0, 15.0)], schema)
    rois = spark.createDataFrame([(7, 0, 0, 0, 20, 20, 20), (8, 50, 50, 50, 5, 5, 5)], "roi_id long, z0 int, y0 int, x0 int, nz int, ny int, nx int")
    assert sorted((r.a, r.b) for r in matching.roi_matches(test, truth, rois, (2, 3, 3)).collect()) == [(1, 11)]
    assert sorted(tuple(r) for r in matching.verified_rois(rois, test, truth, (2, 3, 3)).collect()) == [(7, 3, 1, 2, 2), (8, 0, 0, 0, 0)]


def test_known_p_values(spark):
    """Against published tables and closed forms, small ones to six digits."""
    from voxelweave.operators import stats as st

    t = {(12.706204736, 1.0): 0.05, (63.656741162, 1.0): 0.01, (10.0, 2.0): 1 - 10 / 102**0.5, (40.0, 2.0): 1 - 40 / 1602**0.5}
    rows = spark.createDataFrame(list(t), "t double, df double").select("t", "df", st.t_p_value("t", "df").alias("p")).collect()
    assert all(abs(r.p / t[(r.t, r.df)] - 1) < 1e-6 for r in rows)
    c = {(3.841458821, 1.0): 0.05, (40.0, 2.0): 2.0611536224e-09, (1.0, 2.0): 0.60653066, (18.307038053, 10.0): 0.05}
    rows = spark.createDataFrame(list(c), "x double, df double").select("x", "df", st.chi2_p_value("x", "df").alias("p")).collect()
    assert all(abs(r.p / c[(r.x, r.df)] - 1) < 1e-6 for r in rows)
    rows = spark.createDataFrame([(1.959963985,), (5.0,)], "z double").select(st.normal_p_value("z").alias("p"), st.normal_quantile(points.F.lit(0.975)).alias("q")).collect()
    assert abs(rows[0].p - 0.05) < 1e-9 and abs(rows[1].p / 5.733031437e-07 - 1) < 1e-6 and abs(rows[0].q - 1.959963985) < 1e-8


def test_grouped_models_equal_plain_numpy(spark):
    import statistics

    import numpy as np

    from voxelweave.operators import stats as st

    rng = np.random.default_rng(2)
    rows = [(int(k), "AB"[int(y)], float(v)) for k in range(2) for y, v in zip(rng.integers(0, 2, 80), rng.normal(size=80), strict=True)]
    rows = [(k, c, v + (c == "B") * 0.8 * k) for k, c, v in rows]
    df = spark.createDataFrame(rows, "region int, condition string, value double")
    got = {r.region: r for r in st.logistic(df, "region", "condition", "value", ("A", "B")).collect()}
    levels = {r.region: r for r in st.fligner(df, "region", "condition", "value").collect()}
    for k in range(2):
        x = np.array([v for r, _, v in rows if r == k])
        y = np.array([c == "B" for r, c, _ in rows if r == k], float)
        z = np.c_[np.ones_like(x), (x - x.mean()) / x.std()]
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ b))
            h = z.T @ (z * (p * (1 - p))[:, None])
            b = b + np.linalg.solve(h, z.T @ (y - p))
        assert np.allclose([got[k].intercept, got[k].slope, got[k].slope_se], [*b, np.linalg.inv(h)[1, 1] ** 0.5], atol=1e-8)
        a = np.abs(x - np.where(y > 0, np.median(x[y > 0]), np.median(x[y == 0])))
        rank = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
        q = np.array([statistics.NormalDist().inv_cdf((1 + r / (len(a) + 1)) / 2) for r in rank])
        chi = sum((g := q[y == c]).size * (g.mean() - q.mean()) ** 2 for c in (0, 1)) / q.var(ddof=1)
        assert abs(levels[k].chi2 - chi) < 1e-6


def test_tiles_with_the_shapes_and_overlaps_of_small_volumes(spark):
    cells = [(z, y, x) for z in range(5) for y in range(4) for x in range(4)]
    v = spark.createDataFrame(cells, "z int, y int, x int")
    for overlap in ((0, 1, 1), (0, 1, 2), (1, 1, 2)):
        size, shape = (1, 3, 3), (5, 4, 4)
        t = volumes.tiles(v, size, overlap, shape)
        got = sorted(tuple(r) for r in t.select("tile_z", "tile_y", "tile_x", "z", "y", "x").collect())
        tiles = itertools.product(*[range(-(-n // s)) for n, s in zip(shape, size, strict=True)])
        assert got == sorted((*i, *c) for i in tiles for c in cells if all(k * s <= p < k * s + s + o for k, s, p, o in zip(i, size, c, overlap, strict=True)))
        assert sorted(tuple(r) for r in volumes.merged_tiles(t, size, shape).collect()) == cells


def test_connected_components_of_a_small_volume(spark):
    cells = [(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 2, 1), (5, 5, 5, 1), (5, 5, 6, 2)]
    v = spark.createDataFrame(cells, "z int, y int, x int, label int")
    assert sorted(r["size"] for r in volumes.connected(v, full=False).collect()) == [1, 1, 1, 2, 2]
    assert sorted(r["size"] for r in volumes.connected(v).collect()) == [1, 1, 3, 3, 3]


def test_t_p_values(spark):
    from voxelweave.operators.stats import t_p_value

    rows = spark.createDataFrame([(0.0, 5.0), (2.0, 10.0), (2.228138852, 10.0), (None, 3.0)], "t double, df double").select(t_p_value("t", "df").alias("p")).collect()
    assert [None if r.p is None or r.p != r.p else round(r.p, 4) for r in rows] == [1.0, 0.0734, 0.05, None]


def test_near_pairs_take_the_border_in(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "blob_id long, z double, y double, x double")
    b = spark.createDataFrame([(2, 2.0, -3.0, 3.0), (3, 2.1, 0.0, 0.0)], "blob_id long, z double, y double, x double")
    assert [r.blob_id_b for r in points.near_pairs(a, b, (2, 3, 3)).collect()] == [2]


def _greedy(a, b, tol):
    used, want = set(), set()
    gap = lambda r, s: sum(abs(x - y) for x, y in zip(r[2:], s[2:], strict=True))
    for _, i, j in sorted((gap(r, s), r[0], s[0]) for r, s in itertools.product(a, b) if r[1] == s[1] and _near(r[2:], s[2:], tol)):
        if ("a", i) not in used and ("b", j) not in used:
            used |= {("a", i), ("b", j)}
            want.add((i, j))
    return want


def test_greedy_goes_on_in_crowded_places(spark):
    schema = "blob_id long, roi int, z double, y double, x double"
    a = [(i, 1, 0.0, 0.0, 0.0) for i in range(80)] + [(i, 1, 9.0, 0.0, 0.0) for i in range(80, 150)]
    b = [(i, 1, 0.0, 0.0, 0.0) for i in range(75)] + [(i, 1, 9.0, 1.0, 0.0) for i in range(75, 160)]
    got = points.greedy_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), (2, 3, 3), ("roi",))
    assert {(r.a, r.b) for r in got.collect()} == _greedy(a, b, (2, 3, 3)) and got.count() == 145


def test_greedy_with_ties_between_places(spark):
    rng = random.Random(3)
    schema = "blob_id long, roi int, z double, y double, x double"
    a, b = ([(i, rng.randrange(2), *(float(rng.randrange(3)) for _ in range(3))) for i in rng.sample(range(500), n)] for n in (90, 70))
    got = points.greedy_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), (1, 1, 2), ("roi",))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(_greedy(a, b, (1, 1, 2)))
    assert points.greedy_matches(spark.createDataFrame(a, schema), spark.createDataFrame([], schema), (1, 1, 2)).collect() == []


def test_closure_of_a_deep_tree_and_a_cycle(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(19)], "id long, parent long")
    assert hierarchy.closure(tree).filter("descendant = 18").count() == 19
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))


def test_copies_of_points_are_never_broadcast(spark):
    p = spark.range(50).selectExpr("id as blob_id", "cast(id % 2 as int) as channel", "cast(id as double) as z", "0d as y", "0d as x", "1 as confirmed")
    boxes = spark.range(5).selectExpr("id as roi_id", "0 as z0", "0 as y0", "0 as x0", "6 as nz", "40 as ny", "60 as nx")
    v = p.selectExpr("cast(z as int) as z", "cast(y as int) as y", "cast(x as int) as x", "1d as atlas")
    mean = lambda patches: patches.map(len)
    for d in (points.near_pairs(p, p, (2, 3, 3)), matching.in_rois(p, boxes), matching.colocalized(p, 4.0), matching.scored_patches(p, v, 2, mean)):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_at_the_tolerance_and_far_from_zero(spark):
    rng = random.Random(3)
    rows = [(i, *(rng.choice((0.0, -1e6, 1e9)) + rng.randrange(-60, 60) / 10 for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, z double, y double, x double")
    for tol in ((0.3, 0.6, 1.1), (2, 3, 3), (0, 50, 5)):
        got = sorted((r.i_a, r.i_b) for r in points.near_pairs(df, df, tol).collect())
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if _near(a[1:], b[1:], tol))


def test_channel_matches_are_one_pass_and_equal_each_pair_alone(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(3), *(rng.random() * n for n in (8, 30, 30))) for i in range(150)]
    df = spark.createDataFrame(rows, "blob_id long, channel int, z double, y double, x double")
    boxes = spark.createDataFrame([(0, 0, 0, 0, 6, 20, 20), (1, 2, 8, 9, 5, 18, 20)], "roi_id long, z0 int, y0 int, x0 int, nz int, ny int, nx int")
    found = matching.channel_matches(df, boxes, (2, 3, 3), [0, 1, 2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("MapInArrow") == 1 and "CoGroup" not in plan
    got = {tuple(r) for r in found.collect()}
    want = {(r.roi_id, low, high, r.b, r.a, r.dist) for low, high in ((0, 1), (0, 2), (1, 2)) for r in matching.roi_matches(df.filter(f"channel = {high}"), df.filter(f"channel = {low}"), boxes, (2, 3, 3)).collect()}
    assert got == want and len({g[:3] for g in got}) > 1


def test_nearest_compares_few_pairs_where_points_are_dense(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, *(rng.randrange(40) / 8 for _ in range(3))) for i in range(900)] + [(900 + i, 9.0, 9.0, 9.0) for i in range(400)] + [(2000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "blob_id long, z double, y double, x double")
    radii, pairs = [], points.near_pairs
    monkeypatch.setattr(points, "near_pairs", lambda a, b, t, *more: radii.append(t[0]) or pairs(a, b, t, *more))
    got = {r.blob_id: r.dist for r in points.nearest(df, 5, 6.0, points.AXES, "blob_id").collect()}
    dist = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[1:], q[1:], strict=True)) ** 0.5
    want = {p[0]: sorted(dist(p, q) for q in rows[:-1])[4] for p in rows[:-1]}
    assert got.pop(2000) is None
    assert got == pytest.approx(want)
    assert radii[0] < 6.0
