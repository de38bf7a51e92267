"""Joins of tables that grow: small files may hold many rows, so no side goes whole through the driver, however small it is taken to be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import detection, matching, points, store, volumes
from voxelweave.plans.tables import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    seen = []
    for module in (points, store):
        monkeypatch.setattr(module, "cut", lambda df: seen.append(plan(df)) or cut(df))
    return seen


def placed(spark, n=40, step=3):
    i = F.col("id")
    return spark.range(n).select(i.alias("blob_id"), (i % 4).cast("int").alias("channel"), (i % step).cast("double").alias("z"), (i % 7).cast("double").alias("y"), (i % 5).cast("double").alias("x"))


def test_pruning_of_tiles_broadcasts_nothing(spark, plans):
    points.pruned_tiles(placed(spark), (2, 3, 3), (1, 1, 1), (1, 1, 1))
    assert len(plans) == 3 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_detection_broadcasts_nothing(spark, plans):
    blobs = placed(spark).dropDuplicates(["z", "y", "x"]).withColumn("radius", F.lit(1.5))
    kept = detection.without_overlaps(blobs, 1.5, 0.1)
    points.greedy_matches(placed(spark), placed(spark, 30, 2), (1, 1, 1))
    assert len(plans) > 8 and not [p for p in [*plans, plan(kept)] if "BroadcastHashJoin" in p]


def test_loads_of_the_store_broadcast_nothing(spark, plans):
    i = F.col("id")
    box = [i.alias("experiment"), F.lit(0).alias("series"), F.lit(1).alias("z0"), F.lit(2).alias("y0"), F.lit(3).alias("x0")]
    place = lambda n: [F.lit(float(n)).alias("z"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit(-1).alias("truth"), F.lit(n).alias("channel")]
    few = spark.range(5)
    both = few.select(*box, *place(0)).unionByName(few.select(*box, *place(1))).withColumns({"radius": F.lit(1.0), "confirmed": F.lit(1)})
    pairs = few.select(*box, F.struct(*place(0)).alias("one"), F.struct(*place(1)).alias("two"), F.lit(0.5).alias("dist"))
    boxes = few.select(*box, *[F.lit(9).alias(c) for c in ("nz", "ny", "nx")])
    once = store.inserted(store.empty(spark), boxes, both, pairs)
    again = store.inserted(once, boxes, both, pairs)
    assert (again.boxes.count(), again.points.count(), again.matches.count()) == (5, 10, 5)
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sent if "_all" not in line]  # starts of ranges, one row each


def test_sums_of_boxes_are_of_places(spark):
    i = F.col("id")
    boxes = spark.range(2).select(i.alias("roi_id"), *[(i * 2).cast("int").alias(f"{c}0") for c in ("z", "y", "x")], *[F.lit(2).alias(c) for c in ("nz", "ny", "nx")])
    v = spark.range(100).select(*[F.lit(1).alias(c) for c in ("z", "y", "x")], i.cast("double").alias("atlas"))
    out = matching.roi_table(boxes, placed(spark).withColumn("confirmed", F.lit(1)), v, 1.0)
    assert plan(out).count("partial_sum(atlas") == 2
    assert {r.roi_id: r.intensity for r in out.collect()} == {0: 4950.0, 1: 0.0}


def test_sizes_of_masks_take_one_grouping(spark):
    a, b = placed(spark), placed(spark, 30, 2)
    n = {r.how: r.n for r in volumes.mask_sizes(a, b).collect()}
    assert n == {how: volumes.combined_masks(a, b, how).count() for how in ("and", "or", "xor", "not")} and n["and"] and n["not"]
    assert plan(volumes.mask_sizes(a, b)).count("Exchange hashpartitioning(z") == 1
    assert {r.n for r in volumes.mask_sizes(a.limit(0), b.limit(0)).collect()} == {0}


def test_erosion_shuffles_voxels_once(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((9, 8, 7)) < 0.95, rng.integers(1, 3, (9, 1, 1)), 0)
    a[:, :, 3:] = np.where(a[:, :, 3:] > 0, 2, 0)
    rows = [(int(z) - 4, int(y) + 2, int(x), int(a[z, y, x])) for z, y, x in np.ndindex(a.shape)]
    v = spark.createDataFrame(rows, "z int, y int, x long, label int")
    at = {r[:3]: r[3] for r in rows}
    for radius in (1, 2):
        r = range(-radius, radius + 1)
        ball = [(i, j, k) for i in r for j in r for k in r if i * i + j * j + k * k <= radius * radius]
        want = {(*p, x) for p, x in at.items() if x and all(at.get(tuple(map(sum, zip(p, o)))) == x for o in ball)}  # noqa: B905
        got = volumes.eroded(v, "label", radius)
        assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got)
        assert want and {tuple(r) for r in got.collect()} == want and got.dtypes == v.dtypes
    assert volumes.eroded(v.filter("label = 0"), "label").count() == 0


def test_intensities_are_combined_before_any_sort(spark):
    i = F.col("id")
    v = spark.range(60).select(*[(i % n).cast("int").alias(c) for c, n in (("z", 3), ("y", 4), ("x", 5))], (i % 2).cast("int").alias("channel"), i.cast("double").alias("atlas"))
    got = matching.colocalized_by_intensity(placed(spark), v, [0, 1])
    assert "SortAggregate" not in plan(got) and "partial_sum(atlas" in plan(got)
    owner = {}
    for p in placed(spark).collect():
        for z, y, x in np.ndindex(5, 5, 5):
            if (z - 2) ** 2 + (y - 2) ** 2 + (x - 2) ** 2 <= 4:
                at = (int(p.z) + z - 2, int(p.y) + y - 2, int(p.x) + x - 2)
                owner[at] = max(owner.get(at, (-1, 0)), (p.blob_id, p.channel))
    held = {}
    for r in v.collect():
        if at := owner.get((r.z, r.y, r.x)):
            held.setdefault((*at, r.channel), []).append(r.atlas)
    mean = {k: sum(x) / len(x) for k, x in held.items()}
    least = {c: min(m for (_, own, channel), m in mean.items() if own == channel == c) for c in (0, 1)}
    assert {tuple(r) for r in got.collect()} == {(b, c, int(m >= least[c])) for (b, _, c), m in mean.items()}
