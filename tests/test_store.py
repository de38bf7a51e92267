"""The experiment store: keyed writes, ids that stay, matches resolved by place."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences, duck
from voxelweave.operators import store as st
from voxelweave.plans.queries import ORACLE_SQL, QUERIES

BOXES = "experiment long, series int, z0 int, y0 int, x0 int, nz int, ny int, nx int"
POINTS = "experiment long, series int, z0 int, y0 int, x0 int, z int, y int, x int, truth int, channel int, radius double, confirmed int"
SPOT = "struct<z:int, y:int, x:int, truth:int, channel:int>"
MATCHES = f"experiment long, series int, z0 int, y0 int, x0 int, one {SPOT}, two {SPOT}, dist double"


def load(spark, store, boxes=(), points=(), matches=()):
    return st.inserted(store, spark.createDataFrame(list(boxes), BOXES), spark.createDataFrame(list(points), POINTS), spark.createDataFrame(list(matches), MATCHES))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_known_rows_keep_their_ids_and_take_new_values(spark):
    box = (5, None, 0, 0, 0)
    a, b = (1, 2, 3, -1, 0), (1, 2, 4, -1, 1)
    one = load(spark, st.empty(spark), [(*box, 9, 9, 9)], [(*box, *a, 2.0, -1), (*box, *b, 2.0, 0)], [(*box, a, b, 1.0)])
    assert rows(one.boxes) == [(1, 5, 0, 0, 0, 0, 9, 9, 9)]
    assert rows(one.points) == [(1, 1, 1.0, 2.0, 3.0, -1, 0, 2.0, -1), (2, 1, 1.0, 2.0, 4.0, -1, 1, 2.0, 0)]
    assert rows(one.matches) == [(1, 1, 1, 2, 1.0)]
    other = (4, 1, 0, 0, 0)
    c = (0, 0, 0, None, 0)
    two = load(spark, one, [(*box, 8, 8, 8), (*other, 1, 1, 1)], [(*box, *a, 3.0, 1), (*other, *c, 1.0, 0), (*other, *c, 1.5, 0), (99, 0, 0, 0, 0, *a, 1.0, 1)], [(*box, a, b, 0.5), (*box, a, c, 7.0), (*other, c, c, 0.0)])
    assert rows(two.boxes) == [(1, 5, 0, 0, 0, 0, 8, 8, 8), (2, 4, 1, 0, 0, 0, 1, 1, 1)]
    assert rows(two.points) == [(1, 1, 1.0, 2.0, 3.0, -1, 0, 3.0, 1), (2, 1, 1.0, 2.0, 4.0, -1, 1, 2.0, 0), (3, 2, 0.0, 0.0, 0.0, None, 0, 1.5, 0)]
    assert rows(two.matches) == [(1, 1, 1, 2, 0.5), (2, 2, 3, 3, 0.0)]
    same = load(spark, two)
    assert [rows(x) for x in (same.boxes, same.points, same.matches)] == [rows(x) for x in (two.boxes, two.points, two.matches)]


def test_many_loads_equal_a_dictionary(spark):
    rng = random.Random(3)
    store, boxes, points = st.empty(spark), {}, {}
    for n in range(3):
        places = [(rng.randrange(2), rng.randrange(2), 0, 0, rng.randrange(3)) for _ in range(4)]
        new_boxes = {p: (n, n, n) for p in places}
        new_points: dict = {}
        for _ in range(60):
            k = (rng.choice(places), (rng.randrange(2), 0, rng.randrange(4), -1, rng.randrange(2)))
            new_points[k] = max(new_points.get(k, (-1.0, 0)), (float(rng.randrange(50)), rng.randrange(2)))
        store = load(spark, store, [(*p, *x) for p, x in new_boxes.items()], [(*p, *q, *x) for (p, q), x in new_points.items()])
        for p in sorted(new_boxes):
            boxes[p] = (boxes[p][0] if p in boxes else len(boxes) + 1, new_boxes[p])
        for p, q in sorted(new_points, key=lambda k: (boxes[k[0]][0], k[1])):
            key = (boxes[p][0], *q)
            points[key] = (points[key][0] if key in points else len(points) + 1, new_points[p, q])
    assert rows(store.boxes) == sorted(((i, *p, *x) for p, (i, x) in boxes.items()), key=repr)
    assert rows(store.points) == sorted(((i, k[0], *map(float, k[1:4]), *k[4:], *x) for k, (i, x) in points.items()), key=repr)


def test_further_columns_tell_boxes_of_a_place_apart(spark):
    box = (5, None, 0, 0, 0)
    boxes = lambda n, *names: spark.createDataFrame([(*box, n, n, n, x) for x in names], f"{BOXES}, name string")
    dots = spark.createDataFrame([(*box, 1, 2, 3, -1, 0, r, 0, x) for r, x in ((1.0, "b"), (2.0, "c"), (3.0, "none"))], f"{POINTS}, name string")
    links = spark.createDataFrame([(*box, (1, 2, 3, -1, 0), (1, 2, 3, -1, 0), 0.5, "c")], f"{MATCHES}, name string")
    one = st.inserted(st.empty(spark, "name string"), boxes(1, "b", "c"), dots, links)
    two = st.inserted(one, boxes(2, "a", "c"), dots.limit(0), links.limit(0))
    assert rows(one.boxes) == [(1, 5, 0, 0, 0, 0, 1, 1, 1, "b"), (2, 5, 0, 0, 0, 0, 1, 1, 1, "c")]
    assert rows(two.boxes) == [(1, 5, 0, 0, 0, 0, 1, 1, 1, "b"), (2, 5, 0, 0, 0, 0, 2, 2, 2, "c"), (3, 5, 0, 0, 0, 0, 2, 2, 2, "a")]
    assert rows(two.points) == [(1, 1, 1.0, 2.0, 3.0, -1, 0, 1.0, 0), (2, 2, 1.0, 2.0, 3.0, -1, 0, 2.0, 0)]
    assert rows(two.matches) == [(1, 2, 2, 2, 0.5)]


@pytest.mark.parametrize("name", ["store_boxes", "store_points", "store_matches"])
def test_suppliers_of_one_nation_and_place_keep_boxes_of_their_own(spark, tmp_path, name):
    small = "/root/testdata/sf0.001"
    for t in os.listdir(small):
        if t != "supplier.parquet":
            os.symlink(f"{small}/{t}", tmp_path / t)
    supplier = spark.read.parquet(f"{small}/supplier.parquet")
    again = lambda n: supplier.withColumn("s_suppkey", F.col("s_suppkey") + 14620 * n)  # noqa: E731  # places repeat after so many
    again(0).unionByName(again(1)).unionByName(again(2).filter("s_suppkey % 2 = 0")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) and not differences(got, duck(str(tmp_path)).execute(ORACLE_SQL[name]).df())
    if name == "store_boxes":
        assert len(got) > supplier.count() * 2
