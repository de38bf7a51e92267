import json

import numpy as np
import pytest

from voxelweave.sources import files


def test_files_round_trip(spark, tmp_path):
    tree = {"msg": [{"id": 1, "name": "root", "st_level": 0, "children": [{"id": 2, "name": "a", "st_level": 1, "parent_structure_id": 1, "children": []}]}]}
    (tmp_path / "o.json").write_text(json.dumps(tree))
    assert sorted((r.id, r.level, r.parent) for r in files.read_ontology_json(spark, str(tmp_path / "o.json")).collect()) == [(1, 0, None), (2, 1, 1)]
    (tmp_path / "o.csv").write_text("id,name,parent\n1,root,\n2,,1\n")
    assert sorted((r.id, r.name, r.level, r.parent) for r in files.read_ontology_csv(spark, str(tmp_path / "o.csv")).collect()) == [(1, "root", 1, None), (2, "2", 1, 1)]
    (tmp_path / "l.txt").write_text('# comment\n  7 1 2 3 0.5 1 0 "some region"\n')
    assert [(r.id, r.a, r.name) for r in files.read_label_description(spark, str(tmp_path / "l.txt")).collect()] == [(7, 0.5, "some region")]
    np.arange(24, dtype="<u2").reshape(2, 3, 4).tofile(tmp_path / "v.raw")
    assert sorted((r.z, r.y, r.x, r.value) for r in files.read_raw_volume(spark, str(tmp_path / "v.raw"), "<u2", (2, 3, 4)).collect())[-1] == (1, 2, 3, 23.0)
    files.write_points(spark.createDataFrame([(1, 2, 3, 0.5)], "z int, y int, x int, radius double"), str(tmp_path / "p.csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p.csv")).collect()] == [("1", "2", "3", "0.5")]
    a = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    files.write_csv([a], str(tmp_path / "a"), ["k"])
    assert sorted((r.k, r.v) for r in files.merge_csvs(spark, [str(tmp_path / "a")]).collect()) == [("1", "x"), ("2", "NaN")]


def test_deep_ontology_planes_and_records(spark, tmp_path):
    tree = None
    for i in range(40, 0, -1):
        tree = {"id": i, "name": str(i), "parent_structure_id": i - 1 or None, "children": [tree] if tree else []}
    (tmp_path / "o.json").write_text(json.dumps({"msg": [tree]}))
    assert sorted((r.id, r.parent) for r in files.read_ontology_json(spark, str(tmp_path / "o.json")).collect()) == [(i, i - 1 or None) for i in range(1, 41)]
    (tmp_path / "p").mkdir()
    for name in ("a_ch_1.tif", "b_ch_1.tif", "a_ch_0.tif", "x.tif"):
        (tmp_path / "p" / name).write_bytes(b"0")
    got = sorted((r.channel, r.z, r.path.rsplit("/", 1)[1]) for r in files.read_planes(spark, str(tmp_path / "p")).collect())
    assert got == [(0, 0, "a_ch_0.tif"), (0, 1, "x.tif"), (1, 0, "a_ch_1.tif"), (1, 1, "b_ch_1.tif")]
    assert [tuple(r) for r in files.records(spark, {"a": [1, 2], "b": ["x", None]}, {"b": "B", "a": "A"}).collect()] == [("x", 1), (None, 2)]
    (tmp_path / "bad.txt").write_text("7 1 2\n")
    try:
        files.read_label_description(spark, str(tmp_path / "bad.txt")).collect()
    except Exception as e:
        assert "not a label description" in str(e)
    else:
        raise AssertionError("a bad line was taken")


def test_planes_become_a_volume(spark, tmp_path):
    rng = np.random.default_rng(2)
    planes = {(c, z): rng.integers(0, 9, (5, 7)).astype("<u2") for c in (0, 3) for z in range(2)}
    folder = tmp_path / "planes"
    folder.mkdir()
    for (c, z), a in planes.items():
        np.save(folder / f"plane{z}_ch_{c}.npy", a)
        a.tofile(folder / f"plane{z}_ch_{c}.raw")
    (folder / "notes.txt").write_text("no plane")
    want = sorted((c, z, y, x, float(a[y, x])) for (c, z), a in planes.items() for y in range(5) for x in range(7))
    assert sorted(tuple(r) for r in files.read_plane_volume(spark, str(folder)).collect()) == want
    assert sorted(tuple(r) for r in files.read_plane_volume(spark, str(folder), "<u2", (5, 7), suffix=".raw").collect()) == want
    with pytest.raises(Exception, match="not a plane: .*raw"):
        files.read_plane_volume(spark, str(folder), "<u2", (5, 8), suffix=".raw").collect()
    with pytest.raises(Exception, match="not a plane: .*notes.txt"):
        files.read_plane_volume(spark, str(folder), suffix=".txt").collect()
    np.save(folder / "wide_ch_1.npy", np.ones((2, 300_000), "u1"))
    wide = files.read_plane_volume(spark, str(folder)).filter("channel = 1")
    assert wide.agg({"value": "sum", "y": "max", "x": "max"}).select("sum(value)", "max(y)", "max(x)").first() == (600_000.0, 1, 299_999)
