"""Whitening: the update kernel and the operator against LAPACK, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import whitening
from voxelweave.llm.queries import QUERIES
from voxelweave.llm.whitening import Spectra
from voxelweave.plans.tables import read

SF = "/root/testdata/sf0.001"


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


@pytest.mark.parametrize("lanes", [1, 4, 8])
@pytest.mark.parametrize("kind", ["spread", "ties", "low rank", "equal", "axes"])
def test_rank_one_updates_equal_lapack(kind, lanes):
    rng = np.random.default_rng(1)
    x = {
        "spread": rng.normal(size=(150, 7)) * np.geomspace(1, 1e-4, 7),
        "ties": np.concatenate([np.eye(7) * 3, -np.eye(7) * 3] * 10),
        "low rank": rng.integers(-3, 4, size=(90, 2)) @ rng.integers(-3, 4, size=(2, 7)).astype(float),
        "equal": np.ones((30, 7)) * 5,
        "axes": np.diag([1.0, 2, 3, 4, 5, 6, 7])[rng.integers(0, 7, 61)],
    }[kind]
    s = Spectra.empty(lanes, 7)
    for i in range(0, len(x), lanes):
        some, there = x[i : i + lanes], (np.arange(lanes) < len(x) - i).astype(float)
        s.add(np.concatenate([some, np.zeros((lanes - len(some), 7))]), there)
    s = s.one()
    q, want = s.vectors[0], scatter(x)
    scale = max(np.abs(want).max(), 1.0)
    assert s.n[0] == len(x) and np.abs(s.mean[0] - x.mean(axis=0)).max() < 1e-12 * scale
    assert np.abs(q.T @ q - np.eye(7)).max() < 1e-12 and np.abs(q * s.values[0] @ q.T - want).max() < 1e-12 * scale
    assert np.abs(s.values[0] - np.linalg.eigvalsh(want)).max() < 1e-12 * scale


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    x = np.floor(64 * np.array([e for _, e in rows], np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    got = QUERIES["op11_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * n and set(got.n) == {n} and list(got.component[:32]) == list(range(1, 33))
    assert list(got.vec_id[::32]) == sorted(v for v, _ in rows)
    deviation = {v: int(z) for (v, _), z in zip(rows, ((n * x - total) ** 2).sum(axis=1), strict=True)}
    assert [deviation[v] for v in got.vec_id] == list(got.deviation)
    y = got.whitened.to_numpy().reshape(n, 32)
    order = np.argsort([v for v, _ in rows])
    want = (c @ u[:, :32] / np.sqrt(e[:32]))[order]
    assert np.abs(np.abs(y) - np.abs(want)).max() < 1e-8 and np.abs(y.T @ y / n - np.eye(32)).max() < 1e-10
    assert np.abs(got.explained[:32] / (e[:32] / e.sum()) - 1).max() < 1e-10 and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_spectra_of_many_tasks_are_combined(spark):
    data = read(spark, SF, "embeddings")
    a, b = whitening.fit(data.coalesce(1)), whitening.fit(data.repartition(13), lanes=2, fan=3)
    assert a.n == b.n and a.total == b.total and np.abs(a.axes - b.axes).max() < 1e-9 and np.abs(a.values - b.values).max() < 1e-9 * a.values[0]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, None), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 0.0, 0.0]), (6, []), (7, [1.0, 2.0]), (None, [0.0, 4.0, 2.0]), (8, [0.0, 0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("e", "n", "part", "component", "m", "total", "Whitened")])
    got = whitening.whiten(v).toPandas()
    assert sorted(got.vec_id.fillna(-1)) == [-1] * 3 + [1] * 6 + [8] * 3 and set(got.n) == {4}
    flat = got[got.component == 3]
    assert flat.whitened.isna().all() and (flat.explained.abs() < 1e-12).all() and got[got.component < 3].whitened.notna().all()
    x = np.array([[64, 0, 128], [64, 0, 128], [0, 256, 128], [0, 0, 128]])
    assert sorted(set(got.deviation)) == sorted(set(((4 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist())) and got.identity_error.max() < 1e-10
    assert whitening.whiten(v.limit(0)).collect() == []
    one = whitening.whiten(v.filter("vec_id = 8")).toPandas()
    assert list(one.deviation) == [0] * 3 and one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all()
    huge = whitening.whiten(spark.createDataFrame([(1, [2e7, 0.0]), (2, [-2e7, 0.0])], "vec_id long, embedding array<double>")).toPandas()
    assert set(huge.deviation) == {(2 * 64 * 20_000_000) ** 2} if (2 * 64 * 20_000_000) ** 2 < 2**63 else huge.deviation.isna().all()
