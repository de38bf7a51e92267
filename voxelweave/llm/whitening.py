"""Embedding whitening by an incremental eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, free, fresh

EPS = np.finfo(np.float64).eps
#: Scale and origin of the whole numbers that stand for a vector's entries.
SCALE, ORIGIN = 64.0, 1_000_000


def whole_numbers(raw: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * raw.astype(np.float64)).astype(np.int64) + ORIGIN


def _secular_roots(low: np.ndarray, z: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z_k^2 / (low_k - mu)) = 0, one above each active pole.

    Returns the roots and ``D[lane, root, pole]`` = pole - root, which is exact
    to a few bits as each root is sought as its distance from the nearer pole.
    Each step fits a rational function with the two poles around the root and
    falls back to bisection where it leaves the bracket.
    """
    lanes, d = low.shape
    z2 = z * z
    up = np.full((lanes, d + 1), np.inf)
    up[:, :d] = np.where(on, low, np.inf)
    up = np.minimum.accumulate(up[:, ::-1], axis=1)[:, ::-1][:, 1:]  # next active pole
    last = on & ~np.isfinite(up)
    up = np.where(last, low + z2.sum(axis=1, keepdims=True), up)
    up = np.where(on, up, low + 1.0)
    width = up - low
    both = on[:, :, None] & on[:, None, :]
    from_low = low[:, None, :] - low[:, :, None]
    tidy = lambda t: np.where(both, t, np.where(on[:, :, None], np.inf, 1.0))
    half = width / 2
    middle = 1 + (z2[:, None, :] / (tidy(from_low) - half[:, :, None])).sum(axis=2)
    right = (middle < 0) & ~last  # nearer to the upper pole
    begin = np.where(right, up, low)
    poles = tidy(np.where(right[:, :, None], low[:, None, :] - up[:, :, None], from_low))
    upper = np.where(right, 0.0, width)  # of the upper pole, from ``begin``
    lower = np.where(right, -width, 0.0)
    a = np.where(right, -half, np.where(last & (middle < 0), half, 0.0))
    b = np.where(right, 0.0, np.where(last & (middle < 0), width * (1 + 4 * EPS), half))
    w = np.where(on, (a + b) / 2, 0.0)
    below = np.tril(np.ones((d, d)))
    todo = on.copy()
    for _ in range(90):
        gap = poles - w[:, :, None]
        part = z2[:, None, :] / gap
        slope = part / gap
        f = 1 + part.sum(axis=2)
        psi = np.einsum("lik,ik->li", slope, below)
        phi = slope.sum(axis=2) - psi
        todo &= (np.abs(f) > 2 * d * EPS * (1 + np.abs(part, out=part).sum(axis=2))) & (b - a > 2 * EPS * np.abs(w))
        if not todo.any():
            break
        a, b = np.where(todo & (f < 0), w, a), np.where(todo & (f >= 0), w, b)
        g, h = lower - w, upper - w
        s, t = g * g * psi, h * h * phi
        c = f - g * psi - h * phi
        p, q = c * (g + h) + s + t, g * h * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
        step = np.where(last, g + s / c, step)
        to = w + step
        w = np.where(todo, np.where((to > a) & (to < b), to, (a + b) / 2), w)
    return np.where(on, begin + w, low), poles - w[:, :, None]


class Spectra:
    """Scatter matrices of several lanes, side by side, as ascending eigenvalues and eigenvectors.

    Each lane has the number of its rows, their mean and the spectrum of the
    sum of (row - mean)(row - mean)'. Lanes are updated together, so that the
    array operations of an update cost little more than its arithmetic.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, lanes: int, d: int) -> Spectra:
        return cls(np.zeros(lanes), np.zeros((lanes, d)), np.zeros((lanes, d)), np.repeat(np.eye(d)[None], lanes, axis=0))

    def lanes(self, which: slice) -> Spectra:
        return Spectra(self.n[which], self.mean[which], self.values[which], self.vectors[which])

    def add(self, x: np.ndarray, m: np.ndarray) -> None:
        """``m[lane]`` rows whose mean is ``x[lane]``: one centred rank-one update (none where m is 0)."""
        total = np.maximum(self.n + m, 1)
        apart = np.where(m[:, None] > 0, x - self.mean, 0.0)
        self.rank_one(apart * np.sqrt(self.n * m / total)[:, None])
        self.mean = np.where((self.n == 0)[:, None] & (m > 0)[:, None], x, self.mean + apart * (m / total)[:, None])
        self.n = self.n + m

    def rank_one(self, v: np.ndarray) -> None:
        """The spectra of M + vv'."""
        q, low = self.vectors, self.values
        z = np.matmul(v[:, None, :], q)[:, 0]
        size = np.sqrt((z * z).sum(axis=1))
        tol = (8 * EPS * np.maximum(low[:, -1], size * size))[:, None]
        z = np.where(np.abs(z) * size[:, None] <= tol, 0.0, z)  # deflation: v is orthogonal to the eigenvector
        low, z, q = self._merged(low, z, q, tol[:, 0])
        on = z != 0
        if not on.any():
            return
        with np.errstate(all="ignore"):
            roots, gap = _secular_roots(low, z, on)
            both = on[:, :, None] & on[:, None, :]
            # weights for which the computed roots are exact, so that the vectors are orthogonal (Loewner's formula)
            apart = low[:, :, None] - low[:, None, :]
            i = np.arange(low.shape[1])
            apart[:, i, i] = 1.0
            z = np.sign(z) * np.sqrt(np.where(both, np.abs(gap / apart), 1.0).prod(axis=1))
            u = np.where(both, z[:, None, :] / gap, 0.0)
            u = u / np.sqrt((u * u).sum(axis=2, keepdims=True))
        u = np.where(on[:, :, None], u, np.eye(low.shape[1])[None])
        q = np.matmul(q, u.transpose(0, 2, 1))
        if (np.diff(roots, axis=1) < 0).any():
            order = np.argsort(roots, axis=1, kind="stable")
            roots, q = np.take_along_axis(roots, order, axis=1), np.take_along_axis(q, order[:, None, :], axis=2)
        self.values, self.vectors = roots, q

    @staticmethod
    def _merged(low: np.ndarray, z: np.ndarray, q: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deflation of equal eigenvalues: a rotation in their plane leaves one of two weights."""
        lanes, d = low.shape
        at = np.where(z != 0, np.arange(d), -1)
        before = np.concatenate([np.full((lanes, 1), -1), np.maximum.accumulate(at, axis=1)[:, :-1]], axis=1)
        gap = low - np.take_along_axis(low, np.maximum(before, 0), axis=1)
        if not ((z != 0) & (before >= 0) & (gap * 0.5 <= tol[:, None])).any():
            # the coupling is at most half the gap; the exact one is taken below only where that might deflate
            weight = np.abs(z) * np.abs(np.take_along_axis(z, np.maximum(before, 0), axis=1))
            both = z * z + np.take_along_axis(z, np.maximum(before, 0), axis=1) ** 2
            if not ((z != 0) & (before >= 0) & (weight * gap <= tol[:, None] * both)).any():
                return low, z, q
        low, z, q = low.copy(), z.copy(), q.copy()
        last, every = np.full(lanes, -1), np.arange(lanes)
        for i in range(d):
            here = z[:, i] != 0
            p = np.maximum(last, 0)
            zp, zi = z[every, p], z[:, i]
            r2 = zp * zp + zi * zi
            turn = here & (last >= 0) & (np.abs(zp * zi) * (low[:, i] - low[every, p]) <= tol * r2)
            if turn.any():
                k, pk = np.flatnonzero(turn), p[turn]
                r = np.sqrt(r2[turn])
                c, s = zi[turn] / r, zp[turn] / r
                z[k, pk], z[k, i] = 0.0, r
                lp, li = low[k, pk], low[k, i]
                low[k, pk], low[k, i] = c * c * lp + s * s * li, s * s * lp + c * c * li
                qp, qi = q[k, :, pk], q[k, :, i]
                q[k, :, pk], q[k, :, i] = c[:, None] * qp - s[:, None] * qi, s[:, None] * qp + c[:, None] * qi
            last = np.where(here, i, last)
        return low, z, q

    def absorb(self, other: Spectra) -> None:
        """Lane by lane: the rows of both, by a rank-one update for each eigenvector of the other and one for the means."""
        for i in range(self.values.shape[1]):
            self.rank_one(np.sqrt(np.maximum(other.values[:, i], 0))[:, None] * other.vectors[:, :, i])
        self.add(other.mean, other.n)

    def one(self) -> Spectra:
        """All lanes as one, pair by pair; the number of lanes is a power of two."""
        found = self
        while (k := len(found.n) // 2) >= 1:
            left, right = found.lanes(slice(0, k)), found.lanes(slice(k, None))
            left.absorb(right)
            found = left
        return found


@dataclass
class Whitening:
    """``total``: exact sums per dimension; ``axes[:, i]``: the component of ``values[i]``, falling."""

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The means' whole part and the rest, so that x - mean loses nothing."""
        part = [divmod(s, max(self.n, 1)) for s in self.total]
        return np.array([a for a, _ in part], np.int64), np.array([b / max(self.n, 1) for _, b in part])

    def centred(self, x: np.ndarray) -> np.ndarray:
        a, b = self.mean
        return (x - a).astype(np.float64) - b

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN on components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.axes * np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    e = F.col(column)
    return vectors.filter(e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _arrays(batch: pa.RecordBatch, column: int, d: int, rows: int = 4096) -> Iterator[tuple[slice, np.ndarray]]:
    for i in range(0, batch.num_rows, rows):
        raw = batch.column(column).slice(i, rows).flatten().to_numpy(zero_copy_only=False)
        yield slice(i, i + rows), whole_numbers(raw.reshape(-1, d))


def _combined(spectra: DataFrame, d: int, fan: int) -> tuple[int, list[int], np.ndarray] | None:
    """One spectrum of all, ``fan`` of them in a task at a time; each round is written to the shared folder."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        k = 1 << (table.num_rows - 1).bit_length()
        s = Spectra.empty(k, d)
        n = table.column("n").to_numpy()
        s.n[: len(n)] = n
        for to, name in ((s.mean, "mean"), (s.values, "low"), (s.vectors, "axes")):
            for i, raw in enumerate(table.column(name).to_pylist()):
                to[i] = np.frombuffer(raw).reshape(to.shape[1:])
        s = s.one()
        total = [sum(int(t[j]) for t in table.column("total").to_pylist()) for j in range(d)]
        return _row(table.column("part")[0].as_py() // fan, int(n.sum()), total, s)

    rows = cut(spectra)
    while True:
        parts = rows.agg(F.max("part")).first()[0]
        if parts is None:
            return None
        if parts == 0:
            break
        old, rows = rows, cut(rows.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(merge, SPECTRUM))
        free(old)
    r = rows.first()
    return r.n, r.total, np.frombuffer(r.axes).reshape(d, d)


SPECTRUM = "part long, n long, total array<long>, mean binary, low binary, axes binary"


def _row(part: int, n: int, total: list[int], s: Spectra) -> pa.Table:
    return pa.table({
        "part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.list_(pa.int64())),
        "mean": pa.array([s.mean[0].tobytes()], pa.binary()), "low": pa.array([s.values[0].tobytes()], pa.binary()), "axes": pa.array([s.vectors[0].tobytes()], pa.binary()),
    })


def _products(data: DataFrame, size: int, project) -> np.ndarray:
    """The sum over all rows of the outer products of ``project(x)``: a matrix from each task, summed by Spark entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _arrays(batch, 0, d):
                y = project(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    d = data.first()
    if d is None:
        return np.zeros((size, size))
    d = len(d[0])
    sums = data.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size * size)
    for r in sums.collect():  # size * size entries, whatever the number of rows
        out[r["at"]] = r.v
    return out.reshape(size, size)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 32, lanes: int = 4, fan: int = 16) -> Whitening:
    """The principal axes of all usable vectors' whole numbers.

    1. Each task takes its rows one after another, dealt to ``lanes``, into a
    spectrum by centred rank-one updates: the secular equation gives the new
    eigenvalues; what doesn't change is deflated. It returns one row. 2. Spectra
    are combined by successive rank-one updates, ``fan`` in a task at a time,
    until there is one. 3. One pass over all rows projects them, centred by
    the exact mean, on that basis; the eigenvectors of the small product
    matrix turn the basis into the components (Rayleigh-Ritz), which removes
    the rounding of the updates. The driver holds one d x d matrix.
    """
    data = _usable(vectors, column).select(F.col(column).alias("e"))
    length = data.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d = length.d
    data = data.filter(F.size("e") == d)

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n, total, none = Spectra.empty(lanes, d), 0, [0] * d, True
        for batch in batches:
            for _, x in _arrays(batch, 0, d):
                none = False
                n += len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
                there = np.ones(lanes)
                for i in range(0, len(x), lanes):
                    some = (x[i : i + lanes] - ORIGIN).astype(np.float64)
                    if len(some) < lanes:
                        there = (np.arange(lanes) < len(some)).astype(np.float64)
                        some = np.concatenate([some, np.zeros((lanes - len(some), d))])
                    s.add(some, there)
        if not none:
            yield from _row(TaskContext.get().partitionId(), n, total, s.one()).to_batches()

    found = _combined(data.mapInArrow(spectra, SPECTRUM), d, fan)
    n, total, basis = found
    basis = np.linalg.qr(basis)[0]  # the updates' rounding
    model = Whitening(n, [int(t) for t in total], np.zeros(d), basis, 0.0)
    ritz = _products(data, d, lambda x: model.centred(x) @ basis) / n
    e, u = np.linalg.eigh(ritz)
    axes = (basis @ u)[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(ritz))
    values = e[::-1][:components]
    return Whitening(n, model.total, np.where(values > 1e-12 * max(trace, 0), values, 0.0), axes, trace)


def whiten(vectors: DataFrame, model: Whitening | None = None, column: str = "embedding", components: int = 32) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> vec_id, component, n, deviation, whitened, explained, identity_error.

    A row for each usable vector and each of the first ``components`` principal
    axes (all, if there are fewer dimensions). Vectors that are null, empty or
    hold null or non-finite entries are left out, and so are those of another
    length than the most frequent one (the shorter of equals). Repeated rows
    and vec_ids count and are returned each; vec_id may be null; no usable rows
    give no rows; other columns are ignored. ``whitened`` is null on an axis
    without variance, ``explained`` if nothing varies; ``deviation`` is exact,
    and null beyond the range of a long. ``identity_error``: the largest
    absolute entry of the whitened rows' covariance, found by a pass of its own,
    minus the identity, over the axes with variance (null without any).
    """
    model = fit(vectors, column, components) if model is None else model
    d, k = len(model.total), len(model.values)
    out = fresh("e", ["vec_id"])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    data = _usable(vectors, column).filter(F.size(column) == d).select(F.col("vec_id").cast("long"), F.col(column).alias(out))
    real = np.flatnonzero(model.values > 0)
    error = None
    if len(real):
        covariance = _products(data.select(out), len(real), lambda x: model.whitened(x)[:, real]) / model.n
        error = float(np.abs(covariance - np.eye(len(real))).max())
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def deviations(x: np.ndarray) -> list[int | None]:
        far = max(abs(model.n * int(x.max()) - min(model.total)), abs(model.n * int(x.min()) - max(model.total)))
        if far * far * d < 2**63:
            return ((model.n * x - np.array(model.total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((model.n * a - b) ** 2 for a, b in zip(row, model.total, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _arrays(batch, 1, d):
                y, m = model.whitened(x).ravel(), len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at.start, m).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(y, mask=np.isnan(y)),
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * k), kinds[6]),
                    ],
                    names=names,
                )

    return data.mapInArrow(rows, schema)
