"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.tables import cut


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """``k`` unit centroids of the unit rows of ``x``."""
    pick = np.random.default_rng(seed).permutation(len(x))[:k]
    c = x[np.sort(pick)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return np.unique(c, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Cells:
    """Centroids for each number of cells that some label needs: one level up to ``WIDE``, beyond it a second level below each of ``WIDE``."""

    WIDE = 64

    def __init__(self, sample: np.ndarray, sizes: list[int]):
        top = {k: spherical_kmeans(sample, k) for k in {min(k, self.WIDE) for k in sizes if k > 1}} if len(sample) else {}
        self.levels: dict[int, tuple[np.ndarray, list[np.ndarray] | None]] = {}
        for k in sizes:
            if k <= 1 or not top:
                continue
            first, below = top[min(k, self.WIDE)], None
            if k > self.WIDE:
                near = (sample @ first.T).argmax(axis=1)
                below = [spherical_kmeans(own, min(k // self.WIDE, len(own))) if len(own := sample[near == i]) else first[i : i + 1] for i in range(len(first))]
            self.levels[k] = first, below

    @staticmethod
    def _step(x: np.ndarray, c: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, centroid, is it the nearest: every centroid that a vector within the angle may be nearest to."""
        s = x @ c.T
        near, at = s.argmax(axis=1), np.arange(len(s))
        apart = np.linalg.norm(c[:, None] - c[None], axis=2)
        visits = s[at, near][:, None] - s <= apart[near] * far
        visits[at, near] = True
        row, cell = np.nonzero(visits)
        return row, cell, near[row] == cell

    def visits(self, x: np.ndarray, k: int, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.levels:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        first, below = self.levels[k]
        row, cell, home = self._step(x, first, far)
        if below is None:
            return row, cell, home
        out = []
        for i in np.unique(cell):
            mine, own = row[cell == i], home[cell == i]
            r, c, h = self._step(x[mine], below[i], far)
            out.append((mine[r], i * self.WIDE + c, h & own[r]))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def vector_components(vectors: DataFrame, cosine: float = 0.98, per_cell: int = 2000, most_cells: int = 4096, sample: int = 20_000, block: int = 2048) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> one row each: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link at ``cosine`` or
    more, in double precision. Those that are null, empty, zero or hold null or
    non-finite components, and rows with a null vec_id, link with nothing; a
    null vec_id has a null component and is kept. Rows with the same label and
    vector are one class; each counts as a link of the others. Rows that repeat
    a vec_id with another vector are forms of one vector: each has the links of
    all forms and their component. No rows give no rows; other columns are ignored.

    Centroids are fitted on at most ``sample`` vectors; every vector is
    assigned. A label has a cell for each ``per_cell`` of its vectors, rounded
    to a power of two, up to ``most_cells``. A vector belongs to the cell of its
    nearest centroid and visits each cell that a vector linked with it could
    belong to: those whose bisecting hyperplane is no farther than the angle of
    ``cosine``, on both levels. So cells lose no link. Cells are cut into
    blocks; a task compares two blocks and returns counts and a spanning set
    of links, never all pairs.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    keyed = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e)
        .withColumn("fine", F.coalesce(usable & fine, F.lit(False)))
        .withColumn("k1", F.xxhash64("label", "embedding"))
        .withColumn("k2", F.xxhash64(F.lit(11), "embedding", "label"))
    )
    classes = cut(
        keyed.filter("fine")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
    )
    size = classes.groupBy("label").agg(F.count("*").alias("size"))
    wanted = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("size") / F.lit(per_cell), F.lit(1.0))))).cast("int")
    size = cut(size.select("label", F.least(wanted, F.lit(most_cells)).alias("cells")))
    sizes = [r.cells for r in size.select("cells").distinct().collect()]  # powers of two
    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, seen = dim[0].dim if dim else 0, []
    if max(sizes, default=1) > 1:
        seen = classes.filter(F.col("dim") == dim).select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas().embedding.tolist()
    cells = Cells(unit(np.array(seen)) if len(seen) else np.empty((0, dim)), sizes)
    far = float(np.sqrt(1 - cosine**2)) + 1e-9
    kept = ["label", "dim", "rep", "m"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, k = batch.column("dim").to_numpy(), batch.column("cells").to_numpy()
            for d, n in sorted(set(zip(lengths.tolist(), k.tolist(), strict=True))):
                mine = np.flatnonzero((lengths == d) & (k == n))
                for i in range(0, len(mine), 2000):
                    some = batch.take(pa.array(mine[i : i + 2000]))
                    raw = some.column("embedding").flatten().to_numpy().reshape(-1, d)
                    row, cell, home = cells.visits(unit(raw), n if d == dim else 1, far)
                    vec = pa.array([x.tobytes() for x in raw], pa.binary()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(row)) for c in kept), pa.array(cell.astype(np.int32)), pa.array(home), vec], names=[*kept, "cell", "home", "vec"])

    label_type, element = classes.schema["label"].dataType.simpleString(), vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = {"float": np.float32, "double": np.float64}.get(element, np.float64)
    usual = classes if element in ("float", "double") else classes.withColumn("embedding", F.col("embedding").cast("array<double>"))
    inside = cut(usual.join(size, "label").select(*kept, "cells", "embedding").mapInArrow(assign, f"label {label_type}, dim int, rep long, m long, cell int, home boolean, vec binary"))
    blocks = inside.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / F.lit(block)).cast("int").alias("homes"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("alls")
    )
    placed = inside.join(blocks, ["label", "dim", "cell"]).filter("homes > 0")
    mine = F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int")
    other = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("alls")).cast("int")
    key = ["label", "dim", "cell", "i", "j"]
    left = placed.filter("home").select("label", "dim", "cell", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("left"), "rep", "m", "vec")
    right = placed.select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), other.alias("j"), F.lit(False).alias("left"), "rep", "m", "vec")

    def compare(table: pa.Table) -> pa.Table:
        left, rep, m = (table.column(c).to_numpy() for c in ("left", "rep", "m"))
        x = unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype).reshape(len(rep), -1))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        links, low = np.zeros(len(rep), np.int64), rep.copy()
        near = [np.nonzero(x[a[i : i + 512]] @ x[b].T >= cosine) for i in range(0, len(a), 512)]
        if near:
            one = a[np.concatenate([i * 512 + p for i, (p, _) in enumerate(near)])]
            two = b[np.concatenate([q for _, q in near])]
            apart = rep[one] != rep[two]
            np.add.at(links, one[apart], m[two[apart]])
            while True:  # the least id that reaches each row
                new = low.copy()
                np.minimum.at(new, one, low[two])
                np.minimum.at(new, two, new[one])
                if (new == low).all():
                    break
                low = new
        tell = (links > 0) | (low != rep)
        return pa.table({"rep": rep[tell], "links": links[tell], "to": low[tell]})

    found = cut(left.unionByName(right).groupBy(*key).applyInArrow(compare, "rep long, links long, to long"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    home = (
        classes.join(links, "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
        .withColumn("fine", F.lit(True))
    )
    component = F.coalesce("component", "vec_id")
    return keyed.drop("embedding").join(home, ["k1", "k2", "fine"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
