"""Keys that occur in two or more documents, found by one sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, partitions

#: Stands for a null doc_id, which comes after all others.
LAST = 2**63 - 1
ROW, HEAD, TAIL, NOTE = 0, 1, 2, 3


def recurring(rows: DataFrame) -> DataFrame:
    """``rows(k1, k2, doc, at)`` (longs, none null) -> ``(k1, k2, first, doc, at)``.

    Returns all rows whose key ``(k1, k2)`` occurs with two or more values of
    ``doc``; ``first`` is the key's smallest ``doc``. Rows are range-partitioned
    and sorted by key, doc and at, so that the rows of a hot key spread over
    neighbouring partitions. A task streams its runs of equal keys; for its
    first and last run it leaves a note (two per task), from which the driver
    joins runs that cross partitions. Where ``rows`` has a column ``to``, it is
    the number of the row's range (see ``bounds``), and nothing is sampled.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    ranged = rows.repartitionById(n, F.col("to")) if "to" in rows.columns else rows.repartitionByRange(n, "k1", "k2", "doc", "at")
    runs = cut(
        ranged.select("k1", "k2", "doc", "at")
        .sortWithinPartitions("k1", "k2", "doc", "at")
        .mapInArrow(_runs, "kind int, part int, k1 long, k2 long, first long, doc long, at long")
    )
    notes = sorted((r.part, r.at, r.k1, r.k2, r.first, r.doc) for r in runs.filter(F.col("kind") == NOTE).select("part", "at", "k1", "k2", "first", "doc").collect())
    open_runs: list[list] = []  # [key, smallest doc, largest doc, [(part, side), ...]]
    for part, side, k1, k2, low, high in notes:
        if open_runs and open_runs[-1][0] == (k1, k2):
            run = open_runs[-1]
            run[1], run[2] = min(run[1], low), max(run[2], high)
        else:
            open_runs.append(run := [(k1, k2), low, high, []])
        run[3].append((part, side))
    lows: list[int | None] = [None] * (2 * n + 2)  # by task, for its first and its last run
    for _, low, high, at in open_runs:
        for part, side in at if low < high else ():
            lows[2 * part + side - 1] = low
    table = F.split(F.lit(",".join("" if x is None else str(x) for x in lows)), ",")
    low = F.nullif(F.get(table, 2 * F.col("part") + F.col("kind") - 1), F.lit("")).cast("long")
    sure = runs.filter(F.col("kind") == ROW).select("k1", "k2", "first", "doc", "at")
    edge = runs.filter(F.col("kind").isin(HEAD, TAIL)).select("k1", "k2", low.alias("first"), "doc", "at").filter("first is not null")
    return sure.unionByName(edge)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, runs_seen = TaskContext.get().partitionId(), [], 0

    def out(kind: int, cols: list[np.ndarray], first) -> pa.RecordBatch:
        n = len(cols[0])
        k1, k2, doc, at = cols
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.full(n, kind, np.int32), np.full(n, part, np.int32), k1, k2, np.broadcast_to(first, n).astype(np.int64), doc, at)],
            names=["kind", "part", "k1", "k2", "first", "doc", "at"],
        )

    def note(side: int, run: list[np.ndarray]) -> pa.RecordBatch:
        k1, k2, doc, _ = run
        return out(NOTE, [k1[:1], k2[:1], doc[-1:], np.array([side], np.int64)], doc[0])

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if held and (cols[0][0], cols[1][0]) == (held[-1][0][-1], held[-1][1][-1]) and not len(starts):
            held.append(cols)
            continue
        if held:
            if (cols[0][0], cols[1][0]) != (held[-1][0][-1], held[-1][1][-1]):
                starts = np.concatenate([[0], starts])
            held.append([c[: starts[0]] for c in cols])
            run = joined()
            runs_seen += 1
            if runs_seen == 1:
                yield out(HEAD, run, 0)
                yield note(HEAD, run)
            elif run[2][0] < run[2][-1]:
                yield out(ROW, run, run[2][0])
            cols = [c[starts[0] :] for c in cols]
            starts = starts[1:] - starts[0]
        edges = np.concatenate([[0], starts, [len(cols[0])]])
        if len(edges) > 2:  # runs that begin and end in this batch
            low, high = cols[2][edges[:-2]], cols[2][edges[1:-1] - 1]
            many = low < high
            if runs_seen == 0:
                run = [c[: edges[1]] for c in cols]
                yield out(HEAD, run, 0)
                yield note(HEAD, run)
                many[0] = False
            runs_seen += len(many)
            size = np.diff(edges[:-1])
            keep = np.repeat(many, size)
            if keep.any():
                yield out(ROW, [c[: edges[-2]][keep] for c in cols], np.repeat(low, size)[keep])
        held = [[c[edges[-2] :] for c in cols]]
    if held:
        run, side = joined(), TAIL if runs_seen else HEAD
        yield out(side, run, 0)
        yield note(side, run)


def bounds(sample: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the ranges, from at most ``most`` rows ``(k1, doc)`` of a sample of the documents, chosen by hash."""
    got = sample.select("k1", "doc").orderBy(F.xxhash64("k1", "doc")).limit(most).toPandas().sort_values(["k1", "doc"])
    n = partitions(sample.sparkSession)
    at = [len(got) * i // n for i in range(1, n)] if len(got) else []
    return got.k1.to_numpy(np.int64)[at], got.doc.to_numpy(np.int64)[at]


def ranges(ends: tuple[np.ndarray, np.ndarray], k1: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The range of each row; rows of a key that is an end itself are told apart by doc."""
    low, high = np.searchsorted(ends[0], k1, "left"), np.searchsorted(ends[0], k1, "right")
    to = low.copy()
    for i in np.flatnonzero(high > low):
        to[i] += np.searchsorted(ends[1][low[i] : high[i]], doc[i], "right")
    return to.astype(np.int32)
