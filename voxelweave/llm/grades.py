"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..plans.tables import text_batches
from .wordhash import words

BITS = 20
ODD, UPPER = 1 << BITS, 2 << BITS


class Features(dict):
    """word -> buckets of the word, its beginnings and its shape, as int32 bytes; remembers at most ``most`` words.

    The first bucket carries two marks in the bits above: ``ODD`` and ``UPPER``.
    """

    most = 300_000

    def __missing__(self, word: bytes) -> bytes:
        core = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        tail = word[len(word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :][:3]
        shape = (b"U" if core.isupper() and len(core) > 2 else b"l") + (b"0" if core[:1].isdigit() else b"") + (b"" if core else b"-") + tail
        odd = bool(tail) and tail not in (b".", b",", b";", b":", b"?", b"!")
        low = core.decode("utf-8", "replace").lower()
        starts = {low[:n] for n in (4, 5, 6, 8) if len(low) > n}
        marks = (ODD if odd else 0) | (UPPER if shape[:1] == b"U" else 0)
        self[word] = found = array("i", [bucket(b"w" + low.encode()) | marks, bucket(b"s" + shape), *[bucket(b"p" + x.encode()) for x in starts]]).tobytes()
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a whole text: words, shapes, and coarse ratios."""
        if len(self) > self.most:
            self.clear()
        w = words(text)
        if not w:
            return np.array([bucket(b"r:empty")])
        kinds = Counter(w)
        found = list(map(self.__getitem__, kinds))
        n, times = len(w), np.fromiter(kinds.values(), np.int64, len(kinds))
        own = np.frombuffer(b"".join(found), np.int32)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // own.itemsize
        first = own[np.concatenate([[0], ends[:-1]])]
        ratio = lambda name, x, steps: bucket(b"r:%s%d" % (name, int(np.searchsorted(steps, x))))
        whole = [
            ratio(b"kinds", len(kinds) / n, [0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8] if n > 30 else [0.3, 0.6]),
            ratio(b"odd", times[first & ODD > 0].sum() / n, [0.01, 0.05, 0.1, 0.2, 0.4, 0.7]),
            ratio(b"upper", times[first & UPPER > 0].sum() / n, [0.02, 0.1, 0.3, 0.6]),
            ratio(b"most", times.max() / n, [0.05, 0.1, 0.2, 0.4, 0.7]),
            ratio(b"n", n, [5, 20, 50]),
        ]
        return np.unique(np.concatenate([own & (2**BITS - 1), np.array(whole, np.int32)])).astype(np.int64)


def bucket(x: bytes) -> int:
    return xxh3_64_intdigest(x) & (2**BITS - 1)


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(score - thresholds[k - 1]); the score is a sum of bucket weights."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None], -40, 40)))


def fit(buckets: np.ndarray, lengths: np.ndarray, grades: np.ndarray, levels: int = 3, penalty: float = 1.0, rounds: int = 200, rate: float = 0.05, least: int = 8, telling: float = 1.0) -> Ordinal:
    """Adam on the negative log-likelihood of the grades plus ``penalty`` / 2 times the squared weights.

    ``buckets`` holds those of all texts end to end, ``lengths`` how many each has.
    Rare grades count more, by the root of their share. A bucket enters with
    the log ratio of its shares among the best grade and the others; where
    that is under ``telling``, or it is in under ``least`` texts or 0.2 % of
    them, it weighs 0.
    """
    if not len(grades):
        return Ordinal(np.zeros(2**BITS, np.float32), np.linspace(-3, -1, levels - 1))
    seen = np.bincount(buckets, minlength=2**BITS)
    high = np.bincount(buckets[np.repeat(grades == levels - 1, lengths)], minlength=2**BITS)
    n_high = (grades == levels - 1).sum()
    # how much more often the best grade holds a bucket than the others do
    ratio = np.log((high + 1) / (n_high + 2)) - np.log((seen - high + 1) / (len(grades) - n_high + 2))
    used = np.flatnonzero((seen >= max(least, 0.002 * len(grades))) & (np.abs(ratio) >= telling))
    place = np.full(2**BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # of all buckets only those with a weight go on
    cols = place[buckets]
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[cols >= 0]
    cols = cols[cols >= 0]
    value = ratio[used][cols]
    n, k = len(grades), len(used)
    cum = [min(max((grades >= j).mean(), 1e-3), 1 - 1e-3) for j in range(1, levels)]
    worth = np.array([1 / np.sqrt(max((grades == j).mean(), 1e-3)) for j in range(levels)])[grades]
    worth /= worth.sum()
    # the thresholds are a first one and gaps of exp(gap)
    theta = np.array([np.log((1 - p) / p) for p in cum])
    x = np.concatenate([np.zeros(k), theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        first, gaps = x[k], np.exp(x[k + 1 :])
        cut = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, x[cols] * value, n)
        sig = 1 / (1 + np.exp(-np.clip(score[:, None] - cut[None], -40, 40)))
        up = np.concatenate([np.ones((n, 1)), sig, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(up[at, grades] - up[at, grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), sig * (1 - sig), np.zeros((n, 1))], axis=1)
        own, above = worth * slope[at, grades] / p, worth * slope[at, grades + 1] / p
        g_score = -(own - above)
        g_cut = np.array([(own[grades == j].sum() - above[grades == j - 1].sum()) for j in range(1, levels)])
        g_tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, g_score[rows] * value, k) + penalty * x[:k] / n, [g_tail[0]], g_tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(2**BITS, np.float32)
    weights[used] = x[:k] * ratio[used]
    return Ordinal(weights, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))]))


def graded(docs: DataFrame, labels: DataFrame, sample: int | None = 10_000) -> DataFrame:
    """(doc_id, text, grade): 2 is good quality and not toxic, 1 lacks one of the two, 0 both. Unknown grades are left out.

    At most ``sample`` labels are taken, of those whose document there is (the smallest hashes of doc_id), so the texts
    need no shuffle. Of a doc_id's several grades the least counts; null grades and null doc_ids are left out.
    """
    grade = F.col("quality") + 1 - F.col("toxic")
    rated = labels.select("doc_id", grade.cast("int").alias("grade")).filter("grade between 0 and 2").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    if sample:
        there = docs.select("doc_id").join(rated, "doc_id").select("doc_id", "grade").distinct()
        rated = F.broadcast(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(rated, "doc_id")


def train(rated: DataFrame, sample: int = 6000, **options) -> Ordinal:
    """Fit on at most ``sample`` rated rows, those with the smallest hashes of doc_id; texts become buckets on the executors."""
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id", F.length("text")).limit(sample).repartition(12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([known.of(x).astype(np.int32) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "grade", "buckets"])

    got = some.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, buckets array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")])  # at most ``sample`` rows, of numbers only
    lists = got.column("buckets").combine_chunks()
    return fit(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), got.column("grade").to_numpy().astype(np.int64), **options)


def grade_documents(docs: DataFrame, model: Ordinal, at_least: int = 2, least: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row each: doc_id, expected_grade, tail_probability, kept.

    ``tail_probability`` is P(grade >= ``at_least``); kept: it is ``least`` or
    more. Whole texts are scored; null and empty texts have one feature of
    their own. Rows are scored one by one, null or repeated doc_ids as they come.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Features(), shared.value
        for batch in batches:
            s = np.array([model.weights[known.of(x)].sum(dtype=np.float64) for x in batch.column(1).to_pylist()])
            tails = np.round(model.tails(s), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, at_least - 1].copy())], names=["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double").withColumn("kept", F.col("tail_probability") >= least)


def accepted(docs: DataFrame, model: Ordinal, at_least: int = 2, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    Rows are judged by their text alone, so repeated rows and null doc_ids share
    the fate of their text; null and empty texts have one feature of their own. A
    tail probability of exactly ``least`` is kept. No rows give no rows; other
    columns may have any name.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    known = Features()

    @F.pandas_udf("double")
    def tail(text):
        scores = np.array([shared.value.weights[known.of(x)].sum(dtype=np.float64) for x in text])
        return pd.Series(np.round(shared.value.tails(scores), 6)[:, at_least - 1] if len(text) else [], dtype="float64")

    return docs.filter(tail("text") >= least)
