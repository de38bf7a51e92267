"""Document fingerprints: one-permutation MinHash with optimal densification, as packed low-order bits."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import partitions, text_batches
from .recurring import LAST, bounds, ranges
from .wordhash import WordHash, chunks, joined, mix, windows, words

#: Bins of a fingerprint, low-order bits kept of each, and words of a shingle.
BINS, BITS, SIZE = 1024, 4, 5
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EMPTY = np.uint64(2**64 - 1)
_SALT = mix(np.arange(BINS, dtype=np.uint64))


def _donors(bins: np.ndarray, attempt: int) -> np.ndarray:
    """Where an empty bin looks for a value at its ``attempt``: a hash of both, the same for all documents."""
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> _SHIFT).astype(np.int64)


#: The first donors of every bin, one row a bin, and the blocks in which a text's empty bins look at them.
_FIRST = np.array([_donors(np.arange(BINS), t) for t in range(256)]).T.copy()
_BLOCKS = (0, 8, 32, 96, 256)


def least_values(known: WordHash, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the least shingle hash of each bin (all ones if none), and whether it has words.

    Each shingle of the lower-cased text is hashed once: the high bits choose
    its bin. A text of fewer than ``SIZE`` words has one shingle, all of them.
    """
    found = [words(t, lower=True) for t in texts]
    h, starts = joined(known, found)
    low = np.full(len(texts) * BINS, _EMPTY)
    n = np.diff(starts)
    grams = windows(h, SIZE)
    doc = np.repeat(np.arange(len(texts)), n)[: len(grams)]
    fits = np.arange(len(grams)) + SIZE <= starts[1:][doc]
    grams, doc = grams[fits], doc[fits]
    short = [i for i in np.flatnonzero((n > 0) & (n < SIZE)).tolist()]
    whole = [windows(h[starts[i] : starts[i + 1]], int(n[i]), seed=1) for i in short]
    grams, doc = np.concatenate([grams, *whole]), np.concatenate([doc, np.array(short, np.int64)])
    np.minimum.at(low, doc * BINS + (grams >> _SHIFT).astype(np.int64), grams)
    return low.reshape(len(texts), BINS), n > 0


def densified(low: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Every empty bin takes the value of the first filled bin on its own hashed path (rows without words stay)."""
    filled = low != _EMPTY
    out = low.copy()
    rows, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in np.flatnonzero(some).tolist():
        own, values, to = filled[i], low[i], np.flatnonzero(~filled[i])
        if len(to) == BINS - 1:  # every path ends at the only filled bin
            out[i] = values[own.argmax()]
            continue
        for begin, end in pairwise(_BLOCKS):
            if not len(to):
                break
            at = _FIRST[to, begin:end]
            found = own[at]
            first = found.argmax(axis=1)
            ok = found[np.arange(len(to)), first]
            out[i, to[ok]] = values[at[ok, first[ok]]]
            to = to[~ok]
        rows.append(np.full(len(to), i))
        ends.append(to)
    row, to, attempt = np.concatenate(rows), np.concatenate(ends), _BLOCKS[-1]
    while len(row):
        at = _donors(to, attempt)
        ok = filled[row, at]
        out[row[ok], to[ok]] = low[row[ok], at[ok]]
        row, to = row[~ok], to[~ok]
        attempt += 1
    return out


def low_bits(known: WordHash, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The low-order bits of every bin's value, hashed with the bin: a value copied to many bins has other bits in each."""
    low, some = least_values(known, texts)
    return (mix(densified(low, some) ^ _SALT) & np.uint64(2**BITS - 1)).astype(np.uint8), some


def packed(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, as hex digits; '' for texts without words."""
    both = bits[:, 0::2] << BITS | bits[:, 1::2]
    return [row.tobytes().hex() if has else "" for row, has in zip(both, some.tolist(), strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity: equal bins, less those that are equal by chance (2^-BITS of the unequal ones)."""
    share, chance = (a[0] == b[0]).mean(axis=1), 2.0**-BITS
    found = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(a[1] & b[1], found, np.where(a[1] == b[1], 1.0, 0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_chars, fingerprint): one row each, without any shuffle."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for some in _pieces(texts):
                out += packed(*low_bits(known, texts[some]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _pieces(texts: list[str], most: int = 400) -> Iterator[slice]:
    """Runs of texts of bounded length and number."""
    for part in chunks(texts):
        for i in range(part.start, part.stop, most):
            yield slice(i, min(i + most, part.stop))


def followed(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> rows (follower, doc_id, text), each followed in its partition by the next document.

    Documents come by falling doc_id (null last, rows of one doc_id by a hash
    of the text). The ends of the ranges are those of about ``sample`` rows; the first document of each
    range, one row, is copied behind the end of the range before it (that of
    the first range behind the last), so a text is shuffled once and no order
    over all rows is ever in one task. ``follower`` marks the copy.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(LAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    few = keyed.filter(F.pmod(F.xxhash64("key", "hash"), F.lit(max(1, docs.count() // sample))) == 0)
    ends = bounds(few.select(F.col("key").alias("k1"), F.col("hash").alias("doc")))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series(ranges(ends, key.to_numpy(), own.to_numpy()))

    placed = keyed.withColumn("to", range_of("key", "hash"))
    heads = sorted((r["to"], r.first.key, r.first["hash"]) for r in placed.groupBy("to").agg(F.min(F.struct("key", "hash")).alias("first")).collect())  # one row a range
    before = [(key, own, heads[i - 1][0]) for i, (_, key, own) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "key long, hash long, before int"))
    copies = keyed.join(table, ["key", "hash"]).groupBy("key", "hash", "before").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = placed.select("to", F.lit(0).alias("follower"), "key", "hash", "doc_id", "text").unionByName(copies.select(F.col("before").alias("to"), F.lit(1).alias("follower"), "key", "hash", "doc_id", "text"))
    return both.repartitionById(n, F.col("to")).sortWithinPartitions("follower", "key", "hash").select("follower", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row per row of ``docs``, with the fingerprint of its whole text and of
    its edited text: the last third of its code points (rounded down) replaced
    by the first as many (or all) of the next document's, by falling doc_id;
    the last is followed by the first. Rows with a null doc_id come last; rows
    of one doc_id follow each other in the order of a hash of their texts. Null
    text is empty; a text without words has the fingerprint '', whose likeness
    is 1 to another such text and 0 to any other. No rows give no rows; other
    columns are ignored. A likeness deviates from the Jaccard similarity J of the
    shingle sets by about sqrt(J (1 - J) / m), m the smaller of ``BINS`` and the
    shingles of both.
    """
    text_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left = WordHash(), None
        for batch in batches:
            every = [t or "" for t in batch.column(2).to_pylist()]
            for some in _pieces(every):
                ids, texts = batch.column(1).slice(some.start, some.stop - some.start), every[some]
                bits, has = low_bits(known, texts)
                if left is not None:
                    ids = pa.concat_arrays([left[0], ids])
                    texts, bits, has = [left[1], *texts], np.concatenate([left[2], bits]), np.concatenate([left[3], has])
                left = ids.slice(len(texts) - 1), texts[-1], bits[-1:], has[-1:]
                if len(texts) < 2:
                    continue
                edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, texts[1:], strict=False)]
                changed = low_bits(known, edited)
                own, following = (bits[:-1], has[:-1]), (bits[1:], has[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(0, len(edited)),
                        pa.array([len(t) for t in texts[:-1]], pa.int64()),
                        pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                        pa.array(packed(*own), pa.string()),
                        pa.array(packed(*changed), pa.string()),
                        pa.array(likeness(own, changed)),
                        pa.array(likeness(own, following)),
                    ],
                    names=names,
                )

    return followed(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
