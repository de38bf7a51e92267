"""Line dedup: ranges of line hashes, streamed in document order, give keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ..plans.tables import fresh, text_batches
from .recurring import LAST, recurring
from .wordhash import utf8

SPACE = b" \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id (null last); tag: tells rows of one doc_id with different texts apart."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce(F.xxhash64("text").bitwiseAND(0x7FFFFFFF), F.lit(0)).alias("tag"), "text")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc, tag, n_dropped, keep)``, only for rows that lose lines.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased. A key of at least ``min_chars`` code points that two or
    more doc_ids hold keeps its lines in the smallest doc_id only. ``keep`` is
    a deflated bit per line up to the last dropped one. Null text counts as an
    empty line; rows with a null doc_id are one document after all others;
    rows that repeat a doc_id are one document, so they do not drop lines of
    each other. Other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, doc_of, at_of = [], [], []
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, line in enumerate(utf8(text).split(b"\n")):
                    key = line.strip(SPACE).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        digests.append(xxh3_128_digest(key))
                        doc_of.append(doc)
                        at_of.append(tag << 32 | at)
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(doc_of, pa.int64()), pa.array(at_of, pa.int64())], names=["k1", "k2", "doc", "at"]
            )

    def bitmap(drops: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drops:
            maps, count = [], []
            for ats in batch.column(2).to_pylist():
                bits = np.ones(-(-(max(ats) + 1) // 8) * 8, bool)
                bits[ats] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                count.append(len(ats))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "tag", "n_dropped", "keep"])

    rows = _keyed(docs).mapInArrow(lines, "k1 long, k2 long, doc long, at long")
    dropped = recurring(rows).filter("doc > first").select("doc", F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("line"))
    return dropped.groupBy("doc", "tag").agg(F.collect_set("line").alias("lines")).mapInArrow(bitmap, "doc long, tag long, n_dropped long, keep binary")


def _kept(text: str | None, keep: bytes | None) -> tuple[int, bytes]:
    lines = utf8(text).split(b"\n")
    if keep is None:
        return len(lines), utf8(text)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    return len(lines), b"\n".join([x for x, k in zip(lines, bits, strict=False) if k] + lines[len(bits) :])


def line_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 of the lines left, joined by newlines."""
    spans = keep_bitmaps(docs).hint("shuffle_hash")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, dropped, keep = (c.to_pylist() for c in batch.columns)
            found = [_kept(*x) for x in zip(text, keep, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if d == LAST else d for d in doc], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([d or 0 for d in dropped], pa.int64()), pa.array([sha256(b).hexdigest() for _, b in found])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return _keyed(docs).join(spans, ["doc", "tag"], "left").select("doc", "text", "n_dropped", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``keep_bitmaps`` drops cut from ``text``; every other column stays.

    ``n_chars``, where there is one, follows the new text. Rows without drops
    are unchanged, null and empty text included; a row that loses all its lines
    keeps an empty text. Repeated rows are cut alike. No rows give no rows; other
    columns may have any name.
    """
    doc_, tag_, keep_ = (fresh(c, docs.columns) for c in ("_doc", "_tag", "_keep"))
    spans = keep_bitmaps(docs).select(F.col("doc").alias(doc_), F.col("tag").alias(tag_), F.col("keep").alias(keep_)).hint("shuffle_hash")

    @F.pandas_udf("string")
    def cut_text(text, keep):
        return text.combine(keep, lambda t, k: t if k is None else _kept(t, k)[1].decode("utf-8", "surrogatepass"))

    doc, tag = F.coalesce("doc_id", F.lit(LAST)), F.coalesce(F.xxhash64("text").bitwiseAND(0x7FFFFFFF), F.lit(0))
    joined = docs.join(spans, (doc == F.col(doc_)) & (tag == F.col(tag_)), "left")
    out = joined.withColumn("text", F.when(F.col(keep_).isNull(), F.col("text")).otherwise(cut_text("text", keep_)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(keep_).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
