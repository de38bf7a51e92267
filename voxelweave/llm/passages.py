"""Substring dedup: recurring passages compiled into sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ..plans.tables import cut, partitions, text_batches
from .recurring import LAST, bounds, ranges, recurring
from .wordhash import PLACES, WordHash, chunks, joined, mix, utf8, windows, words

#: Words of the fingerprints by which candidates are found.
GRAM = 8


class Windows:
    """Windows of ``size`` words of texts that lie end to end, each with its least ``GRAM``-word fingerprint."""

    def __init__(self, known: WordHash, found: list[list[bytes]], size: int):
        self.h, self.starts = joined(known, found)
        self.grams = windows(self.h, GRAM)
        self.span = size - GRAM + 1
        n = max(len(self.h) - size + 1, 0)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))
        self.valid = np.arange(n) + size <= ends[:n]  # within one text
        self.low = self.grams[:n]
        for i in range(1, self.span):
            self.low = np.minimum(self.low, self.grams[i : i + n])

    def selecting(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each place within a window: which windows have their least fingerprint there (all of equal ones)."""
        n = len(self.low)
        for i in range(self.span):
            yield i, self.valid & (self.grams[i : i + n] == self.low)

    def places(self) -> np.ndarray:
        held = np.zeros(len(self.grams), bool)
        for i, on in self.selecting():
            held[i : i + len(on)] |= on
        return np.flatnonzero(held)


def _codes(h: np.ndarray) -> str:
    """A character a word: 20 bits of its hash."""
    return (0x10000 + (h & np.uint64(0xFFFFF)).astype(np.uint32)).tobytes().decode("utf-32-le")


#: Stand for the words beyond the ends of passages and of texts; never equal.
NO_PASSAGE, NO_TEXT = np.uint64(0), np.uint64(2**64 - 1)


class Shard:
    """The recurring phrases of a shard's passages: an automaton, and each phrase's surroundings of a window's length."""

    def __init__(self, size: int) -> None:
        self.around = size - GRAM
        self.pad = np.full(self.around, NO_PASSAGE)
        self.phrases: dict[str, int] = {}
        self.seen: list[tuple[int, int]] = []  # phrase, owner
        self.near: list[np.ndarray] = []
        self.automaton = None

    def add(self, doc: int, h: np.ndarray, seeds: list[int]) -> None:
        codes = _codes(h)
        for at in seeds:
            self.seen.append((self.phrases.setdefault(codes[at : at + GRAM], len(self.phrases)), doc))
        self.near.append(np.concatenate([self.pad, h, self.pad])[np.array(seeds, np.int64)[:, None] + np.arange(GRAM + 2 * self.around)])

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, n in self.phrases.items():
            self.automaton.add_word(phrase, n)
        self.automaton.make_automaton()
        near = np.concatenate(self.near)
        phrase, owner = np.array(self.seen, np.int64).T
        # one of equal surroundings in a document is enough
        alike = mix((near * PLACES[: near.shape[1]]).sum(axis=1, dtype=np.uint64))
        order = np.lexsort([alike, owner, phrase])
        again = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (alike, owner, phrase)])
        order = order[np.concatenate([[True], ~again])]
        self.around_of, self.owner_of = near[order], owner[order]
        self.first = np.searchsorted(phrase[order], np.arange(len(self.phrases) + 1))
        self.near = self.seen = None

    def held(self, docs: np.ndarray, parts: list[np.ndarray], most: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ``parts`` end to end, where each starts, and which windows a passage of a smaller doc holds, word by word."""
        gap = np.full(self.around, NO_TEXT)
        h = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        starts = self.around + np.cumsum([0, *(len(p) + self.around for p in parts)])
        marks = np.zeros(len(h) + 1, np.int32)
        if self.phrases:
            if self.automaton is None:
                self._build()
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(_codes(h))), np.int64).reshape(-1, 2)
            here, phrase = hits[:, 0] - GRAM + 1, hits[:, 1]
            doc = np.repeat(docs, [len(p) + self.around for p in parts])
            count = self.first[phrase + 1] - self.first[phrase]
            edges = np.searchsorted(np.cumsum(count), np.arange(most, int(count.sum()) + most, most), "left") + 1  # bounded work space
            for a, b in zip(np.concatenate([[0], edges]), edges, strict=False):
                n = count[a:b]
                row = np.repeat(np.arange(a, min(b, len(here))), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[phrase[row]]
                fits = self.owner_of[at] < doc[np.maximum(here[row] - self.around, 0)]
                row, at = row[fits], at[fits]
                same = h[here[row][:, None] + np.arange(-self.around, GRAM + self.around)] == self.around_of[at]
                whole = same[:, self.around : self.around + GRAM].all(axis=1)
                left = np.cumprod(same[:, : self.around][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, self.around + GRAM :], axis=1).sum(axis=1)
                ok = whole & (left + right >= self.around)
                np.add.at(marks, (here[row] - left)[ok], 1)
                np.add.at(marks, (here[row] + right - self.around + 1)[ok], -1)
        return h, starts[:-1], np.cumsum(marks)[:-1] > 0


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - 1


def removed_words(docs: DataFrame, size: int = 13, shard_phrases: int = 100_000, shard_rows: int = 20_000, sample: int = 4_000) -> DataFrame:
    """``docs(doc, tag, text)`` -> ``(doc, tag, packed, spans)`` for documents that lose words, one for each repeat of a row.

    A word goes if a window of ``size`` words covers it whose word sequence
    starts in a document with a smaller id, too. ``packed``: the words,
    compressed; ``spans``: array of [from, to) word places that go.

    1. Phrases of ``GRAM`` words: each window selects its least by hash, so
    equal windows select equal ones. One sorted stream confirms which phrases
    recur, and the first document of each. 2. The passages around them in
    those first documents are dealt to shards; a shard's phrases become an
    automaton. 3. Every other document with recurring phrases is streamed through
    the shards of their first documents: the automaton finds each phrase, and
    the words around it are compared, as 64-bit hashes, as far as a window
    that selects the phrase can reach. Shards that many
    stretches need are copied, one copy for each ``shard_rows`` of them.
    4. A candidate window that its phrase's first document does not hold may
    still be in another one: a second sorted stream, by 128 bits over all
    words of the window, settles these.
    """
    spark = docs.sparkSession
    span = size - GRAM + 1

    def fingerprints(ends):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for batch in batches:
                doc, tag, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                for some in chunks(texts):
                    w = Windows(known, [words(t) for t in texts[some]], size)
                    at = w.places()
                    row = np.searchsorted(w.starts, at, "right") - 1
                    key, owner, at = w.grams[at].view(np.int64), doc[some][row], at - w.starts[row] | (tag[some][row] << 32)
                    to = ranges(ends, key, owner) if ends else np.zeros(len(key), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.zeros(len(key), np.int64), owner, at, to)], names=["k1", "k2", "doc", "at", "to"])

        return run

    def segments(shards: int):
        """A document's passages and phrases in them (kind 0), its stretches for other documents' shards (kind 1), and its words (kind 2)."""
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, packer = WordHash(), zstandard.ZstdCompressor(level=1)
            for batch in batches:
                doc, tag, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                edges, found = batch.column(3).offsets.to_numpy(), batch.column(3).values
                place, first = found.field("place").to_numpy(), found.field("first").to_numpy()
                for some in chunks(texts):
                    split = [words(t) for t in texts[some]]
                    w = Windows(known, split, size)
                    mine = slice(edges[some.start], edges[some.stop])
                    row = np.repeat(np.arange(len(split)), np.diff(edges[some.start : some.stop + 1]))
                    # whose shard each recurring phrase is in: -1 its own document's, -2 none
                    shard_of = np.full(len(w.grams), -2, np.int64)
                    shard_of[w.starts[row] + place[mine]] = np.where(first[mine] == doc[some][row], -1, first[mine] % shards)
                    wanted = np.full(len(w.low) + 1, -2, np.int64)
                    for i, on in w.selecting():
                        on = np.flatnonzero(on & (shard_of[i : i + len(on)] > -2))
                        wanted[on] = shard_of[on + i]
                    own = np.flatnonzero(shard_of == -1)
                    turns = np.flatnonzero(np.diff(wanted, prepend=-2))
                    out: list[tuple] = []
                    for a, b in zip(turns.tolist(), [*turns[1:].tolist(), 0], strict=True):
                        if (s := int(wanted[a])) == -2:
                            continue
                        r = int(np.searchsorted(w.starts, a, "right")) - 1
                        d, t, data = int(doc[some][r]), int(tag[some][r]), w.h[a : b - 1 + size].tobytes()
                        if s < 0:
                            marks = own[np.searchsorted(own, a) : np.searchsorted(own, b - 1 + span)] - a
                            out.append((0, d % shards, d, t, a - int(w.starts[r]), data, marks.astype(np.int32)))
                        else:
                            out.append((1, s, d, t, a - int(w.starts[r]), data, None))
                    for r in np.unique(row[first[mine] != doc[some][row]]).tolist():
                        out.append((2, -1, int(doc[some][r]), int(tag[some][r]), 0, packer.compress(b" ".join(split[r])), None))
                    cols = list(zip(*out, strict=True)) if out else [[]] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "shard", "doc", "tag", "start", "data", "marks"])

        return run

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard: its passages, then stretches of documents. Gives spans, and keys of windows not found."""
        at, shard = None, Shard(size)
        names = ["rest", "k1", "doc", "at", "a", "b"]
        for batch in batches:
            stretches: list[tuple[int, int, int, np.ndarray]] = []
            for number, copy, kind, doc, tag, start, data, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (number, copy) != at:
                    if stretches:
                        yield pa.RecordBatch.from_arrays(settle(shard, stretches), names=names)
                    at, shard, stretches = (number, copy), Shard(size), []
                if kind == 0:
                    shard.add(doc, np.frombuffer(data, np.uint64), marks)
                else:
                    stretches.append((doc, tag, start, np.frombuffer(data, np.uint64)))
            if stretches:
                yield pa.RecordBatch.from_arrays(settle(shard, stretches), names=names)

    def settle(shard: Shard, stretches: list[tuple[int, int, int, np.ndarray]]) -> list[pa.Array]:
        docs_of, tags, begin, parts = zip(*stretches, strict=True)
        docs_of, tags, begin = (np.array(x, np.int64) for x in (docs_of, tags, begin))
        h, starts, held = shard.held(docs_of, list(parts))
        length = np.array([len(p) for p in parts], np.int64)
        first, last = _runs(held)
        row = np.searchsorted(starts, first, "right") - 1
        a, b = first - starts[row] + begin[row], last - starts[row] + begin[row] + size
        rest = np.repeat(starts, length - size + 1) + np.arange(int((length - size + 1).sum())) - np.repeat(np.cumsum(length - size + 1) - (length - size + 1), length - size + 1)
        rest = rest[~held[rest]]
        own = np.searchsorted(starts, rest, "right") - 1
        k1, k2 = windows(h, size)[rest].view(np.int64), windows(h, size, seed=1)[rest].view(np.int64)
        zeros = np.zeros(len(row), np.int64)
        cols = (
            (zeros, np.ones(len(rest), np.int64)),
            (zeros, k1),
            (docs_of[row], docs_of[own]),
            (tags[row] << 32, rest - starts[own] + begin[own] | (tags[own] << 32)),
            (a, k2),
            (b, np.zeros(len(rest), np.int64)),
        )
        return [pa.array(np.concatenate(x), pa.int64()) for x in cols]

    tag, place = F.shiftright("at", 32).alias("tag"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("place")
    row_schema = "k1 long, k2 long, doc long, at long, to int"
    few = docs.filter(F.pmod(F.xxhash64("doc", F.lit(21)), F.lit(max(1, docs.count() // sample))) == 0)  # from all partitions
    ends = bounds(few.mapInArrow(fingerprints(None), row_schema))
    phrases = recurring(docs.mapInArrow(fingerprints(ends), row_schema)).select("doc", tag, place, "first")
    shards = max(partitions(spark), -(-phrases.filter("doc = first").count() // shard_phrases))
    found = phrases.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "first")).alias("found")).hint("shuffle_hash")
    parts = cut(docs.join(found, ["doc", "tag"]).select("doc", "tag", "text", "found").mapInArrow(segments(shards), "kind int, shard int, doc long, tag long, start int, data binary, marks array<int>"))

    order = ["shard", "copy", "kind", "doc", "tag", "start", "data", "marks"]
    copies = cut(parts.filter("kind = 1").groupBy("shard").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("copies")))
    dealt = parts.filter("kind < 2").join(copies, "shard")
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    stretches = dealt.filter("kind = 1").withColumn("copy", F.pmod(F.xxhash64("doc", F.lit(9)), F.col("copies")).cast("int")).select(*order)
    passages = dealt.filter("kind = 0").withColumn("copy", F.explode(every)).select(*order)
    stream = stretches.unionByName(passages).repartition(partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", "kind", "doc")
    hits = cut(stream.mapInArrow(locate, "rest long, k1 long, doc long, at long, a long, b long"))
    spans = hits.filter("rest = 0").select("doc", F.shiftright("at", 32).alias("tag"), "a", "b")
    rest = recurring(hits.filter("rest = 1").select("k1", F.col("a").alias("k2"), "doc", "at")).filter("doc > first")
    spans = spans.unionByName(rest.select("doc", tag, place.cast("long").alias("a"), (place + F.lit(size)).cast("long").alias("b")))
    spans = spans.groupBy("doc", "tag").agg(F.collect_set(F.array("a", "b")).alias("spans"))
    return parts.filter("kind = 2").select("doc", "tag", F.col("data").alias("packed")).join(spans, ["doc", "tag"])


def passage_digests(docs: DataFrame, size: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the words left, joined by single spaces.

    Words are compared unchanged. Null or empty text has no words. Rows with a
    null doc_id are one document after all others; rows that repeat a doc_id
    are one document, so they remove no words of each other. Rows whose whole
    text equals that of a smaller doc_id lose all words (if there are ``size``)
    without being searched; every other row is. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    same = F.coalesce(F.xxhash64("text").bitwiseAND(0x7FFFFFFF), F.lit(0))
    all_docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), same.alias("tag"), "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [words(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxh3_128_digest(utf8(t)) for t in texts], pa.binary()),
                    pa.array([len(w) for w in found], pa.int64()),
                    pa.array([sha256(b" ".join(w)).hexdigest() for w in found], pa.string()),
                ],
                names=["doc", "tag", "whole", "n_words", "kept_sha256"],
            )

    base = cut(all_docs.mapInArrow(counts, "doc long, tag long, whole binary, n_words long, kept_sha256 string"))
    first = base.filter(F.col("n_words") >= size).groupBy("whole").agg(F.min("doc").alias("first"))
    copies = cut(base.filter(F.col("n_words") >= size).join(first, "whole").filter("doc > first").select("doc", "tag").distinct())
    searched = all_docs.join(copies, ["doc", "tag"], "left_anti")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, digests = [], []
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = unpacker.decompress(packed).split(b" ")
                keep = np.ones(len(w), bool)
                for a, b in spans:
                    keep[a:b] = False
                removed.append(int(len(w) - keep.sum()))
                digests.append(sha256(b" ".join([x for x, k in zip(w, keep.tolist(), strict=True) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc", "tag", "n_removed", "left_sha256"])

    cuts = removed_words(searched, size).mapInArrow(digest, "doc long, tag long, n_removed long, left_sha256 string")
    cuts = cuts.groupBy("doc", "tag").agg(F.min("n_removed").alias("n_removed"), F.min("left_sha256").alias("left_sha256"))  # repeated rows come out equal
    gone = copies.select("doc", "tag", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("left_sha256"))
    return base.join(cuts.unionByName(gone), ["doc", "tag"], "left").select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(F.col("left_sha256").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).cast("long").alias("n_removed"),
        F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"),
    )
