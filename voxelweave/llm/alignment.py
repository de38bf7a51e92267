"""Cross-tokenizer alignment: divide and conquer at byte offsets where tokens of both tokenizers end."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, partitions, text_batches
from .packing import BYTES, CachedTokenizer
from .wordhash import chunks

#: Runs of spaces with what follows them; no piece of the second tokenizer reaches over their borders.
UNIT = re.compile(" +[^ ]*")


class Tokens:
    """The bytes of each id, their lengths, and each id's decimal digits with what may follow them."""

    def __init__(self, entries: list[bytes], ends: tuple[bytes, bytes]):
        self.entries = entries
        self.length = np.array([len(x) for x in entries], np.int64)
        self.flat, self.begin = np.frombuffer(b"".join(entries), np.uint8), np.cumsum(self.length) - self.length
        self.text = [np.array([b"%d%s" % (i, e) for i in range(len(entries))], object) for e in ends]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens end to end."""
        n = self.length[ids]
        at = np.repeat(self.begin[ids] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return self.flat[at]

    def spells(self, ids: list[np.ndarray], whole: list[bytes]) -> np.ndarray:
        """Which of the token lists join to their texts."""
        size = np.array([int(self.length[x].sum()) for x in ids])
        fine = size == np.array([len(w) for w in whole])
        some = np.flatnonzero(fine)
        if len(some):
            mine = self.joined(np.concatenate([ids[i] for i in some.tolist()]))
            odd = np.flatnonzero(mine != np.frombuffer(b"".join(whole[i] for i in some.tolist()), np.uint8))
            fine[some[np.searchsorted(np.cumsum(size[some]), odd, "right")]] = False
        return fine


class ByteLevel(Tokens):
    """Byte-level BPE of a space and the text."""

    def __init__(self, path: str):
        self.own = CachedTokenizer(path, plain=True)
        back = {chr(c): b for b, c in BYTES.items()}
        vocab = self.own.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        super().__init__(entries, (b",", b"|"))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.frombuffer(self.own.encode(" " + t), self.own.dtype).astype(np.int64) for t in texts]
        self.own.words.age()
        return out


class Pieces(Tokens):
    """Sentence pieces of the text, which the model itself begins with a space; runs of spaces with a word are remembered."""

    def __init__(self, path: str, most: int = 500_000):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        name = m.id_to_piece
        super().__init__([bytes([int(name(i)[3:5], 16)]) if m.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(m.get_piece_size())], (b",", b";"))
        inner = any("▁" in name(i).lstrip("▁") for i in range(m.get_piece_size()))
        self.apart = not inner and b"".join(self.entries[i] for i in m.encode(" a  b ")) == b"  a  b "
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.most = most

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]
        split = []
        for t in texts:
            plain = t and t[0] != " " and t[-1] != " " and "  " not in t
            split.append(t.split(" ") if plain else [u[1:] for u in UNIT.findall(" " + t)])
        if len(self.known) > self.most:
            self.known = {}
        new = list({u for s in split for u in s if u not in self.known})
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            self.known.update(zip(some, (array("i", x).tobytes() for x in self.model.encode(some, num_threads=1)), strict=True))
        # the model gives nothing for the empty text, but a lone space within one is a token
        get, lone = self.known.__getitem__, self.model.encode(" ")
        if "" in self.known:
            self.known[""] = array("i", lone if len(lone) == 1 and self.entries[lone[0]] == b" " else [self.model.piece_to_id("▁")]).tobytes()
        return [np.frombuffer(b"".join(map(get, s)), np.int32).astype(np.int64) if t else np.empty(0, np.int64) for t, s in zip(texts, split, strict=True)]


_loaded: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def _tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Loaded once in each process."""
    if (a, b) not in _loaded:
        _loaded[a, b] = ByteLevel(a), Pieces(b)
    return _loaded[a, b]


def leaf_groups(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ends of the leaf groups of the byte intervals ``low`` to ``high``, in order.

    ``a`` and ``b`` are the sorted ends of the tokens of both tokenizers; every
    ``high`` is in both. Each interval looks for a common end from its middle
    to both sides: the next end of ``a``, by bisection the next of ``b`` from
    there, and so on until they meet. It is split there and both halves are
    searched again; an interval in which none is found is a group. All
    intervals of one depth take each step together.
    """
    leaves = []
    while len(low):
        middle = (low + high) // 2
        right = np.maximum(middle, low + 1)  # common ends are sought at or after this
        left = middle  # and at or before this
        found = np.full(len(low), -1, np.int64)
        todo = np.flatnonzero(high - low > 1)
        while len(todo):
            x = a[np.minimum(np.searchsorted(a, right[todo]), len(a) - 1)]
            y = b[np.minimum(np.searchsorted(b, x), len(b) - 1)]
            meet = (x == y) & (x < high[todo])
            u = a[np.maximum(np.searchsorted(a, left[todo], "right") - 1, 0)]
            u = np.where(u <= left[todo], u, low[todo])
            v = b[np.maximum(np.searchsorted(b, u, "right") - 1, 0)]
            v = np.where(v <= u, v, low[todo])
            meet_left = (u == v) & (u > low[todo])
            nearer = meet_left & (~meet | (middle[todo] - u < x - middle[todo]))
            found[todo] = np.where(nearer, u, np.where(meet, x, -1))
            right[todo], left[todo] = np.where(x < high[todo], y, high[todo]), np.where(u > low[todo], v, low[todo])
            todo = todo[(found[todo] < 0) & ((right[todo] < high[todo]) | (left[todo] > low[todo]))]
        cut_here = found >= 0
        leaves.append(high[~cut_here])
        low, at, high = low[cut_here], found[cut_here], high[cut_here]
        low, high = np.stack([low, at], axis=1).ravel(), np.stack([at, high], axis=1).ravel()  # in order, so searches are near each other
    return np.sort(np.concatenate(leaves)) if leaves else np.empty(0, np.int64)


class Aligned:
    """Texts end to end: tokens of both kinds, groups and links, with where each text's begin."""

    def __init__(self, one: ByteLevel, two: Pieces, texts: list[str]):
        ids, whole = [one.ids(texts), two.ids(texts)], [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        fine = one.spells(ids[0], whole) & two.spells(ids[1], whole) & np.array([bool(t) for t in texts])
        for i in np.flatnonzero(~fine).tolist():
            ids[0][i] = ids[1][i] = np.empty(0, np.int64)
        self.n = [np.array([len(x) for x in side], np.int64) for side in ids]
        self.ids = [np.concatenate(side) if side else np.empty(0, np.int64) for side in ids]
        self.ends = [np.cumsum(k.length[x]) for k, x in zip((one, two), self.ids, strict=True)]
        size = np.array([len(w) if n else 0 for w, n in zip(whole, self.n[0].tolist(), strict=True)], np.int64)
        high = np.cumsum(size)
        some = size > 0
        self.cuts = leaf_groups(*self.ends, (high - size)[some], high[some])
        self.doc = np.searchsorted(high, self.cuts)  # whose group
        self.groups = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
        self.last = [np.searchsorted(e, self.cuts) for e in self.ends]  # the tokens that end there
        self.links = [x[at] for x, at in zip(self.ids, self.last, strict=True)]
        self.kinds = one, two

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each text."""
        total = len(self.ids[0]) + len(self.ids[1])
        out = np.empty(total, object)
        group = [np.searchsorted(self.cuts, e) for e in self.ends]
        upto = [at + 1 for at in self.last]  # tokens of each kind up to each cut
        place = [
            np.arange(len(self.ids[0])) + np.concatenate([[0], upto[1]])[group[0]],
            np.arange(len(self.ids[1])) + np.concatenate([upto[0], [0]])[group[1]],
        ]
        for kind, x, at, last in zip(self.kinds, self.ids, place, self.last, strict=True):
            out[at] = kind.text[0][x]
            out[at[last]] = kind.text[1][x[last]]
        edges = np.cumsum([0, *(self.n[0] + self.n[1])]).tolist()
        return [b"".join(out[a:b].tolist())[:-1] for a, b in zip(edges, edges[1:], strict=False)]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct linked id pairs (a << 32 | b), sorted, and how often they occur."""
        key = self.links[0] << 32 | self.links[1]
        order = np.lexsort([key, self.doc])
        key, doc = key[order], self.doc[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.concatenate([new, [len(key)]]))
        edges = np.searchsorted(doc[new], np.arange(len(self.n[0]) + 1))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            yield key[new[a:b]], count[a:b]


def _packed(key: np.ndarray, count: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    return packer.compress(np.diff(key, prepend=0).tobytes() + count.astype(np.int32).tobytes())


def _unpacked(raw: bytes, unpacker: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    data = unpacker.decompress(raw)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.int32, n, 8 * n).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, count, len(key)).astype(np.int64)


def alignments(docs: DataFrame, digest: bool = False, a: str | None = None, b: str | None = None, block_chars: int = 32_000_000) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (block, doc_id, n_a, n_b, n_groups, groups, links), one row each, without any shuffle.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, the decimal ids of both tokenizers
    between common ends of tokens (or its sha256 in hex if ``digest``; '' without
    tokens). ``links``: packed id pairs of tokens that end together, with counts.
    ``block`` numbers runs of up to ``block_chars`` code points within a task.
    """
    text_batches(docs.sparkSession)
    paths = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _tokenizers(*paths)
        packer, first, seen = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for some in chunks(texts, 1_000_000):
                found = Aligned(one, two, texts[some])
                groups = found.texts()
                if digest:
                    groups = [sha256(g).hexdigest() if g else "" for g in groups]
                else:
                    groups = [g.decode() for g in groups]
                links = [_packed(k, c, packer) for k, c in found.pairs()]
                n = some.stop - some.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, first + seen // block_chars)), batch.column(0).slice(some.start, n), *(pa.array(x) for x in (*found.n, found.groups.astype(np.int64))), pa.array(groups, pa.string()), pa.array(links, pa.binary())],
                    names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
                )
                seen += sum(map(len, texts[some]))
        one.own.words.forget()
        two.known = {}

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, doc_id long, n_a long, n_b long, n_groups long, groups string, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(block, pair, n): how often each block's texts hold each linked id pair, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, at, held, size = zstandard.ZstdDecompressor(), None, [], 0

        def out() -> pa.RecordBatch:
            key, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), at)), pa.array(key), pa.array(n)], names=["block", "pair", "n"])

        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at and held:
                    yield out()
                    held, size = [], 0
                at = block
                held.append(_unpacked(raw, unpacker))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:  # bounded; the sums are summed again
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return aligned.select("block", "links").mapInArrow(run, "block long, pair long, n long")


def aligned_documents(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    One row per row of ``docs``. Tokens are those of the byte-level file ``a``
    for a space and the text and of the piece model ``b`` for the text, special
    tokens' strings being plain text. Null and empty texts, and those whose
    tokens don't add up to a space and the text, have no tokens: zeros and ''.
    ``n_links``: tokens of both that end together; the count of an id pair
    is how many links of the corpus hold it; ``n_best``: links whose count
    is the highest that their ``b`` id has; ``count_sum``: over links. Repeated
    rows and doc_ids count each; doc_id may be null; no rows give no rows; other
    columns are ignored.

    Texts are tokenized once; ids and links are written to the shared folder.
    Counts are summed per task before any shuffle, so a pair comes to a reducer
    once a block at most. Each block then gets the counts of its own pairs,
    sorted before its documents: nothing is broadcast, and no document is
    joined pair by pair.
    """
    done = cut(alignments(docs, True, a, b))
    part = cut(pair_counts(done))
    total = part.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    total = cut(total)
    best = total.groupBy("b").agg(F.max("n").alias("best"))
    judged = total.join(best, "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    own = part.select("block", "pair").distinct().join(judged, "pair")
    rest = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]
    none = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in rest]
    stream = own.select("block", F.lit(0).alias("kind"), "pair", "n", "top", *none).unionByName(
        done.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("top"), *rest)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, at, held, ready = zstandard.ZstdDecompressor(), None, [], None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero(np.diff(block * 2 + kind)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(block)], strict=True):
                if i == j:
                    continue
                some = batch.slice(i, j - i)
                if block[i] != at:
                    at, held, ready = block[i], [], None
                if kind[i] == 0:
                    held.append([some.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)])
                    continue
                if ready is None:
                    pair, n, top = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
                    order = np.argsort(pair)
                    ready, held = (pair[order], n[order].astype(np.int64), top[order].astype(bool)), []
                sums, bests = [], []
                for raw in some.column(10).to_pylist():
                    key, m = _unpacked(raw, unpacker)
                    place = np.searchsorted(ready[0], key)
                    sums.append(int((m * ready[1][place]).sum()))
                    bests.append(int(m[ready[2][place]].sum()))
                yield pa.RecordBatch.from_arrays(
                    [some.column(5), some.column(6), some.column(7), some.column(8), some.column(8), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), some.column(9)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    ordered = stream.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind")
    return ordered.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
