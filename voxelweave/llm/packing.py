"""Packing: concatenate all token ids and cut them into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..plans.tables import cut, text_batches

#: White space beyond ASCII (and the separators that Python counts as such) before a space.
WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
PAIRS = tuple(c + " " for c in " \n\t\r\x0b\x0c")
#: Byte -> character of byte-level BPE: printable bytes stand for themselves, others come after 255.
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
BYTES = {b: b for b in PRINTED} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in PRINTED)}


def ranked_merges(tokenizer: Tokenizer) -> Callable[[bytes], list[int]] | None:
    """The tokenizer's own merges as ranks, run by tiktoken's core, several times as fast; None where ids don't follow the merges."""
    model, back = json.loads(tokenizer.to_str())["model"], {chr(c): b for b, c in BYTES.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if ids != sorted(ids) or len(set(ids)) < len(ids) or any(model["vocab"].get(c, -1) not in range(min(ids, default=256)) for c in back):
        return None
    ranks = {bytes(back[c] for c in token): n for token, n in model["vocab"].items() if set(token) <= back.keys()}
    # a special token in the vocabulary is not the result of a merge
    whole = {bytes(back[c] for c in a + b) for a, b in pairs}
    ranks = {token: n for token, n in ranks.items() if len(token) == 1 or token in whole}
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return core._core_bpe.encode_single_piece


def splits_at_spaces(tokenizer: Tokenizer) -> bool:
    """Is the file a byte-level BPE whose pre-tokenizer works by ``public_tokenizers.PATTERN`` on unchanged text?"""
    file = json.loads(tokenizer.to_str())
    model, before = file["model"], file["pre_tokenizer"] or {}
    same = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not file["normalizer"]
    return same and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))


class Words(dict):
    """Word -> the ids of a space and the word, as little-endian bytes; keeps about ``most`` recent words."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, dtype: str, most: int = 500_000):
        super().__init__()
        self.dtype, self.most, self.old = dtype, most, {}
        self.pieces = regex.compile(pattern).findall
        self.merge = splits_at_spaces(tokenizer) and ranked_merges(tokenizer) or (lambda piece: [t.id for t in tokenizer.model.tokenize(piece.decode("latin1").translate(BYTES))])

    def __missing__(self, word: str) -> bytes:
        if (found := self.old.pop(word, None)) is None:
            text = " " + word
            found = array("H" if self.dtype == "<u2" else "I", self.merge(text.encode()) if word.isalpha() else [t for x in self.pieces(text) for t in self.merge(x.encode())]).tobytes()
        self[word] = found
        return found

    def age(self) -> None:
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}


class CachedTokenizer:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian bytes.

    The pre-tokenizer of a byte-level BPE never joins a space to what stands
    before it, except within a run of white space. So a text is cut at its
    spaces, and each word goes once to the tokenizer's model. Texts with white
    space before a space, a space at the end or the special token are encoded
    whole, and so is every text if the file's pre-tokenizer is another.
    ``plain``: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.apart = splits_at_spaces(self.tokenizer)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Words(self.tokenizer, public_tokenizers.PATTERN, self.dtype)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.apart or text[-1] == " " or any(x in text for x in PAIRS) or any(x in text for x in self.special) or WIDE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return (self._whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[str, CachedTokenizer] = {}


def encoder_of(path: str) -> CachedTokenizer:
    """One encoder for each process; a task forgets its words at its end, as an idle process would hold their memory."""
    if path not in _encoders:
        _encoders[path] = CachedTokenizer(path)
    return _encoders[path]


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document's ids are those of the tokenizer file (null text: none) and
    ``end_id``. Pass 1 tokenizes each text once, notes the ids before it in
    its partition and writes ids and notes to the shared folder. The totals of
    the partitions, one row each, give every partition's global offset. Pass
    2 cuts each document at the multiples of ``length``. Only the last
    sequence is short. Repeated and null doc_ids are packed as they come; no
    rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = encoder_of(path), TaskContext.get().partitionId(), 0
        dtype = encoder.dtype
        last = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                ids = [encoder.encode(x) + last for x in batch.column(1).slice(i, 250).to_pylist()]
                encoder.words.age()
                n = np.array([len(x) for x in ids], np.int64) // np.dtype(dtype).itemsize
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(0).slice(i, 250), pa.array(n), pa.array(ids, pa.binary())], names=["part", "before", "doc_id", "doc_tokens", "ids"]
                )
                before = int(ends[-1]) if len(ends) else before
        encoder.words.forget()

    ids = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokens, "part int, before long, doc_id long, doc_tokens long, ids binary"))
    total, starts = 0, []
    for part, n in sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, first long"))  # a row per partition

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column(0).to_numpy()
            n = batch.column(2).to_numpy()
            windows = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            left = np.maximum(begin[row], (begin[row] // length + nth) * length)
            right = np.minimum(begin[row] + n[row], (begin[row] // length + nth + 1) * length)
            start, size = left - begin[row], right - left
            raw = batch.column(3).to_pylist()
            w = len(raw[0]) // int(n[0]) if raw else 1  # bytes of an id; each document has its last id at least
            cut_ids = [raw[r][s * w : (s + z) * w] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            doc = batch.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(start), pa.array(size), pa.array(cut_ids, pa.binary()), pa.array(n[row]), pa.array(left // length), pa.array(left % length)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            )

    return (
        ids.join(offsets, "part")
        .select((F.col("first") + F.col("before")).alias("begin"), "doc_id", "doc_tokens", "ids")
        .mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )


def piece_digests(docs: DataFrame, **options) -> DataFrame:
    """``packed_pieces`` with ids_crc32 (of unsigned little-endian 32-bit ids) in place of the ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_pylist()
            found = []
            for raw, n in zip(batch.column(3).to_pylist(), size, strict=True):
                found.append(zlib.crc32(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()))
            cols = list(batch.columns)
            cols[3] = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return packed_pieces(docs, **options).mapInArrow(crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
