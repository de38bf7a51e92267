"""Cross-tokenizer alignment: against the libraries' own encoders and plain loops, and odd rows."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelweave.llm import alignment, packing
from voxelweave.llm.queries import QUERIES
from voxelweave.plans.tables import read

SF = "/root/testdata/sf0.001"
BACK = {chr(c): b for b, c in packing.BYTES.items()}


@pytest.fixture(scope="module")
def plain():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        if not text:
            return None
        e = one.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(BACK[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None

    return tokens


def aligned(tokens):
    """Groups and links by walking along both lists."""
    if tokens is None:
        return [], [], ""
    ends = [{e: i for i, e in enumerate(np.cumsum([len(x) for _, x in side]).tolist(), 1)} for side in tokens]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0][cut], ends[1][cut]
        groups.append(",".join(str(t) for t, _ in tokens[0][i:p]) + "|" + ",".join(str(t) for t, _ in tokens[1][j:q]))
        links.append((tokens[0][p - 1][0], tokens[1][q - 1][0]))
        i, j = p, q
    return groups, links, ";".join(groups)


def expected(plain, rows):
    found = [(doc, t, *aligned(t)) for doc, t in ((d, plain(x)) for d, x in rows)]
    count = Counter(p for _, _, _, links, _ in found for p in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (doc if doc is not None else -1, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha256(text.encode()).hexdigest() if text else "")
        for doc, t, groups, links, text in found
    )


def got(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_query_equals_brute_force(spark, plain):
    docs = read(spark, SF, "documents")
    assert got(QUERIES["op12_tokenizer_alignment"](spark, SF).collect()) == expected(plain, [(r.doc_id, r.text) for r in docs.collect()])


ROWS = [
    (1, "plain words, 12 34 don't"), (1, "plain words, 12 34 don't"), (2, None), (3, ""), (4, " "), (5, "  lead  and trail  "), (6, "a\n b \n\nc\t d"), (7, "x <|endoftext|> </s> <s> <unk> <0x41> y"),
    (8, "a▁b"), (9, "日本語の文 ÄÖ ﬁ 👩‍👩‍👧 é"), (None, "null id"), (10, "　 wide\xa0  space"), (11, " ".join(f"w{i % 977}x{i}" for i in range(20_000))), (12, "x" * 5000 + "é" * 300), (13, "\x00\x01 ctrl"), (14, "trail "), (15, "\n"),
]


def test_odd_rows(spark, plain):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("block", "pair", "n", "kind", "top", "best", "links", "Groups")])
    want = expected(plain, ROWS)
    for data in (docs.repartition(5), docs.coalesce(1)):
        assert got(alignment.aligned_documents(data).collect()) == want
    assert alignment.aligned_documents(docs.limit(0)).collect() == []
    texts = {(r.doc_id, r.groups) for r in alignment.alignments(docs, block_chars=1).collect()}
    assert texts == {(d, aligned(plain(t))[2]) for d, t in ROWS}


def test_leaf_groups_on_random_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique([*rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n]) for _ in range(2))
        assert alignment.leaf_groups(a, b, np.array([0]), np.array([n])).tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_tokenizer_of_another_kind_is_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = packing.CachedTokenizer(path), Tokenizer.from_file(path)
    for text in ("Hello  World 12", "it's A test\n of Words", "ÄÖ x"):
        assert np.frombuffer(mine.encode(text), mine.dtype).tolist() == theirs.encode(text, add_special_tokens=False).ids
