"""Fingerprints: against sets, a plain densification, and odd rows."""

from hashlib import sha256
from time import process_time

import numpy as np
from pyspark.sql import functions as F

from voxelweave.llm import fingerprints as fp
from voxelweave.llm.queries import QUERIES
from voxelweave.llm.wordhash import WordHash, mix, windows
from voxelweave.plans.tables import read

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in read(spark, SF, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op13_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        own = shingles(text)
        for near, other in ((r.near_edited, shingles(edited)), (r.near_next, shingles(after))):
            j = jaccard(own, other)
            errors.append((near - j) / (0.02 + (j * (1 - j) / min(fp.BINS, max(len(own | other), 1))) ** 0.5))
    assert np.abs(errors).max() < 5 and abs(np.mean(errors)) < 0.2  # unbiased
    equal = {}
    for doc, text in docs:
        assert equal.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(read(spark, SF, "documents")).collect()}
    assert plain == {d: r.fingerprint for d, r in got.items()}


def test_densification_equals_a_plain_loop():
    known, texts = WordHash(), ["a b c d e f g h", "one", "", " ".join(f"w{i}" for i in range(3000)), "x y z u v w"]
    bits, has = fp.low_bits(known, texts)
    assert has.tolist() == [True, True, False, True, True]
    for text, row, some in zip(texts, bits, has, strict=True):
        if not some:
            continue
        h = known.of([w.encode() for w in text.split()])
        grams = windows(h, 5) if len(h) >= 5 else windows(h, len(h), seed=1)
        low = {}
        for g in grams.tolist():
            low[g >> 54] = min(g, low.get(g >> 54, g))
        for to in range(0, fp.BINS, 1 if len(low) > 20 else 40):
            at, attempt = to, 0
            while at not in low:
                at = int(mix(np.array([to], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))[0]) >> 54
                attempt += 1
            assert row[to] == int(mix(np.array([low[at]], np.uint64) ^ fp._SALT[to : to + 1])[0]) & 15


def test_likeness_is_unbiased_over_planted_similarities():
    rng, known = np.random.default_rng(2), WordHash()
    for size in (6, 30, 300, 3000):
        found = []
        for trial in range(40):
            common = [f"c{trial}x{i}" for i in range(size // 2)]
            a = common + [f"a{trial}x{i}" for i in range(size - len(common))]
            b = common + [f"b{trial}x{i}" for i in range(size - len(common))]
            j = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
            bits, has = fp.low_bits(known, [" ".join(a), " ".join(b)])
            found.append(float(fp.likeness((bits[:1], has[:1]), (bits[1:], has[1:]))[0]) - j)
        assert abs(np.mean(found)) < 0.03 and np.std(found) < 1.5 * (0.25 / min(size, fp.BINS)) ** 0.5 + 0.01


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(5, long), (4, None), (3, "a b c"), (3, "a b c"), (2, "a b c d e f"), (1, ""), (None, "é ü"), (9, " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("key", "hash", "to", "follower", "before", "n_chars", "Fingerprint")])
    for data in (docs, docs.repartition(5), docs.coalesce(1)):
        got = fp.edited_fingerprints(data).collect()
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == [-1, 1, 2, 3, 3, 4, 5, 9]
        by = {r.doc_id: r for r in got}
        assert by[4].fingerprint == by[1].fingerprint == by[9].fingerprint == "" and by[4].near_edited == 1 and by[4].near_next == 0 and by[9].near_next == 0
        assert by[5].n_chars == len(long) and by[5].edited_sha256 == sha256(long[: len(long) - len(long) // 3].encode()).hexdigest()
        assert by[None].n_chars == 3 and by[None].edited_sha256 == sha256("é  ".encode()).hexdigest()  # the last is followed by the first
        assert by[2].edited_sha256 == sha256(b"a b c d ").hexdigest()  # the next text is empty
        assert sorted(r.near_next for r in got if r.doc_id == 3)[-1] == 1.0
    assert fp.edited_fingerprints(docs.limit(0)).collect() == []
    one = fp.edited_fingerprints(docs.filter("doc_id = 2")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == sha256(b"a b c d a b").hexdigest()


def test_densification_takes_less_than_a_loop_over_attempts():
    def loop(low, some):
        filled, out, attempt = low != fp._EMPTY, low.copy(), 0
        row, to = np.nonzero(~filled & some[:, None])
        while len(row):
            at = fp._donors(to, attempt)
            ok = filled[row, at]
            out[row[ok], to[ok]] = low[row[ok], at[ok]]
            row, to, attempt = row[~ok], to[~ok], attempt + 1
        return out

    rng = np.random.default_rng(5)
    low = rng.integers(0, 2**62, (300, fp.BINS), dtype=np.uint64)
    low[rng.random(low.shape) > 0.25] = fp._EMPTY
    low[0], low[1], low[1, 7], low[2], low[2, 3:5] = fp._EMPTY, fp._EMPTY, 11, fp._EMPTY, (12, 13)
    some = np.arange(300) > 0
    spent = []
    for f in (fp.densified, loop):
        begun = process_time()
        spent.append((f(low, some), process_time() - begun))
    assert (spent[0][0] == spent[1][0]).all() and (spent[0][0][0] == fp._EMPTY).all()
    assert spent[0][1] < 0.7 * spent[1][1]
