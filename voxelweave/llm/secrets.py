"""Secret scans: fixed patterns, and Markov models of random strings and ordinary words. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let

#: Fixed patterns: kind, pattern, group whose length counts, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters from + to z have a place in the models.
FIRST, PLACES = ord("+"), ord("z") - ord("+") + 1


def _pairs(token: Column) -> Column:
    """Places of neighbouring characters, as one number a pair."""
    code = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    return let(code, lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: x * PLACES + y))


def samples(docs: DataFrame, sample: int = 1000, seed: str = "markov") -> DataFrame:
    """``(random, token, held)``: labelled tokens, from at most ``sample`` documents (the smallest hashes of doc_id).

    Ordinary: the words of 5 and more characters of their texts as they stand and in
    capitals, and identifiers of three neighbouring words (joined by _, by -,
    and in camel case); what the fixed patterns match is left out. Random: base64,
    hexadecimal and mixed-case strings of 20 to 44 characters of digests of the doc_id. ``held``: a
    fifth of the tokens, by hash, for ``held_out``.
    """
    ids = docs.select(F.col("doc_id").alias("id"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample).distinct()  # of few columns; texts follow
    texts = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("doc").eqNullSafe(F.col("id"))).select("id", "text").orderBy(F.xxhash64("id"), "id", F.length("text")).limit(sample)
    text = F.col("text")
    for _, pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " ")
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_.-]{4,}"), F.lit(0))
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3)), lambda i: F.slice("w", i, 3))
    names = lambda x: F.array(F.array_join(x, "_"), F.array_join(x, "-"), F.replace(F.initcap(F.array_join(x, " ")), F.lit(" "), F.lit("")))
    both = F.concat("w", F.transform("w", F.upper), F.when(F.size("w") > 2, F.flatten(F.transform(three, names))).otherwise(F.array().cast("array<string>")))
    ordinary = rows.select(words.alias("w")).select(F.lit(False).alias("random"), F.explode(both).alias("token"))
    digest = lambda n: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed), F.lit(n)), 512)
    text64 = lambda n: F.translate(F.base64(F.unhex(digest(n))), "\r\n=", "")
    plain = lambda n: F.translate(text64(n), "+/", "")
    drawn = F.array(text64(1), F.translate(text64(2), "+/", "-_"), plain(3), F.lower(plain(4)), F.upper(plain(5)), digest(6))
    drawn = F.transform(drawn, lambda x, i: F.left(x, F.lit(20) + F.pmod(F.xxhash64("id", i), F.lit(25)).cast("int")))
    random = rows.select(F.lit(True).alias("random"), F.explode(drawn).alias("token"))
    return random.unionByName(ordinary).withColumn("held", F.pmod(F.xxhash64("token", F.lit(6)), F.lit(5)) == 0)


def train(docs: DataFrame, **options) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of characters, from the ``samples`` that are not held out.

    Add-one estimates of the transitions; the table has a fixed size, whatever
    the input. No rows give a table of zeros.
    """
    tokens = samples(docs, **options).filter("not held")
    seen = tokens.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    counts = {(r.random, r.pair): r.n for r in seen.collect()}  # at most two tables of PLACES squared
    total = {k: [sum(counts.get((k, a * PLACES + b), 0) for b in range(PLACES)) + PLACES for a in range(PLACES)] for k in (True, False)}
    rate = lambda k, p: math.log((counts.get((k, p), 0) + 1) / total[k][p // PLACES])
    return [rate(True, p) - rate(False, p) for p in range(PLACES**2)]


def _table(table: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>").alias("ratios")


def _score(token: Column) -> Column:
    """Mean log-likelihood ratio of a token's pairs; needs a column ``ratios``."""
    return let(_pairs(token), lambda p: F.aggregate(F.transform(p, lambda x: F.element_at("ratios", x + 1)), F.lit(0.0), lambda a, x: a + x) / F.size(p))


def held_out(docs: DataFrame, table: list[float], threshold: float = 0.8, **options) -> DataFrame:
    """One row: n_random, n_ordinary, recall and precision of ``threshold`` on the held-out tokens that ``scan`` would judge."""
    tokens = samples(docs, **options).filter("held").distinct().filter(F.regexp_like("token", F.lit(f"^{CANDIDATE}$"))).select("random", "token", _table(table))
    hit = F.sum((_score(F.col("token")) > threshold).cast("int"))
    by = tokens.groupBy("random").agg(F.count("*").alias("n"), hit.alias("hit"))
    of = lambda c, k: F.coalesce(F.max(F.when(F.col("random") == k, F.col(c))), F.lit(0))
    return by.agg(of("n", True).alias("n_random"), of("n", False).alias("n_ordinary"), F.try_divide(of("hit", True), of("n", True)).alias("recall"), F.try_divide(of("hit", True), of("hit", True) + of("hit", False)).alias("precision"))


def _matches(text: Column, pattern: str, kind: str, rank: int, keep) -> Column:
    """Array of (start, rank, kind, end, token) in code points, leftmost and non-overlapping."""
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,token:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        m, g, want = both["m"], both["g"], both["want"]
        step = F.transform(m, lambda x, i: F.struct((F.length(g[i])).alias("gap"), F.length(x).alias("n"), x.alias("token"), F.length(want[i]).alias("size")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        run = F.aggregate(
            step,
            start,
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["n"]).alias("at"),
                F.when(
                    keep(s),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + s["gap"] + s["n"]).alias("end"), s["token"].alias("token")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return run

    group = next((g for k, _, g, _ in BASE if k == kind), 0)
    want = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.struct(found.alias("m"), gaps.alias("g"), want.alias("want")), place)).otherwise(empty)


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float = 0.8) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row each: doc_id, base and added spans.

    ``base``: matches of the fixed patterns. ``added``: runs of 20 and more
    token characters that overlap no base span and whose mean log-likelihood
    ratio per pair of characters is over ``threshold``, kind ``random``. Null
    text is empty; rows are judged one by one, null or repeated doc_ids as they
    come; no rows give no rows; other columns are ignored. ``table``: from
    ``train``, by default on ``docs``.
    """
    table = train(docs) if table is None else table
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[_matches(F.col("t"), pattern, kind, i, lambda s, n=least: s["size"] >= n) for i, (kind, pattern, _, least) in enumerate(BASE)])
    tokens = _matches(F.col("t"), CANDIDATE, "random", len(BASE), lambda s: F.lit(True))
    first = docs.select("doc_id", text.alias("t")).select("doc_id", base.alias("base"), tokens.alias("tokens"), _table(table))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.filter("tokens", lambda x: apart(x) & (_score(x["token"]) > threshold))
    return first.select("doc_id", F.array_sort("base").alias("base"), added.alias("added"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, **options).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))
