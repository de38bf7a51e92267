"""MinHash near-dedup by a chosen-path set similarity join.

Follows the recursion of Christiani, Pagh and Sivertsen, "Scalable and Robust
Set Similarity Join" (2018): a node chooses coordinates of the MinHash
embedding, its sets branch by their values there, small nodes are compared
exhaustively, and independent trees repeat this.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.tables import cut, fresh, text_batches
from .wordhash import WordHash, mix, windows, words

COORDINATES = 48
_DRAW = np.random.default_rng(77)
_A = _DRAW.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_hashes(known: WordHash, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's word shingles."""
    w = words(text, lower=True)
    if not w:
        return np.empty(0, np.uint64)
    h = known.of(w)
    return np.unique(windows(h, min(size, len(h)), seed=0 if len(h) >= size else 1))


def _prints(h: np.ndarray) -> tuple[int, int]:
    """Fingerprints of a set, as unsigned sums over its hashes."""
    return int(h.sum(dtype=np.uint64)), int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            count, s1, s2, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(known, text, size)
                count.append(len(h))
                if not len(h):
                    s1.append(0), s2.append(0), sigs.append(None)
                    continue
                for at, x in zip((s1, s2), _prints(h), strict=True):
                    at.append(x)
                low = np.full(COORDINATES, np.uint64(2**64 - 1))
                for i in range(0, len(h), 2048):  # bounded work space for very long texts
                    low = np.minimum(low, (h[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
                sigs.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(sigs, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            found = [shingle_hashes(known, t, size) for t in batch.column(1).to_pylist()]
            prints = np.array([_prints(h) if len(h) else (0, 0) for h in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["id", "items", "s1", "s2"])

    return run


def _branches(node: F.Column, sig: F.Column) -> F.Column:
    """Children of a node for one set: one chosen coordinate, and a second for a third of the nodes."""

    def child(n: int):
        at = F.pmod(F.xxhash64(node, F.lit(n)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, at, sig[at])

    second = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(3)) == 0
    return F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))


def trees_for(recall: float, percent: int, depth: int) -> int:
    """Trees needed so that a pair at the threshold stays together down to ``depth`` in one of them with probability ``recall``.

    A shared node has one child, which both sets take with probability s, or in
    a third of the nodes two; so the pair's shared nodes are a branching process.
    """
    s, together = percent / 100, 1.0
    for _ in range(depth):
        apart = 1 - s * together
        together = 1 - (2 * apart + apart * apart) / 3
    return 1 if together >= 1 else ceil(log(1 - recall) / log(1 - together))


def near_components(docs: DataFrame, size: int = 5, percent: int = 75, recall: float = 0.999, small: int = 12, depth: int = 3) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row each: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct ``size``-word shingles of its whole
    text, A-Z lower-cased (fewer words: the whole sequence; none, or null:
    empty, linked with nothing). Documents with equal sets are one class.
    Classes link at 100 * intersection >= ``percent`` * union, confirmed on the
    full sets. Rows with a null doc_id are linked with nothing, keep a null
    component and stay. Rows that repeat a doc_id stand for one document that
    links where any of them does.

    1. One pass over the texts gives set sizes, fingerprints of sets and
       MinHash coordinates. 2. Nodes of over ``small`` sets branch, to
    ``depth`` levels.
    3. In every node all sets are compared with the
    smallest id, so a dense group of any size becomes connected by as many
    pairs as it has members. 4. In leaves of at most ``small`` sets, those that
    are still in different components are compared with each other. Larger
    leaves that hold several components form families, whose links
    ``_family_pairs`` finds exactly without comparing all with all.

    The number of trees follows from ``recall``: the probability that a pair at
    the threshold itself, whose nodes all stay large, meets in a leaf; in a family it
    meets even if it shares no leaf. Candidates whose 48 coordinates agree in
    under a fifth are not confirmed: of a link's, that is 3 in 10 ** 17.
    """
    trees = trees_for(recall, percent, depth)
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(texts.mapInArrow(_sketches(size), "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"))
    key = ["s1", "s2", "n_shingles"]
    classes = cut(rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    reps = classes.select("id", "s1", "s2", F.col("n_shingles").alias("n"), "sig")

    level = reps.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("node"), "sig")
    stars, leaves = [], []
    for d in range(depth):
        members = level.select("id", F.explode(F.array_distinct(_branches(F.col("node"), F.col("sig")))).alias("node"))
        nodes = members.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("low")).filter("m > 1")
        held = cut(members.join(nodes, "node"))
        # one pair a set and level is enough to connect a dense group; what it misses is left to the leaves
        stars.append(held.groupBy(F.col("id").alias("b")).agg(F.min("low").alias("a")).filter("a <> b").select("a", "b"))
        leaves.append(held.filter(F.col("m") <= small).select("node", "id"))
        large = held.filter(F.col("m") > small)
        level = large.select("node", "id").join(reps.select("id", "sig"), "id")
    pairs, leaf = stars[0], leaves[0]
    for x, y in zip(stars[1:], leaves[1:], strict=True):
        pairs, leaf = pairs.unionByName(x), leaf.unionByName(y)

    def alike(p: DataFrame) -> DataFrame:
        """Pairs of fitting sizes whose coordinates agree in more than chance; no link's agree so rarely."""
        for end in ("a", "b"):
            p = p.join(reps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)
        return p.filter(near_sizes & close).select("a", "b")

    near_sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    close = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= int(COORDINATES * (percent / 100 - 0.55))
    pairs = cut(alike(pairs.distinct()))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = ids.distinct()
        return cut(texts.withColumnRenamed("doc_id", "id").join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets(size), "id long, items array<long>, s1 long, s2 long").filter(F.size("items") > 0))

    linked = cut(_confirmed(pairs, sets_of(_ends(pairs)), percent))

    # only what is not yet connected is compared again
    found = components(linked)
    at = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"component_{end}"))
    place = leaf.distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = place.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("node")
    part = cut(place.join(mixed, "node").join(reps.select("id", "n", "sig"), "id"))
    a = part.select("node", *[F.col(c).alias(f"{c}_a") for c in ("id", "component", "n", "sig")])
    b = part.select("node", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "n", "sig")])
    near = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & near_sizes
    rest = a.join(b, "node").filter(near).filter(close).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    # components that meet in a large leaf are one family
    crowd = cut(large.select("id", "low").distinct().join(at("id"), "id", "left").join(at("low"), "low", "left").select("id", F.coalesce("component_id", "id").alias("component"), F.coalesce("component_low", "low").alias("with")))
    families = cut(components(crowd.select(F.col("component").alias("a"), F.col("with").alias("b")))).select(F.col("id").alias("component"), F.col("component").alias("family"))
    home = cut(crowd.select("id", "component").distinct().join(families, "component"))
    if home.take(1):
        rest = rest.unionByName(_family_pairs(sets_of(home.select("id")).join(home, "id"), percent))
    rest = cut(rest.distinct())
    more = cut(_confirmed(rest, sets_of(_ends(rest)), percent)) if rest.take(1) else rest
    found = cut(components(linked.unionByName(more)) if more.take(1) else found)

    home = classes.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    # rows without a set have one key, and no class to look up
    real = F.col("n_shingles") > 0
    placed = rows.drop("sig").filter(real).join(home, key, "left").unionByName(rows.drop("sig").filter(~real), allowMissingColumns=True)
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def _family_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(id, s1, s2, items, component, family)`` -> pairs (a, b) that connect all links between components of a family.

    A family's core holds the items of over half of its sets, so at most twice
    as many as a set has on average. Sets are told by their difference D from the
    core. As x and y differ in as many items as Dx and Dy, a pair links if and only if
    2 (100 + percent) size(Dx & Dy) >= Fx + Fy, where
    F = (100 + percent) size(D) - (100 - percent) size(x). Pairs with Fx + Fy <= 0
    link for sure, and so with the set of least F: one pair each. All others
    share items of their differences, which are ordered by how many of the family
    have them; as in a prefix-filter join two such sets meet in the first items of
    both, with enough items left behind the common one. Items that one set alone has do
    not count. Every link wanted has an end outside of the largest component,
    so that is one side of the join.
    """
    one, key = (100 + percent), ["id", "s1", "s2", "component", "family", "n", "f"]
    sets = cut(sets.dropDuplicates(["id", "s1", "s2"]))
    members = sets.groupBy("family").agg(F.count("*").alias("members"))
    count = sets.select("family", F.explode("items").alias("item")).groupBy("family", "item").agg(F.count("*").alias("c"))
    core = 2 * F.col("c") > F.col("members")
    items = cut(count.join(members, "family").select("family", "item", core.alias("core"), F.when(core, F.col("members") - F.col("c")).otherwise(F.col("c")).alias("have")).filter("core or have > 1"))
    cores = items.filter("core").groupBy("family").agg(F.collect_list("item").alias("core"))
    none = F.coalesce("core", F.array().cast("array<bigint>"))
    apart = F.concat(F.array_except("items", none), F.array_except(none, "items"))
    differ = sets.join(cores, "family", "left").withColumn("differ", apart).withColumn("n", F.size("items").cast("long"))
    differ = cut(differ.withColumn("f", one * F.size("differ") - (100 - percent) * F.col("n")).select(*key, "differ"))

    best = differ.groupBy("family").agg(F.min(F.struct("f", "id", "component")).alias("best"))
    sure = differ.join(best, "family").filter((F.col("f") + F.col("best.f") <= 0) & (F.col("component") != F.col("best.component"))).select(F.col("best.id").alias("x"), F.col("id").alias("y"))

    some = differ.select(*key, F.explode("differ").alias("item")).join(items.filter("have > 1").select("family", "item", "have"), ["family", "item"])
    some = cut(some.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("have", "item"))).alias("shared")).withColumn("size", F.size("shared").cast("long")))
    limits = some.groupBy("family").agg(F.min("f").alias("low"), F.max(2 * one * F.col("size") - F.col("f")).alias("high"))
    main = differ.groupBy("family", "component").agg(F.count("*").alias("c")).groupBy("family").agg(F.max(F.struct("c", "component")).alias("_m")).select("family", F.col("_m.component").alias("main"))
    least = F.greatest(F.ceil((F.col("f") + F.col("low")) / (2.0 * one) - 1e-9), F.lit(1)).cast("int")  # items in common, at least
    first = some.join(limits, "family").filter("f <= high").withColumn("head", F.slice("shared", 1, F.greatest(F.size("shared") - least + 1, F.lit(0))))
    first = cut(first.join(main, "family").select(*key, "size", (F.col("component") == F.col("main")).alias("in_main"), F.posexplode("head").alias("place", "_i")).select(*key, "in_main", F.col("_i.item").alias("item"), (F.col("size") - F.col("place")).alias("left")))
    end = lambda e: first.select("family", "item", *[F.col(c).alias(f"{c}_{e}") for c in ("id", "component", "n", "f", "left", "in_main")])
    need = F.col("f_a") + F.col("f_b")
    once = F.col("in_main_b") | (F.col("id_a") < F.col("id_b"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    fits = (F.col("component_a") != F.col("component_b")) & once & near & (need > 0) & (2 * one * F.least("left_a", "left_b") >= need)
    met = end("a").filter("not in_main_a").join(end("b"), ["family", "item"]).filter(fits).select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    return sure.unionByName(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    return pairs.join(one, "a").join(two, "b").withColumn("shared", shared).filter(100 * F.col("shared") >= percent * union).select("a", "b").distinct()


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are not the smallest doc_id of their component; all columns stay.

    Rows that stay: those with a null doc_id, those whose text is null or has no words,
    and every row of a doc_id that is kept, repeats included. Of equal texts
    the smallest doc_id stays. No rows give no rows; other columns may have any name.
    """
    doc = fresh("_doc", docs.columns)
    drop = near_components(docs, **options).filter("not kept").select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(doc), "left_anti")
