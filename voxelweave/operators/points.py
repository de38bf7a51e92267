"""Points: filters, proximity joins on grid cells, duplicates, matching and clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, free, partitions, shuffled
from .components import components
from .ranks import quantiles, running

AXES = ("z", "y", "x")


def in_channels(points: DataFrame, channels: Sequence[int] | None) -> DataFrame:
    return points if channels is None else points.filter(F.col("channel").isin(*channels))


def in_box(points: DataFrame, offset: Sequence[float], size: Sequence[float], margin: Sequence[float] = (0, 0, 0), inside: bool = True) -> DataFrame:
    """The half-open box [offset - margin, offset + size + margin)."""
    ok = F.lit(True)
    for c, o, s, m in zip(AXES, offset, size, margin, strict=True):
        ok = ok & (F.col(c) >= o - m) & (F.col(c) < o + s + m)
    return points.filter(ok if inside else ~ok)


def shifted(points: DataFrame, by: Sequence[float], factor: Sequence[float] = (1, 1, 1)) -> DataFrame:
    return points.withColumns({c: F.col(c) * f + b for c, b, f in zip(AXES, by, factor, strict=True)})


def changed(points: DataFrame, fn: Callable[[DataFrame], DataFrame], where: Column | None = None) -> DataFrame:
    """``fn`` applied to the points, or to those of ``where`` alone; columns stay as they are."""
    if where is None:
        return fn(points).select(*points.columns)
    on = F.coalesce(where, F.lit(False))
    return fn(points.filter(on)).select(*points.columns).unionByName(points.filter(~on))


def stored(points: DataFrame) -> DataFrame:
    """Blobs as the store keeps them: absolute place, radius and flags."""
    return points.select(*[F.col(f"abs_{c}").cast("int").alias(c) for c in AXES], "radius", "confirmed", "truth", "channel")


def with_flag(points: DataFrame, column: str, value: int, where: Column) -> DataFrame:
    return points.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def cleaned(points: DataFrame) -> DataFrame:
    """Confirmed points only; radii of hand-made ones (about 0) become -5."""
    return points.filter("confirmed = 1").withColumn("radius", F.when(F.abs("radius") < 0.001, -5.0).otherwise(F.col("radius")))


def scaled_index(points: DataFrame, scale: Sequence[float], shape: Sequence[int] | None = None) -> DataFrame:
    """Without a shape truncated; with one rounded half-even and clipped at the far side."""
    to = lambda c, f, n: (F.col(c) * f).cast("int") if n is None else F.least(F.bround(F.col(c) * f).cast("int"), F.lit(n - 1))
    return points.withColumns({f"{c}_index": to(c, f, n) for c, f, n in zip(AXES, scale, shape or (None,) * 3, strict=True)})


def first_of_each(points: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exact duplicates: the first row by ``order`` of each key, as a grouped minimum."""
    rest = [c for c in points.columns if c not in key and c not in order]
    return points.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*key, "_r.*").select(*points.columns)


def near_pairs(a: DataFrame, b: DataFrame, tolerance: Sequence[float], keys: Sequence[str] = (), axes: Sequence[str] = AXES) -> DataFrame:
    """All pairs with |a - b| <= tolerance on every axis and equal ``keys``; columns end in _a and _b.

    An equi-join on keys and grid cells twice as wide as the tolerance, ``b`` copied
    to the cells in its reach (mostly two on an axis) and never broadcast, so that no nested-loop join is planned and AQE
    may split crowded cells.
    """
    cell = lambda x, t: F.floor(x / (2 * max(t, 1e-9))).cast("long")
    far = lambda c, t: max(t, 1e-9) + F.abs(F.col(c)) * 1e-12  # noqa: E731  # rounding never leaves out a cell
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns], *[cell(F.col(c), t).alias(f"_c{i}") for i, (c, t) in enumerate(zip(axes, tolerance, strict=True))])
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    for i, (c, t) in enumerate(zip(axes, tolerance, strict=True)):
        x, r = F.col(f"{c}_b"), far(f"{c}_b", t * (1 + 1e-9))
        right = right.withColumn(f"_c{i}", F.explode(F.sequence(cell(x - r, t), cell(x + r, t))))
    for i, k in enumerate(keys):
        left, right = left.withColumn(f"_k{i}", F.col(f"{k}_a")), right.withColumn(f"_k{i}", F.col(f"{k}_b"))
    joined = left.join(shuffled(right), [*[f"_k{i}" for i in range(len(keys))], *[f"_c{i}" for i in range(len(axes))]])
    for c, t in zip(axes, tolerance, strict=True):
        joined = joined.filter(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= t)
    return joined.select(*[f"{c}_a" for c in a.columns], *[f"{c}_b" for c in b.columns])


def squared(axes: Sequence[str] = AXES) -> Column:
    return sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in axes), F.lit(0.0))


def without_close(check: DataFrame, master: DataFrame, tolerance: Sequence[float], keys: Sequence[str] = (), key: str = "blob_id") -> DataFrame:
    """Rows of ``check`` that have no row of ``master`` within the tolerance box. Places are compared, whatever the number of points there."""
    cols = [*keys, *AXES]
    close = near_pairs(check.select(*cols).distinct(), master.select(*cols).distinct(), tolerance, keys).select(*[F.col(f"{c}_a").alias(c) for c in cols]).distinct()
    return check.join(shuffled(close), cols, "left_anti").select(*check.columns)


def absorbed(check: DataFrame, master: DataFrame, tolerance: Sequence[float], keys: Sequence[str] = (), key: str = "blob_id") -> DataFrame:
    """``master`` with the places of points that absorb others: the half-even mean with the last (by id) close row of ``check``."""
    cols = [key, *keys, *AXES]
    pairs = near_pairs(check.select(*cols), master.select(*cols), tolerance, keys)
    last = pairs.groupBy(F.col(f"{key}_b").alias(key)).agg(F.max(F.struct(f"{key}_a", *[F.bround((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(c) for c in AXES])).alias("_m"))
    out = master.join(shuffled(last), key, "left")
    return out.select(*[F.coalesce(F.col(f"_m.{c}"), out[c]).alias(c) if c in AXES else F.col(c) for c in master.columns])


def kept_first(pairs: DataFrame) -> DataFrame:
    """``pairs(later, earlier)`` of ids that exclude each other -> the ids ``later`` that go: those with a kept earlier one.

    Rounds: one without an undecided or kept earlier neighbour is kept; then those near a kept one go; until none is undecided.
    """
    left, gone = cut(pairs.distinct()), None
    while not left.isEmpty():
        waiting = left.select(F.col("later").alias("earlier")).distinct()
        kept = left.select("earlier").distinct().join(shuffled(waiting), "earlier", "left_anti")
        out = cut(left.join(shuffled(kept), "earlier").select("later").distinct())
        gone = out if gone is None else gone.unionByName(out)
        done = out.select(F.col("later").alias("earlier"), F.lit(True).alias("_gone"))
        old, left = left, cut(left.join(shuffled(out), "later", "left_anti").join(shuffled(done), "earlier", "left_anti"))
        free(old)
    return left.select("later") if gone is None else gone


def thinned(points: DataFrame, tolerance: Sequence[float], keys: Sequence[str] = (), key: str = "blob_id") -> DataFrame:
    """Keep-first in z, y, x order: a point goes if a kept earlier one is within the tolerance.

    Of the points of one place all but the first go, so rounds run over
    places: one without an undecided or kept earlier neighbour is kept; then those
    near a kept one go; until none is undecided. The same result as
    one sequential scan; a chain takes a round for each two of its places.
    """
    cols = [*keys, *AXES]
    places = cut(points.filter(" and ".join(f"{c} is not null" for c in cols)).groupBy(*cols).agg(F.min(key).alias(key)))
    order = lambda e: F.struct(*[F.col(f"{c}_{e}") for c in AXES])
    pairs = near_pairs(places, places, tolerance, keys).filter(order("b") < order("a")).select(F.col(f"{key}_a").alias("later"), F.col(f"{key}_b").alias("earlier"))
    gone = kept_first(pairs).select(F.col("later").alias(key))
    stays = places.select(key).join(shuffled(gone), key, "left_anti")
    without = points.filter(" or ".join(f"{c} is null" for c in cols))  # near nothing
    return points.join(shuffled(stays.unionByName(without.select(key))), key, "left_semi")


def pruned_tiles(points: DataFrame, tile: Sequence[int], overlap: Sequence[float], tolerance: Sequence[float], key: str = "blob_id") -> DataFrame:
    """Duplicates in the overlap of neighbouring tiles, axis by axis z, y, x: those of the next tile go."""
    for c, size, wide in zip(AXES, tile, overlap, strict=True):
        at = F.floor(F.col(c) / size)
        band = points.withColumn("_t", at)
        low = band.filter(F.col(c) - F.col("_t") * size >= size - wide).withColumn("_t", F.col("_t") + 1)
        high = band.filter(F.col(c) - F.col("_t") * size < wide)
        points = cut(without_close(high, low, tolerance, ("channel", "_t")).unionByName(band.filter(~(F.col(c) - F.col("_t") * size < wide) | F.col(c).isNull())).drop("_t"))
    return points


def _ranked(points: DataFrame, place: Sequence[str], key: str) -> DataFrame:
    """``points`` with ``_p``, the smallest id at its place, and ``_i``, its rank by id there.

    Ranks are counted in ranges of (place, id), so a crowded place is spread over tasks.
    """
    there = points.select(*place, key).distinct()
    first = there.groupBy(*place).agg(F.min(key).alias("_p"))
    there = there.join(shuffled(first), list(place))  # without nulls, which are near nothing
    there = cut(there.repartitionByRange(partitions(points.sparkSession), "_p", key).withColumn("_block", F.spark_partition_id()))
    before = Window.partitionBy("_p").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = there.groupBy("_p", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_p", "_block").orderBy(key))
    return cut(there.withColumn("_i", rank).join(shuffled(blocks.drop("_n")), ["_p", "_block"]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_block", "_before"))


def greedy_matches(a: DataFrame, b: DataFrame, tolerance: Sequence[float], keys: Sequence[str] = (), key: str = "blob_id") -> DataFrame:
    """One-to-one matches, smallest sum of axis distances first (ties by ids); ids are unique in each table.

    Rounds over pairs of places, as all points of a place have the same gaps:
    in a pair of places whose first free points are mutually best, the i-th
    free points match, up to the first id at which another place with the
    same gap comes in. What is free at a place is always the end of its list.
    Goes on until no pair is left. Places that tie with others of the same gap
    may need as many rounds as they have points.
    """
    place = [*keys, *AXES]
    one, two = _ranked(a, place, key), _ranked(b, place, key)
    spots = lambda t: t.select("_p", *place).distinct()
    gap = sum((F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in AXES), F.lit(0.0))
    left = cut(near_pairs(spots(one), spots(two), tolerance, keys).select(F.col("_p_a").alias("p"), F.col("_p_b").alias("q"), gap.alias("gap")))
    one = one.select(F.col("_p").alias("p"), F.col(key).alias("a"), F.col("_i").alias("i"))
    two = two.select(F.col("_p").alias("q"), F.col(key).alias("b"), F.col("_i").alias("i"))
    done, n = None, 0
    while True:
        head_a = one.groupBy("p").agg(F.min("a").alias("a"), F.min("i").alias("i_a"))
        head_b = two.groupBy("q").agg(F.min("b").alias("b"), F.min("i").alias("i_b"))
        left = cut(left.select("p", "q", "gap").join(shuffled(head_a), "p").join(shuffled(head_b), "q"))
        if left.isEmpty():
            return left.select("a", "b", "gap") if done is None else done
        best_p = left.groupBy("p").agg(F.min(F.struct("gap", "b", "q")).alias("_b")).select("p", F.col("_b.q").alias("q"))
        best_q = left.groupBy("q").agg(F.min(F.struct("gap", "a", "p")).alias("_a")).select("q", F.col("_a.p").alias("p"))
        pairs = cut(left.join(shuffled(best_p), ["p", "q"]).join(shuffled(best_q), ["p", "q"]))
        rival = lambda end, other, head: left.join(shuffled(pairs.select(end, F.col(other).alias("_o"), F.col("gap").alias("_g"))), end).filter((F.col("gap") == F.col("_g")) & (F.col(other) != F.col("_o"))).groupBy(end).agg(F.min(head).alias(f"stop_{head}"))
        pairs = cut(pairs.drop("a", "b").join(shuffled(rival("p", "q", "b")), "p", "left").join(shuffled(rival("q", "p", "a")), "q", "left"))
        free = lambda t, end, head: t.join(shuffled(pairs), end).filter(F.col(f"stop_{head}").isNull() | (F.col(head) < F.col(f"stop_{head}"))).select("p", "q", "gap", (F.col("i") - F.col(f"i_{head}")).alias("i"), head)
        now = cut(free(one, "p", "a").join(shuffled(free(two, "q", "b").drop("gap")), ["p", "q", "i"]).select("a", "b", "gap"))
        if now.isEmpty():
            raise RuntimeError("greedy_matches did not settle")
        n += 1
        done = now if done is None else done.unionByName(now)
        done = cut(done) if n % 30 == 0 else done
        one = cut(one.join(shuffled(left.select("p").distinct()), "p", "left_semi").join(shuffled(now.select("a")), "a", "left_anti"))
        two = cut(two.join(shuffled(left.select("q").distinct()), "q", "left_semi").join(shuffled(now.select("b")), "b", "left_anti"))


def closest(a: DataFrame, b: DataFrame, tolerance: float, keys: Sequence[str] = (), key: str = "blob_id") -> DataFrame:
    """For each point its nearest of the other set, strictly under the tolerance; ties by id. Places are compared, each with its smallest id."""
    cols = [*keys, *AXES]
    pairs = near_pairs(a.select(*cols).distinct(), b.groupBy(*cols).agg(F.min(key).alias(key)), (tolerance,) * 3, keys).withColumn("_d", F.sqrt(squared())).filter(F.col("_d") < tolerance)
    best = pairs.groupBy(*[F.col(f"{c}_a").alias(c) for c in cols]).agg(F.min(F.struct(F.col("_d").alias("dist"), F.col(f"{key}_b").alias("b"))).alias("p"))
    return a.join(best, cols).select(F.col(key).alias("a"), "p.b", "p.dist")


def extent(*tables: DataFrame, axes: Sequence[str] = AXES) -> float:
    """Length of the diagonal of the box around all points; 0 without points."""
    both = tables[0].select(*axes)
    for t in tables[1:]:
        both = both.unionByName(t.select(*axes))
    ends = both.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in axes]).first()
    return sum((x or 0.0) ** 2 for x in ends) ** 0.5


def _start_radius(spots: DataFrame, k: int, radius: float, axes: Sequence[str], levels: int = 20) -> float:
    """``radius`` halved until points have few others in a cell of that side, about ``k`` times eight on average."""
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(radius / 2**i).alias("r")) for i in range(levels)])
    cells = spots.select(*axes, F.explode(sides).alias("_s")).groupBy("_s.i", *[F.floor(F.col(c) / F.col("_s.r")).alias(f"_c{n}") for n, c in enumerate(axes)]).agg(F.count("*").alias("_n"))
    mean = cells.groupBy("i").agg((F.sum(F.col("_n").cast("double") * F.col("_n")) / F.sum("_n")).alias("m"))
    fits = mean.filter(F.col("m") <= 8 * k).agg(F.min("i")).first()[0]  # one row
    return radius / 2 ** (levels - 1 if fits is None else fits)


def nearest(points: DataFrame, k: int, radius: float, axes: Sequence[str], key: str) -> DataFrame:
    """Distance to the k-th neighbour, itself the first; null where there are fewer points.

    Places are compared, each with its number of points; one of ``k`` points and more has distance 0. The radius starts at ``radius``,
    smaller where points are dense, and doubles for those with too few neighbours in reach, until it
    spans all points, so that a point's pairs grow with ``k`` and not with the table.
    """
    everyone = points.select(key, *axes)
    spots = cut(everyone.filter(" and ".join(f"{c} is not null" for c in axes)).groupBy(*axes).agg(F.count("*").alias("_n")))
    far, order = extent(spots, axes=axes), Window.partitionBy(*[f"{c}_a" for c in axes]).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    radius = _start_radius(spots, k, radius, axes)
    out = spots.filter(F.col("_n") >= k).select(*axes, F.lit(0.0).alias("dist"))
    todo = cut(spots.filter(F.col("_n") < k).select(*axes))
    while not todo.isEmpty():
        pairs = near_pairs(todo, spots, (radius,) * len(axes), (), axes).withColumn("d", F.sqrt(squared(axes))).filter(F.col("d") <= radius)
        reached = pairs.groupBy(*[f"{c}_a" for c in axes], "d").agg(F.sum("_n_b").alias("_n")).withColumn("_n", F.sum("_n").over(order)).filter(F.col("_n") >= k)
        have = cut(reached.groupBy(*[F.col(f"{c}_a").alias(c) for c in axes]).agg(F.min("d").alias("dist")))
        out = out.unionByName(have)
        todo = cut(todo.join(have, list(axes), "left_anti"))
        if radius > far:
            break
        radius *= 2
    return everyone.join(out, list(axes), "left").select(key, "dist")


def neighbour_distances(points: DataFrame, k: int, radius: float, axes: Sequence[str], key: str, most: float | None = None, rows: int = 1000) -> DataFrame:
    """``nearest`` in order of distance: (key, dist, rank, shown, zoomed).

    With ``most`` distances of that many medians and more are left out.
    ``shown`` marks every n-th row so that about ``rows`` remain for an overview; ``zoomed`` those over the 90th percentile.
    """
    near = cut(nearest(points, k, radius, axes, key).filter("dist is not null").withColumn("_all", F.lit(0)))
    if most is not None:
        middle = quantiles(near, ["_all"], "dist", {"_m": 0.5})
        near = cut(near.join(F.broadcast(middle), "_all").filter(F.col("dist") < most * F.col("_m")).drop("_m"))  # one row
    ends = quantiles(near, ["_all"], "dist", {"_p90": 0.9}).join(near.groupBy("_all").agg(F.count("*").alias("_size")), "_all")
    ranked = running(near.withColumn("_pos", F.struct("dist", key)).withColumn("_c", F.lit(1)), ["_all"], "_pos", "_c")
    step = F.greatest(F.floor(F.col("_size") / rows), F.lit(1))
    return ranked.join(F.broadcast(ends), "_all").select(key, "dist", F.col("before").alias("rank"), (F.col("before") % step == 0).alias("shown"), (F.col("dist") > F.col("_p90")).alias("zoomed"))


def dbscan(points: DataFrame, eps: float, least: int, axes: Sequence[str], key: str, by: Sequence[str] = ()) -> DataFrame:
    """Density clusters within each ``by``: ``eps`` inclusive, ``least`` points with itself; noise is -1.

    A cluster is named by its smallest core id; border points go to the smallest cluster they touch. Points with null places are noise.

    Places are counted once. In cells of side eps / sqrt(d) all points are near
    each other: those of cells with ``least`` points are core without any
    comparison, and a cell's cores are one node. Nodes are joined by one
    witness per eighth of a cell first; only neighbouring cells that are still
    in different components compare their cores. Other points stand in cells of fewer
    than ``least``, so what they are compared with grows with the points.
    """
    d, cols = len(axes), [*by, *axes]
    side = eps / d**0.5 * (1 - 1e-9)
    cell = [f"_g{i}" for i in range(d)]
    spots = points.filter(" and ".join(f"{c} is not null" for c in cols)).groupBy(*cols).agg(F.count("*").alias("_n"), F.min(key).alias("_id"))
    spots = cut(spots.withColumns({g: F.floor(F.col(c) / side).cast("long") for g, c in zip(cell, axes, strict=True)}))
    full = spots.groupBy(*by, *cell).agg(F.sum("_n").alias("_full")).filter(F.col("_full") >= least).select(*by, *cell)
    dense, sparse = spots.join(full, [*by, *cell], "left_semi"), cut(spots.join(full, [*by, *cell], "left_anti"))
    near = lambda a, b: near_pairs(a, b, (eps,) * d, by, axes).filter(squared(axes) <= eps * eps)
    counts = near(sparse.select(*cols, "_id"), spots.select(*cols, "_n")).groupBy(F.col("_id_a").alias("_id"), *[F.col(f"{c}_a").alias(c) for c in cols]).agg(F.sum("_n_b").alias("_near"))
    few = counts.filter(F.col("_near") >= least).select(*cols)
    cores = cut(dense.select(*cols, "_id", *cell).unionByName(sparse.join(few, cols, "left_semi").select(*cols, "_id", *cell)))
    nodes = cut(cores.groupBy(*by, *cell).agg(F.min("_id").alias("node")))
    of_cell = cores.join(nodes, [*by, *cell])
    part = [F.floor(F.col(c) / (side / 2)).alias(f"_h{i}") for i, c in enumerate(axes)]
    witness = of_cell.groupBy(*by, "node", *part).agg(F.min(F.struct(*axes)).alias("_w")).select(*by, "node", *[F.col(f"_w.{c}").alias(c) for c in axes])
    pairs = lambda t: t.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    links = cut(pairs(near(witness, witness).filter("node_a < node_b")).distinct())
    joined = cut(nodes.join(components(links).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    steps = F.array(*[F.struct(*[F.lit(x).alias(g) for g, x in zip(cell, o, strict=True)]) for o in _offsets(d, int(d**0.5) + 1)])
    beside = joined.select(*by, F.explode(steps).alias("_o"), *cell, F.col("node").alias("node_a"), F.col("component").alias("_one")).select(*by, *[(F.col(g) + F.col(f"_o.{g}")).alias(g) for g in cell], "node_a", "_one")
    apart = cut(shuffled(beside).join(joined.select(*by, *cell, F.col("node").alias("node_b"), F.col("component").alias("_two")), [*by, *cell]).filter("_one < _two").select("node_a", "node_b"))
    ends = of_cell.select("node", *axes)
    side_of = lambda e: ends.select(F.col("node").alias(f"node_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in axes])
    more = cut(pairs(apart.join(side_of("a"), "node_a").join(side_of("b"), "node_b").filter(squared(axes) <= eps * eps)).distinct())
    if more.isEmpty():
        cluster = joined.select(*by, *cell, F.col("component").alias("cluster"))
    else:
        named = components(links.unionByName(more))
        cluster = cut(nodes.join(named.withColumnRenamed("id", "node"), "node", "left").select(*by, *cell, F.coalesce("component", "node").alias("cluster")))
    inner = cores.join(cluster, [*by, *cell]).select(*cols, "cluster")
    others = sparse.join(few, cols, "left_anti").select(*cols)
    border = near(others, inner).groupBy(*[F.col(f"{c}_a").alias(c) for c in cols]).agg(F.min("cluster_b").alias("cluster"))
    return points.select(key, *cols).join(inner.unionByName(border), cols, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _offsets(d: int, reach: int) -> list[tuple[int, ...]]:
    return [o for o in product(range(-reach, reach + 1), repeat=d) if any(o)]


def clusters_by_label(points: DataFrame, label: str, scale: Sequence[float], eps: float, least: int, key: str = "blob_id") -> DataFrame:
    """Clusters of each label's points, whose places are scaled and cut to whole numbers: label, clusters, noise, size of the largest."""
    whole = points.select(key, label, *[(F.col(c) * f).cast("int").cast("double").alias(c) for c, f in zip(AXES, scale, strict=True)])
    named = dbscan(whole, eps, least, AXES, key, (label,)).join(points.select(key, label), key)
    n = named.groupBy(label, "cluster").agg(F.count("*").alias("n"))
    real = F.col("cluster") != -1
    return n.groupBy(label).agg(F.count(F.when(real, 1)).alias("n_clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"), F.max(F.when(real, F.col("n"))).alias("largest"))


def cluster_metrics(clusters: DataFrame) -> DataFrame:
    """Clusters, noise points and the largest cluster's size (null if none)."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    real = F.col("cluster") != -1
    return n.agg(F.count(F.when(real, 1)).alias("n_clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"), F.max(F.when(real, F.col("n"))).alias("largest"))


def latest_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert: the new row of each key replaces the old one; a grouped maximum. Of several new rows of a key the greatest stays."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    return both.groupBy(*key).agg(F.max(F.struct("_s", *rest)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in old.columns])
