"""Linear and logistic models with a second factor, per region, from Gram matrices that Spark sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .stats import normal_p_value, t_p_value
from .tables import melt


def _design(g: list, s: list) -> tuple[list[str], Callable[[object, object], list[float]]]:
    """Names of the terms, and a row of the design for two levels: treatment contrasts against the first of each factor.

    A factor of one level is dropped, and with it the interaction.
    """
    parts: list[tuple[str, Callable[[object, object], float]]] = [("intercept", lambda a, b: 1.0)]
    if len(g) > 1 or len(s) < 2:
        parts += [(f"group:{x}", lambda a, b, x=x: float(a == x)) for x in g[1:]]
    parts += [(f"side:{y}", lambda a, b, y=y: float(b == y)) for y in s[1:]]
    if len(g) > 1 and len(s) > 1:
        parts += [(f"group:{x}*side:{y}", lambda a, b, x=x, y=y: float(a == x and b == y)) for y in s[1:] for x in g[1:]]
    return [n for n, _ in parts], lambda a, b: [f(a, b) for _, f in parts]


def _independent(gram: np.ndarray) -> list[int]:
    """Columns that don't depend on earlier ones, by a pivot-free Cholesky decomposition."""
    kept: list[int] = []
    for j in range(len(gram)):
        rest = gram[j, j]
        if kept:
            own = gram[np.ix_(kept, kept)]
            rest -= gram[j, kept] @ np.linalg.solve(own, gram[kept, j])
        if rest > 1e-10 * max(gram[j, j], 1e-300):
            kept.append(j)
    return kept


def linear_model(df: DataFrame, region: str, value: str, group: str, side: str | None = None, intercept: bool = True) -> DataFrame:
    """Least squares of the value on ``group``, ``side`` and their interaction per region, a row for each term.

    (region, position, term, n, estimate, se, t, df, p, r_squared, intercept).
    Factors use treatment contrasts in the order of their levels; one with a
    single level in the region is dropped (without the group, the model is of
    sides alone). Terms that depend on earlier ones are left out. With an
    intercept its row is left out, so position 1 is the first other term.
    Without one, the first factor has a term for each level. Null values and
    levels are left out; a region without them has no rows, and one that leaves no degree of freedom null errors.

    Spark sums number, mean and square sum of each pair of levels; these hold
    the Gram matrix, so a region's rows are never together. The k x k systems are solved
    region by region.
    """
    two = F.col(side).cast("string") if side else F.lit("")
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull() & two.isNotNull()).select(F.col(region), F.col(group).cast("string").alias("_g"), two.alias("_s"), F.col(value).cast("double").alias("_v"))
    cells = d.groupBy(region, "_g", "_s").agg(F.count("*").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v"))
    rows = cells.groupBy(region).agg(F.array_sort(F.collect_list(F.struct(F.col("_g").alias("g"), F.col("_s").alias("s"), "n", "m", "v"))).alias("cells"))  # a few levels each

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, found in zip(frame[region], frame["cells"], strict=True):
                g, s = sorted({c["g"] for c in found}), sorted({c["s"] for c in found})
                names, row = _design(g, s)
                x = np.array([row(c["g"], c["s"]) for c in found])
                n, mean, var = (np.array([c[k] for c in found], float) for k in ("n", "m", "v"))
                if not intercept:  # each level of the first factor has its own term
                    first = ("group", g, "g") if len(g) > 1 or len(s) < 2 else ("side", s, "s")
                    x[:, 0] = [float(c[first[2]] == first[1][0]) for c in found]
                    names[0] = f"{first[0]}:{first[1][0]}"
                gram = x.T @ (n[:, None] * x)
                kept = _independent(gram)
                inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
                beta = inverse @ (x[:, kept].T @ (n * mean))
                total, free = int(n.sum()), int(n.sum()) - len(kept)
                rest = float((n * var).sum() + (n * (mean - x[:, kept] @ beta) ** 2).sum())
                around = (n * mean).sum() / n.sum() if intercept else 0.0
                whole = float((n * var).sum() + (n * (mean - around) ** 2).sum())
                r2 = 1 - rest / whole if whole > 0 else None
                for at, (j, b) in enumerate(zip(kept, beta.tolist(), strict=True)):
                    if intercept and j == 0:
                        continue
                    se = float(np.sqrt(rest / free * inverse[at, at])) if free > 0 else None
                    out.append((key, at if intercept else at + 1, names[j], total, b, se, b / se if se else None, float(free), r2, float(beta[0]) if intercept else 0.0))
            yield pd.DataFrame(out, columns=[region, "position", "term", "n", "estimate", "se", "t", "df", "r_squared", "intercept"])

    kind = df.schema[region].dataType.simpleString()
    solved = rows.mapInPandas(solve, f"{region} {kind}, position int, term string, n long, estimate double, se double, t double, df double, r_squared double, intercept double")
    return solved.withColumn("p", t_p_value("t", "df"))


def logistic_model(df: DataFrame, region: str, group: str, value: str, pair: tuple[object, object], side: str | None = None, rounds: int = 40) -> DataFrame:
    """Logistic regression of the second of two groups on value, side and their product per region: (region, position, term, n, estimate, se, z, p).

    Sides are two at most, in their order; a region with one side has the
    value's term alone. Newton steps on the standardized value, each one
    grouped sum of a 4 x 4 Gram matrix and gradient over all rows; terms are given for the value as it is. A
    region without both groups or without spread, or whose groups the model tells apart fully, has null estimates.
    """
    two = F.col(side).cast("string") if side else F.lit("")
    d = df.filter(F.col(group).isin(*pair) & F.col(value).isNotNull() & two.isNotNull()).select(F.col(region).alias("r"), (F.col(group) == F.lit(pair[1])).cast("double").alias("y"), F.col(value).cast("double").alias("v"), two.alias("s"))
    moments = cut(d.groupBy("r").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")))
    fine = moments.filter("sd > 0 and y0 < y1")
    d = cut(d.join(fine, "r").select("r", "y", ((F.col("v") - F.col("m")) / F.col("sd")).alias("v"), ((F.col("s") != F.col("s0")).cast("double")).alias("s"), (F.col("s0") != F.col("s1")).alias("both")))
    beta = fine.select("r", *[F.lit(0.0).alias(f"b{i}") for i in range(4)])
    x = [F.lit(1.0), F.col("v"), F.col("s"), F.col("v") * F.col("s")]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                gram, k = np.zeros((4, 4)), 4 if r.both else 2
                for i, j in upper:
                    gram[i, j] = gram[j, i] = getattr(r, f"h{i}{j}")
                slope, old = np.array([getattr(r, f"g{i}") for i in range(4)]), np.array([getattr(r, f"b{i}") for i in range(4)])
                se, move = np.full(4, np.nan), np.zeros(4)
                try:
                    inverse = np.linalg.inv(gram[:k, :k])
                    move[:k], se[:k] = inverse @ slope[:k], np.sqrt(np.diag(inverse))
                except np.linalg.LinAlgError:
                    move[:k] = np.nan
                far = float(np.abs(move).max())
                new = old + move * min(1.0, 5.0 / far) if far > 0 else old
                out.append((r.r, *new.tolist(), *se.tolist(), float(inverse[2, 3]) if k == 4 and not np.isnan(far) else 0.0, far, bool(r.both)))
            yield pd.DataFrame(out, columns=["r", *[f"b{i}" for i in range(4)], *[f"e{i}" for i in range(4)], "e23", "move", "both"])

    kind = moments.schema["r"].dataType.simpleString()
    schema = f"r {kind}, " + ", ".join(f"{c}{i} double" for c in "be" for i in range(4)) + ", e23 double, move double, both boolean"
    done = None
    for _ in range(rounds):
        score = sum(F.col(f"b{i}") * x[i] for i in range(4))
        p = 1 / (1 + F.exp(-score))
        w = p * (1 - p)
        sums = d.join(beta, "r").groupBy("r", *[f"b{i}" for i in range(4)]).agg(F.max("both").alias("both"), *[F.sum(w * x[i] * x[j]).alias(f"h{i}{j}") for i, j in upper], *[F.sum((F.col("y") - p) * x[i]).alias(f"g{i}") for i in range(4)])
        done = cut(sums.mapInPandas(step, schema))
        beta = done.select("r", *[f"b{i}" for i in range(4)])
        if (done.agg(F.max(F.when(~F.isnan("move"), F.col("move")))).first()[0] or 0.0) < 1e-10:
            break
    sure, shift = F.col("move") < 1e-6, F.col("m") / F.col("sd")
    terms = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("value").alias("term"), (F.col("b1") / F.col("sd")).alias("b"), (F.col("e1") / F.col("sd")).alias("e")),
        F.struct(F.lit(2).alias("position"), F.concat(F.lit("side:"), "s1").alias("term"), (F.col("b2") - F.col("b3") * shift).alias("b"), F.sqrt(F.greatest(F.col("e2") ** 2 + shift**2 * F.col("e3") ** 2 - 2 * shift * F.col("e23"), F.lit(0.0))).alias("e")),
        F.struct(F.lit(3).alias("position"), F.concat(F.lit("value*side:"), "s1").alias("term"), (F.col("b3") / F.col("sd")).alias("b"), (F.col("e3") / F.col("sd")).alias("e")),
    )
    out = moments.join(done, "r", "left").withColumn("_t", F.explode(F.when(F.col("s0") != F.col("s1"), terms).otherwise(F.slice(terms, 1, 1))))
    keep = lambda c: F.when(sure & ~F.isnan(c), c)
    out = out.select(F.col("r").alias(region), "_t.position", "_t.term", "n", keep(F.col("_t.b")).alias("estimate"), keep(F.col("_t.e")).alias("se"))
    return out.withColumn("z", F.try_divide("estimate", "se")).withColumn("p", normal_p_value("z"))


def by_measure(df: DataFrame, region: str, ids: Sequence[str], measures: Sequence[str], model: Callable[[DataFrame, str, str], DataFrame], ignore: Sequence[object] = (), where: Column | None = None) -> DataFrame:
    """``model(rows, key, value column)`` for every region and measure at once: its columns after (region, measure).

    Regions of ``ignore`` and rows outside of ``where`` are left out; NaN counts as null.
    """
    rows = df if where is None else df.filter(where)
    rows = rows.filter(~F.col(region).isin(*ignore)) if ignore else rows
    long = melt(rows, [region, *ids], list(measures)).withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))
    found = model(long.withColumn("_key", F.struct(F.col(region).alias("region"), F.col("metric").alias("metric")).cast("struct<region:string,metric:string>")).withColumn("_key", F.to_json("_key")), "_key", "value")
    key = F.from_json("_key", "region string, metric string")
    return found.select(key["region"].cast(df.schema[region].dataType).alias(region), key["metric"].alias("measure"), *[c for c in found.columns if c != "_key"])
