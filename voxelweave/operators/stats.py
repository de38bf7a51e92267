"""Statistics per region, from grouped sums; distribution functions run on the small results."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.tables import cut, fresh, partitions
from .ranks import average_ranks, quantiles, running


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (modified Lentz), all rows at once."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 / np.where(np.abs(t := 1 - (a + b) * x / (a + 1)) < tiny, tiny, t)
    out = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(t := 1 + top * d) < tiny, tiny, t)
            c = np.where(np.abs(t := 1 + top / c) < tiny, tiny, t)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    part = np.where(x > 0, front * out, 0.0)
    return np.where(swap, 1 - part, part)


def _column(ok: pd.Series, f) -> pd.Series:
    out = pd.Series(np.nan, index=ok.index)
    if ok.any():
        out[ok] = f(ok)
    return out.where(out.notna(), None)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; runs on the rows of a result, one a region."""
    ok = t.notna() & df.notna() & (df > 0)
    return _column(ok, lambda o: _betainc((df[o] / 2).to_numpy(), np.full(o.sum(), 0.5), (df[o] / (df[o] + t[o] ** 2)).to_numpy()))


def t_quantiles(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Quantiles of Student's t for upper shares ``p`` >= 0.5: the inverse of the incomplete beta function by bisection, all rows at once."""
    tail = 2 * (1 - p)  # of both sides
    low, high = np.zeros(len(p)), np.ones(len(p))  # of x = df / (df + t^2)
    for _ in range(200):
        x = (low + high) / 2
        under = _betainc(df / 2, np.full(len(p), 0.5), x) < tail
        low, high = np.where(under, x, low), np.where(under, high, x)
    x = (low + high) / 2
    return np.sqrt(df * (1 - x) / x)


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """The t that a share ``p`` (over 0.5) of the distribution is below; null without degrees of freedom."""
    ok = p.notna() & df.notna() & (df > 0) & (p >= 0.5) & (p < 1)
    return _column(ok, lambda o: t_quantiles(p[o].to_numpy(float), df[o].to_numpy(float)))


def noncentral_t(t: float, df: float, shift: float) -> float:
    """The share of a noncentral t distribution below ``t``, as a Poisson mixture of incomplete beta functions."""
    if t < 0:
        return 1 - noncentral_t(-t, df, -shift)
    x, half = t * t / (df + t * t), shift * shift / 2
    out = math.erfc(shift / math.sqrt(2)) / 2
    if x > 0:
        j = np.arange(int(half + 12 * math.sqrt(half + 1) + 60), dtype=float)
        log = -half + j * (math.log(half) if half > 0 else -np.inf) if half > 0 else np.where(j == 0, 0.0, -np.inf)
        p = np.exp(log - _lgamma(j + 1))
        q = np.exp(log - _lgamma(j + 1.5)) * shift / math.sqrt(2)
        b = np.full(len(j), df / 2)
        out += 0.5 * float((p * _betainc(j + 0.5, b, np.full(len(j), x)) + q * _betainc(j + 1, b, np.full(len(j), x))).sum())
    return min(max(out, 0.0), 1.0)


def noncentrality(t: float, df: float, share: float) -> float:
    """The shift for which ``share`` of the noncentral t distribution is below ``t``; it falls as the shift grows."""
    low, high = t - 10 - abs(t), t + 10 + abs(t)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if noncentral_t(t, df, middle) > share else (low, middle)
    return (low + high) / 2


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def cohen_interval(d: pd.Series, scale: pd.Series, df: pd.Series) -> pd.DataFrame:
    """95 % interval of a standardized difference ``d`` whose t is d * scale; runs on the rows of a result, one a region."""
    out = []
    for x, k, n in zip(d, scale, df, strict=True):
        if pd.isna(x) or pd.isna(k) or pd.isna(n) or n <= 0 or not np.isfinite(x * k):
            out.append((None, None))
        else:
            out.append((noncentrality(x * k, n, 0.975) / k, noncentrality(x * k, n, 0.025) / k))
    return pd.DataFrame(out, columns=["low", "high"], dtype=float)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return _column(z.notna(), lambda o: [math.erfc(abs(v) / math.sqrt(2)) for v in z[o]])


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    ok = p.notna() & (p > 0) & (p < 1)
    return _column(ok, lambda o: [statistics.NormalDist().inv_cdf(v) for v in p[o]])


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi square, by the series of the lower incomplete gamma function or the continued fraction of the upper."""

    def tail(x: float, k: float) -> float:
        a, x = k / 2, x / 2
        if x <= 0:
            return 1.0
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            for n in range(1, 2000):
                term *= x / (a + n)
                total += term
                if term < total * 1e-16:
                    break
            return 1 - front * total
        b, c = x + 1 - a, 1e300
        d = h = 1 / b
        for n in range(1, 2000):
            b += 2
            d = 1 / (b - n * (n - a) * d)
            c = b - n * (n - a) / c
            h *= c * d
            if abs(c * d - 1) < 1e-16:
                break
        return front * h

    ok = x.notna() & df.notna() & (df > 0)
    return _column(ok, lambda o: [tail(a, b) for a, b in zip(x[o], df[o], strict=True)])


def welch(df: DataFrame, region: str, condition: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """Welch's t of the second condition against the first, per region: n, means, effect, Cohen's d and its interval, t, degrees of freedom, p."""
    agg = df.filter(F.col(condition).isin(*pair) & F.col(value).isNotNull()).groupBy(region)
    cols = []
    for i, c in enumerate(pair, 1):
        v = F.when(F.col(condition) == c, F.col(value))
        cols += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"var{i}")]
    s = agg.agg(*cols)
    a, b = F.try_divide("var1", "n1"), F.try_divide("var2", "n2")
    effect = F.col("mean2") - F.col("mean1")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("n1") + F.col("n2") - 2))
    s = s.withColumns({"effect": effect, "cohen_d": F.try_divide(effect, pooled), "t": F.try_divide(effect, F.sqrt(a + b)), "df": F.try_divide((a + b) ** 2, F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))})
    s = s.withColumn("p", t_p_value("t", "df"))
    between = F.sqrt(F.try_divide(F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")))
    interval = cohen_interval("cohen_d", between, (F.col("n1") + F.col("n2") - 2).cast("double"))
    return s.withColumns({"cohen_low": interval["low"], "cohen_high": interval["high"]})


def mean_difference(df: DataFrame, region: str, condition: str, value: str, pair: tuple[str, str]) -> DataFrame:
    m = [F.avg(F.when(F.col(condition) == c, F.col(value))) for c in pair]
    return df.groupBy(region).agg((m[1] - m[0]).alias("effect"))


def regression(df: DataFrame, region: str, x: str, y: str) -> DataFrame:
    """Least squares of y on x per region, from sums: slope, intercept, r squared, the slope's standard error and p."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy(region).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    slope = F.try_divide("cxy", "vx")
    rest = F.greatest(F.col("vy") - slope * F.col("cxy"), F.lit(0.0))
    return s.select(region, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("cxy") ** 2, F.col("vx") * F.col("vy")).alias("r2"), F.sqrt(F.try_divide(rest, F.col("vx") * (F.col("n") - 2))).alias("slope_se")).withColumn("p", t_p_value(F.try_divide("slope", "slope_se"), (F.col("n") - 2).cast("double")))


def rank_sum(df: DataFrame, region: str, condition: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """Wilcoxon rank sum of two conditions per region: U of the first, tie-corrected z, z / sqrt(n) and p."""
    r = average_ranks(df.filter(F.col(condition).isin(*pair) & F.col(value).isNotNull()), [region], value)
    one = F.col(condition) == pair[0]
    s = r.groupBy(region).agg(F.count(F.when(one, 1)).cast("double").alias("n1"), F.count(F.when(~one, 1)).cast("double").alias("n2"), F.sum(F.when(one, F.col("rank"))).alias("r1"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("t"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("t"), n * (n - 1))))
    z = F.try_divide(u - F.col("n1") * F.col("n2") / 2, sd)
    return s.select(region, u.alias("u"), z.alias("z"), F.try_divide(z, F.sqrt(n)).alias("effect")).withColumn("p", normal_p_value("z"))


def corrected(df: DataFrame, p: str, method: str = "bonferroni", n: str | None = None) -> DataFrame:
    """Adds ``p_corr``; null p stay null and do not count. ``bh``: the least of p * n / rank over this and all greater p.

    With the column ``n`` of a test's size, rows of one value or fewer do not count either and stay null.
    """
    if n is not None:
        fine = F.col(n) > 1
        done = corrected(df.withColumn("_p", F.when(fine, F.col(p))), "_p", method)
        return done.drop("_p")
    n = df.filter(F.col(p).isNotNull()).agg(F.count("*").alias("_n"))
    d = df.crossJoin(F.broadcast(n))  # one row
    at = fresh("_at", df.columns)
    if method == "bonferroni":
        return d.withColumn("p_corr", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("_n"), F.lit(1.0)))).drop("_n")
    # ranks of the distinct p from sorted counts; the minimum over greater p by ranges of p
    counts = d.filter(F.col(p).isNotNull()).groupBy(p, "_n").agg(F.count("*").alias("_c"))
    ranked = running(counts.withColumn("_all", F.lit(0)), ["_all"], p, "_c").withColumn("_v", F.col(p) * F.col("_n") / (F.col("before") + F.col("_c")))
    parts = cut(ranked.repartitionByRange(partitions(df.sparkSession), F.col(p)).withColumn("_block", F.spark_partition_id()))
    onward = Window.partitionBy("_block").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    low = parts.groupBy("_block").agg(F.min("_v").alias("_low"))
    later = low.alias("x").join(low.alias("y"), F.col("y._block") > F.col("x._block"), "left").groupBy("x._block").agg(F.min("y._low").alias("_later"))  # a row per partition
    least = parts.withColumn("_here", F.min("_v").over(onward)).join(F.broadcast(later), "_block").select(F.col(p).alias(at), F.least("_here", F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias("p_corr"))
    return d.join(least, F.col(p) == F.col(at), "left").drop("_n", at)


def spearman(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns within each group."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, a, b)
    d = average_ranks(d, [group], a).withColumnRenamed("rank", "_ra").drop("ties")
    d = average_ranks(d, [group], b).withColumnRenamed("rank", "_rb")
    return d.groupBy(group).agg(F.corr("_ra", "_rb").alias("rho"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho, n, p) of each pair of columns over the rows that have both; p by t on n - 2 degrees."""
    d = df.withColumn("_all", F.lit(0))
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = d.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
            one = spearman(both, "_all", a, b).crossJoin(F.broadcast(both.agg(F.count("*").alias("n"))))  # one row each
            one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho", "n")
            out = one if out is None else out.unionByName(one)
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") ** 2))
    return out.withColumn("p", t_p_value(t, (F.col("n") - 2).cast("double")))


def paired_values(df: DataFrame, ids: list[str], condition: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """``ids`` with the values ``v1`` and ``v2`` of two conditions; pairs with a null or missing value are left out, of several values the least counts."""
    v = [F.min(F.when(F.col(condition) == c, F.col(value))).alias(f"v{i}") for i, c in enumerate(pair, 1)]
    return df.groupBy(*ids).agg(*v).filter("v1 is not null and v2 is not null")


def one_sample_t(df: DataFrame, region: str, value: str | Column, mu: float = 0.0) -> DataFrame:
    """t of the mean against ``mu`` per region: n, mean, effect, Cohen's d and its interval, t, df, p."""
    s = df.groupBy(region).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    effect = F.col("mean") - mu
    s = s.select(region, "n", "mean", effect.alias("effect"), F.try_divide(effect, F.col("sd")).alias("cohen_d"), F.try_divide(effect, F.col("sd") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    interval = cohen_interval("cohen_d", F.sqrt("n"), "df")
    return s.withColumn("p", t_p_value("t", "df")).withColumns({"cohen_low": interval["low"], "cohen_high": interval["high"]})


def paired_t(df: DataFrame, region: str, sample: str, condition: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """t of the differences second less first of the samples that have both."""
    d = paired_values(df, [region, sample], condition, value, pair).withColumn("_d", F.col("v2") - F.col("v1"))
    return one_sample_t(d, region, "_d")


def signed_rank(df: DataFrame, region: str, sample: str, condition: str, value: str, pair: tuple[str, str], digits: int | None = None) -> DataFrame:
    """Wilcoxon signed rank per region: W of the positive differences, tie-corrected z, z / sqrt(n), p; zero differences are left out.

    ``digits``: differences are rounded to so many decimals, for values that are sums, whose last bits hang on the order of rows and would break ties by chance.
    """
    less = F.col("v2") - F.col("v1")
    d = paired_values(df, [region, sample], condition, value, pair).withColumn("_d", less if digits is None else F.round(less, digits)).filter("_d <> 0")
    r = average_ranks(d.withColumn("_a", F.abs("_d")), [region], "_a")
    s = r.groupBy(region).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("_t"))
    n = F.col("n")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48))
    return s.select(region, "n", "w", z.alias("z"), F.try_divide(z, F.sqrt(n)).alias("effect")).withColumn("p", normal_p_value("z"))


def fligner(df: DataFrame, region: str, condition: str, value: str) -> DataFrame:
    """Fligner-Killeen test of equal variances per region: chi square, df, p.

    Distances from the condition's median are ranked within the region and scored by normal quantiles.
    """
    d = df.filter(F.col(value).isNotNull()).select(region, condition, F.col(value).cast("double").alias(value))
    d = d.join(quantiles(d, [region, condition], value, {"_m": 0.5}), [region, condition]).withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    r = average_ranks(d.select(region, condition, "_a"), [region], "_a")
    size = d.groupBy(region).agg(F.count("*").alias("_n"))
    r = r.join(size, region).withColumn("_q", normal_quantile((1 + F.col("rank") / (F.col("_n") + 1)) / 2))
    each = r.groupBy(region, condition).agg(F.count("*").alias("c"), F.sum("_q").alias("s"), F.sum(F.col("_q") ** 2).alias("ss"))
    s = each.groupBy(region).agg(F.sum("c").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") ** 2 / F.col("c")).alias("between"), (F.count("*") - 1).cast("double").alias("df"))
    spread = (F.col("ss") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)
    return s.select(region, F.try_divide(F.col("between") - F.col("s") ** 2 / F.col("n"), spread).alias("chi2"), "df").withColumn("p", chi2_p_value("chi2", "df"))


def logistic(df: DataFrame, region: str, condition: str, value: str, pair: tuple[str, str], rounds: int = 40) -> DataFrame:
    """Logistic regression of the second condition on the standardized value, per region: intercept, slope, its standard error, z, p.

    Newton steps; each is one grouped sum over all rows, so a region is never gathered. The coefficients are
    joined back, a row a region. Stops when no coefficient moves; separable regions end with null after ``rounds``.
    """
    d = df.filter(F.col(condition).isin(*pair) & F.col(value).isNotNull()).select(F.col(region).alias("r"), (F.col(condition) == pair[1]).cast("double").alias("y"), F.col(value).cast("double").alias("v"))
    moments = d.groupBy("r").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    d = cut(d.join(moments.filter("s > 0 and y0 < y1"), "r").select("r", "y", ((F.col("v") - F.col("m")) / F.col("s")).alias("x")))
    beta = moments.select("r", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, g = p * (1 - p), F.col("y") - p
        sums = d.join(beta, "r").groupBy("r", "a", "b").agg(F.sum(w).alias("w0"), F.sum(w * F.col("x")).alias("w1"), F.sum(w * F.col("x") ** 2).alias("w2"), F.sum(g).alias("g0"), F.sum(g * F.col("x")).alias("g1"))
        det = F.col("w0") * F.col("w2") - F.col("w1") ** 2
        da, db = F.try_divide(F.col("w2") * F.col("g0") - F.col("w1") * F.col("g1"), det), F.try_divide(F.col("w0") * F.col("g1") - F.col("w1") * F.col("g0"), det)
        step = cut(sums.select("r", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), F.sqrt(F.try_divide("w0", det)).alias("se"), F.greatest(F.abs(da), F.abs(db)).alias("move")))
        beta = step.select("r", "a", "b")
        if (step.agg(F.max("move")).first()[0] or 0.0) < 1e-10:
            break
    sure = F.col("move") < 1e-6
    out = step.select(F.col("r").alias(region), *[F.when(sure, F.col(c)).alias(n) for c, n in (("a", "intercept"), ("b", "slope"), ("se", "slope_se"))])
    return out.withColumn("z", F.try_divide("slope", "slope_se")).withColumn("p", normal_p_value("z"))


def wide_stats(stats: DataFrame, region: str, effect: str, p: str, low: Column, high: Column, n: str = "n") -> DataFrame:
    """Regions with a p value: n, effect, interval, p, corrected p (of tests of two values and more) and -log10 of it."""
    d = corrected(stats.filter(F.col(p).isNotNull()).withColumns({"_low": low, "_high": high}), p, n=n)
    return d.select(region, F.col(n).alias("vals_n"), F.col(effect).alias("vals_effect"), F.col("_low").alias("vals_ci_low"), F.col("_high").alias("vals_ci_hi"), F.col(p).alias("vals_p"), F.col("p_corr").alias("vals_pcorr"), (-F.log10("p_corr")).alias("vals_logp"))
