"""Metric tables: joins, normalizing, reshaping, scores and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles
from .stats import t_quantile


def join_on(dfs: Sequence[DataFrame], key: str, how: str = "left", first_only: bool = False) -> DataFrame:
    """Chain of joins; a column that the left has already gets the suffix ``_i``; ``first_only`` keeps the least row of each key, as tables have no order."""
    out = dfs[0]
    for i, df in enumerate(dfs[1:], 1):
        if first_only:
            rest = [c for c in df.columns if c != key]
            df = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
        out = out.join(df.select(key, *[F.col(c).alias(f"{c}_{i}" if c in out.columns else c) for c in df.columns if c != key]), key, how)
    return out


def normalize_to_base(df: DataFrame, ids: list[str], condition: str, base: str, metrics: list[str], fn: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """Each condition's metrics against the row of the base condition with the same ids; null where there is none."""
    ref = df.filter(F.col(condition) == base).select(*ids, *[F.col(m).alias(f"_base_{m}") for m in metrics])
    return df.join(ref, ids, "left").select(*ids, condition, *[fn(F.col(m), F.col(f"_base_{m}")).alias(m) for m in metrics])


def z_scores_grouped(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """(x - mean) / population deviation within the group, nulls left out of both; from grouped moments joined back, so no group passes through one task."""
    moments = df.groupBy(*group).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_s_{m}") for m in metrics])
    out = df.join(moments, group)
    return out.select(*df.columns, *[F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_s_{m}")).alias(f"{m}_z") for m in metrics])


def variation(df: DataFrame, ids: list[str], metrics: list[str], size: str) -> DataFrame:
    """Population deviation over mean of each metric, and the mean size."""
    return df.groupBy(*ids).agg(*[F.try_divide(F.stddev_pop(m), F.avg(m)).alias(f"{m}_cv") for m in metrics], F.avg(size).alias(f"{size}_mean"))


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "metric") -> DataFrame:
    return df.unpivot(ids, values, name, "value")


def conditions_to_columns(df: DataFrame, ids: list[str], condition: str, metric: str, conditions: list[str]) -> DataFrame:
    """A column ``metric_condition`` for each condition; the first value by size where a key repeats."""
    return df.groupBy(*ids).pivot(condition, conditions).agg(F.min(metric)).select(*ids, *[F.col(f"`{c}`").alias(f"{metric}_{c}") for c in conditions])


def experiments_by_region(df: DataFrame, key: str, keys: list[str], region: str = "region", volume: str = "volume", nuclei: str = "nuclei") -> DataFrame:
    """Sums per region and experiment as columns, zeros as null, and the densities."""
    aggs = [F.sum(volume).alias("volume"), F.sum(nuclei).alias("nuclei")]
    wide = df.groupBy(region).pivot(key, keys).agg(*aggs)
    cols = []
    for k in keys:
        v, n = F.nullif(F.col(f"`{k}_volume`"), F.lit(0.0)), F.nullif(F.col(f"`{k}_nuclei`"), F.lit(0.0))
        cols += [v.alias(f"volume_{k}"), n.alias(f"nuclei_{k}"), F.try_divide(n, v).alias(f"density_{k}")]
    return wide.select(region, *cols)


def weighted_stats(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation; weights of null values are left out."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    mean = F.try_divide(F.sum(F.col(value) * w), F.sum(w))
    square = F.try_divide(F.sum(F.col(value) * F.col(value) * w), F.sum(w))
    return df.groupBy(*group).agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def improvement(df: DataFrame, effect: str, p: str, weight: str, threshold: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Counts, sums and weighted sums of improved, worsened and significant rows."""
    e, better, worse, sure = F.col(effect), F.col(effect) > threshold, F.col(effect) < threshold, F.col(p) < alpha
    out = [F.count("*").alias("n")]
    for name, on in (("improved", better), ("worsened", worse), ("improved_sig", better & sure), ("worsened_sig", worse & sure)):
        out += [F.count(F.when(on, 1)).alias(f"n_{name}"), F.sum(F.when(on, e)).alias(f"sum_{name}"), F.sum(F.when(on, e * F.col(weight))).alias(f"weighted_{name}")]
    return df.agg(*out)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; a flat column has one bin."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").count().withColumnRenamed("count", "n")


def mean_of(columns: list[str]) -> Column:
    """Mean of the columns that are not null."""
    have = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have))


def ratio_of(columns: list[str]) -> Column:
    """The first column over the second."""
    return F.try_divide(F.col(columns[0]), F.col(columns[1]))


def combine_columns(df: DataFrame, name: str, columns: list[str], fn: Callable[[list[str]], Column] = mean_of) -> DataFrame:
    """``fn`` of the columns, row by row: their mean unless told otherwise."""
    return df.withColumn(name, fn(columns))


def combined_by(df: DataFrame, combos: dict[str, tuple[list[str], Callable[[list[str]], Column]]]) -> DataFrame:
    """A column for each named combination of columns; those with a column that ``df`` lacks are left out."""
    return df.withColumns({name: fn(cols) for name, (cols, fn) in combos.items() if set(cols) <= set(df.columns)})


def paired(df: DataFrame, a: str, b: str, fn: Callable[[Column, Column], Column], name: str) -> DataFrame:
    return df.withColumn(name, fn(F.col(a), F.col(b)))


def replace_values(df: DataFrame, old, new, columns: list[str]) -> DataFrame:
    """``old`` (None: null) becomes ``new`` in the given columns; all columns stay."""
    return df.withColumns({c: F.when(F.col(c).isNull() if old is None else F.col(c) == old, new).otherwise(F.col(c)) for c in columns})


def filter_and_concat(dfs: Sequence[DataFrame], columns: list[str], keep: Sequence[tuple[str, object]]) -> DataFrame:
    out = None
    for df, (c, v) in zip(dfs, keep, strict=True):
        part = df.filter(F.col(c) == v).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def log_modulus(c: Column, shift: float = 1.0) -> Column:
    return F.signum(c) * F.log10(F.abs(c) + shift)


def rescale(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The column mapped from its extremes to ``low`` .. ``high``."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(column, F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (high - low) + low).drop("_lo", "_hi")


def weighted_bars(df: DataFrame, value: str, weight: str, error: str | None = None, absolute: bool = False) -> DataFrame:
    """``bar``: the value times the weight over the largest weight; ``bar_error`` likewise.

    An ``absolute`` error is the place of the bar's end and not its length, so its distance from the value is scaled.
    """
    top = df.agg(F.max(weight).alias("_top"))
    share = F.col(weight) / F.col("_top")
    out = df.join(F.broadcast(top)).withColumn("bar", F.col(value) * share)
    if error is not None:
        out = out.withColumn("bar_error", (F.abs(F.col(value) - F.col(error)) if absolute else F.col(error)) * share)
    return out.drop("_top")


def shortened(c: Column, digits: int = 5) -> Column:
    """A float as a key of groups: 1.2999998 and 1.3000001 are one."""
    return F.round(c.cast("double"), digits)


def with_effects(df: DataFrame, others: DataFrame, key: str, effect: str) -> DataFrame:
    """Rows whose key ``others`` has, with the sign of the effect there: 1, -1 or 0 (null if it is null)."""
    signs = others.groupBy(key).agg(F.signum(F.first(effect, ignorenulls=True)).cast("int").alias("sign"))
    return df.join(signs, key)


def absolute_age(c: Column, gestation: float = 19.0) -> Column:
    """"P5" -> 5 + gestation, "E18.5" -> 18.5."""
    n = F.substring(c, 2, 20).cast("double")
    return F.when(F.substring(c, 1, 1) == "P", n + gestation).otherwise(n)


def common_labels(df: DataFrame, sample: str, samples: list[str], label: str) -> DataFrame:
    """A row per label, 1 or null for each sample that has it."""
    return df.groupBy(label).pivot(sample, samples).agg(F.max(F.lit(1))).select(label, *[F.col(f"`{s}`").alias(f"in_{s}") for s in samples])


def group_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, median, sample deviation, standard error, and half of the mean's 95 % interval (null for fewer than two values)."""
    sd = F.stddev_samp(value)
    sums = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("se"))
    return sums.join(quantiles(df, group, value, {"median": 0.5}), group, "left").select(*group, "n", "mean", "median", "sd", "se", (t_quantile(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("se")).alias("ci"))


def with_columns(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def prefixed(dfs: dict[str, DataFrame], key: str, keep: Callable[[str], bool] = lambda c: True) -> DataFrame:
    """The columns chosen by name of each table, as ``label.column`` with _ for the dot, side by side by ``key``."""
    out = None
    for label, df in dfs.items():
        part = df.select(key, *[F.col(c).alias(f"{label}_{c}") for c in df.columns if c != key and keep(c)])
        out = part if out is None else out.join(part, key, "full_outer")
    return out


def pivoted(df: DataFrame, ids: list[str], conditions: list[str], values: list[str], aggregate: Column) -> DataFrame:
    """A column for each of ``values``, the conditions joined by _; ``aggregate`` says which value where several meet."""
    key = F.concat_ws("_", *conditions)
    return df.withColumn("_key", key).groupBy(*ids).pivot("_key", values).agg(aggregate)


def present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def with_names(df: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Region names and levels on metric rows; all metric rows stay."""
    return regions.join(df, key, "right")


def peaks(df: DataFrame, ids: list[str], size: str, quality: str) -> DataFrame:
    """Rows of the best quality of each group, and those of filter size 0."""
    top = df.groupBy(*ids).agg(F.max(quality).alias("_top"))
    return df.join(top, ids).filter((F.col(quality) == F.col("_top")) | (F.col(size) == 0)).select(*df.columns)


def chosen_in_order(df: DataFrame, column: str, groups: list) -> DataFrame:
    """Rows of the listed groups with ``place``, the group's place in the list."""
    return df.withColumn("place", F.array_position(F.array(*map(F.lit, dict.fromkeys(groups))), F.col(column)).cast("int")).filter("place > 0")


def volcano(df: DataFrame, effect: str, p: str, volume: str, least_effect: float, least_logp: float) -> DataFrame:
    """-log10 p, the size sqrt(volume / max) and whether a row is labelled."""
    top = df.agg(F.max(volume).alias("_top"))
    logp = -F.log10(p)
    return df.crossJoin(F.broadcast(top)).select(*df.columns, logp.alias("logp"), F.sqrt(F.try_divide(volume, F.col("_top"))).alias("size"), ((F.abs(effect) >= least_effect) & (logp >= least_logp)).alias("labelled"))  # one row


def grid_statistics(df: DataFrame, params: list[str]) -> DataFrame:
    """Positives and detections summed per parameter set: precision, sensitivity and false discovery rate."""
    s = df.groupBy(*params).agg(*[F.sum(c).alias(c) for c in ("pos", "tp", "fp")])
    ppv = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select(*params, "pos", "tp", "fp", ppv.alias("ppv"), F.try_divide("tp", "pos").alias("sensitivity"), (1 - ppv).alias("fdr"))


def parameter_grid(df: DataFrame, values: dict[str, Sequence[float]], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` of ``df`` with a column for each parameter, at every combination of the listed values."""
    for name, x in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, x))))
    return fn(df)


def compared_sets(df: DataFrame, size: str, best: Column) -> DataFrame:
    """Labelled unions of the unsmoothed rows, the rows of the best size, and all smoothed rows."""
    of = lambda name, on: df.filter(on).withColumn("set", F.lit(name))
    return of("original", F.col(size) == 0).unionByName(of("best", best)).unionByName(of("smoothed", F.col(size) > 0))


def pruning_ratios(df: DataFrame, by: list[str], before: str, after: str, next_: str) -> DataFrame:
    """Points kept by pruning over those before and over the next tile's; means weighted by the points."""
    mean = lambda c: F.try_divide(F.sum(F.try_divide(F.col(after), F.col(c)) * F.col(before)), F.sum(F.when(F.col(c) != 0, F.col(before))))
    return df.groupBy(*by).agg(F.sum(before).alias("points"), mean(before).alias("kept"), mean(next_).alias("kept_to_next"))
