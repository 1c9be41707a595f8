"""Descriptive statistics in two families (sample and population), quantiles, outliers, histograms, regression."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import global_index


class EmptyInput(ValueError):
    """A statistic of no values where the family raises instead of giving NaN."""


def require_rows(df: DataFrame, column: str) -> DataFrame:
    """``df``, or EmptyInput if the column has no value: one row is looked at."""
    if df.where(F.col(column).isNotNull()).limit(1).count() == 0:
        raise EmptyInput(column)
    return df


def modes(df: DataFrame, column: str) -> DataFrame:
    """All modal values, ascending: mode and count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("mode")).agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") == counts.agg(F.max("count")).scalar()).orderBy("mode")


def variance(c: str, population: bool = False) -> Column:
    """Sample by default."""
    return F.var_pop(c) if population else F.var_samp(c)


def stddev(c: str, population: bool = False) -> Column:
    return F.stddev_pop(c) if population else F.stddev_samp(c)


def skewness(c: str) -> Column:
    """Population moment g1; NaN becomes null where the values do not vary."""
    return F.skewness(c)


def skewness_adjusted(c: str) -> Column:
    """g1 * n^2 / ((n - 1)(n - 2)); null under three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * n * n / ((n - 1) * (n - 2)))


def kurtosis(c: str) -> Column:
    """Excess, population."""
    return F.kurtosis(c)


def quantile(c: str, q: float) -> Column:
    """Exact, linear between ranks; q in [0, 1]."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    return F.percentile(c, q)


def percentile(c: str, p: float) -> Column:
    """p in [0, 100], clamped."""
    return F.percentile(c, min(max(p, 0.0), 100.0) / 100)


def quartiles(c: str) -> Column:
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return F.struct(q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


def iqr(c: str) -> Column:
    q = F.percentile(c, [0.25, 0.75])
    return q[1] - q[0]


def value_range(c: str) -> Column:
    return F.max(c) - F.min(c)


def percentile_rank(c: str, value: float) -> Column:
    """Share in per cent of the values at or under ``value``."""
    return 100 * F.avg(F.when(F.col(c) <= value, 1.0).when(F.col(c).isNotNull(), 0.0))


def nearest_rank(df: DataFrame, column: str, p: float, *by: str) -> DataFrame:
    """The value at rank ceil(n * p), at least 1, of each group: percentile_disc, which sorts no rows."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.expr(f"percentile_disc({max(p, 0.0)}) WITHIN GROUP (ORDER BY `{column}`)").alias("value"))


def z_score(x: Column, mean: Column, sd: Column, degenerate: float | None = None) -> Column:
    """(x - mean) / sd; ``degenerate`` (null by default) where sd is 0."""
    return F.when(sd == 0, F.lit(degenerate).cast("double")).otherwise((x - mean) / sd)


def with_moments(df: DataFrame, column: str, *by: str, population: bool = True) -> DataFrame:
    """Rows with the mean and standard deviation of their group joined on: an aggregation and a join, no window over all rows."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("mean"), stddev(column, population).alias("sd"))
    return df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without groups: one row


def min_max_scaled(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """(x - min) / (max - min), 0 where they are equal; the bounds are one row."""
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(b)).withColumn(name, x).drop("_lo", "_hi")


def summarize(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, min, max, mean, median, std (population), q1, q3, iqr in one aggregation."""
    q = F.percentile(column, [0.25, 0.5, 0.75])
    return df.groupBy(*by).agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), q.alias("_q")).select(
        *by, "count", "min", "max", "mean", F.col("_q")[1].alias("median"), "std", F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr")
    )


def outliers(df: DataFrame, column: str, k: float = 1.5, keep: bool = False) -> DataFrame:
    """Rows outside the fences q1 - k * iqr and q3 + k * iqr, or with ``keep`` those inside. The fences are one row."""
    q = df.agg(F.percentile(column, [0.25, 0.75]).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    inside = F.col(column).between(lo - k * (hi - lo), hi + k * (hi - lo))
    return df.crossJoin(F.broadcast(q)).where(inside if keep else ~inside).drop("_q")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lower, upper, count of equal-width bins, empty ones too; the last is closed; a constant column has width 1."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    b = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).where("lo is not null")
    b = b.withColumn("width", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / bins))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(b)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = b.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lower = F.col("lo") + F.col("bin") * F.col("width")
    return every.join(counts, "bin", "left").select("bin", lower.alias("lower"), (lower + F.col("width")).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def covariance(x: str, y: str, population: bool = False) -> Column:
    return F.covar_pop(x, y) if population else F.covar_samp(x, y)


def pearson(x: str, y: str, degenerate: float = float("nan")) -> Column:
    """NaN, or what is given, where either does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(degenerate))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1, ties share their mean: ranks come from the counts of the distinct values, numbered in parallel ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(counts.approxQuantile(column, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    area = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column).cast("double"))) if cuts else F.lit(0)
    counts = counts.withColumn("_area", area)
    before = counts.groupBy("_area").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_area").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    upto = F.sum("_n").over(Window.partitionBy("_area").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("_upto", upto).join(F.broadcast(before), "_area").select(F.col(column).alias("_v"), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(pearson("_rx", "_ry").alias("spearman"))


def linear_regression(x: str, y: str) -> list[Column]:
    """slope, intercept and r2 of least squares."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def trend(df: DataFrame, column: str, ord: str, eps: float = 1e-10) -> DataFrame:
    """increasing, decreasing or flat, by the slope over the position."""
    at = global_index(df.select(ord, column), ord, name="_at")
    slope = F.regr_slope(column, "_at")
    return at.agg(F.when(slope > eps, "increasing").when(slope < -eps, "decreasing").otherwise("flat").alias("trend"))


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.sqrt(2 * F.lit(3.141592653589793)))


# fixed values: coefficients of formula 7.1.26 of Abramowitz and Stegun for the error function
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Within 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return (1 + erf((x - mean) / (sd * 2**0.5))) / 2


def funnel(df: DataFrame, name: str, steps: Sequence[str]) -> DataFrame:
    """step, position, count and percent of the first step's count (0 where that is 0). Counts only: order and user play no part."""
    counts = df.agg(*[F.count_if(F.col(name) == s).alias(f"_{i}") for i, s in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), F.col(f"_{i}").alias("count")) for i, s in enumerate(steps)])
    return counts.select("_0", F.explode(rows).alias("r")).select("r.*", F.when(F.col("_0") == 0, 0.0).otherwise(100 * F.col("r.count") / F.col("_0")).alias("percent"))


def bootstrap_interval(df: DataFrame, column: str, iterations: int = 200, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean by Poisson bootstrap: each row draws its weight in each resample, so no resample is gathered."""
    weight = F.expr(f"transform(sequence(1, {iterations}), i -> named_struct('i', i, 'u', (pmod(xxhash64(_row, i, {seed}), 4503599627370496)) / 4503599627370496.0D))")
    poisson = "case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 when u < 0.9963401531726563 then 4 when u < 0.9994058151824183 then 5 else 6 end"
    drawn = df.where(F.col(column).isNotNull()).withColumn("_row", F.monotonically_increasing_id()).select(column, F.explode(weight).alias("w")).select(column, "w.i", F.expr(poisson.replace("u <", "w.u <")).alias("n"))
    means = drawn.groupBy("i").agg((F.sum(F.col(column) * F.col("n")) / F.sum("n")).alias("mean"))
    lo = (1 - confidence) / 2
    return means.agg(F.percentile("mean", lo).alias("lower"), F.percentile("mean", 1 - lo).alias("upper"), F.avg("mean").alias("mean"))


def ab_variant(experiment: str, user: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """A variant for each user by a hash of experiment and user against cumulative weights."""
    total = sum(w for _, w in weights)
    at = F.pmod(F.crc32(F.concat(F.lit(experiment + ":"), user.cast("string")).cast("binary")), F.lit(total))
    out, upto = None, 0
    for name, w in weights:
        upto += w
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def mse(predicted: str, target: str) -> Column:
    return F.avg(F.pow(F.col(predicted) - F.col(target), 2))


def cross_entropy(predicted: str, target: str, eps: float | None = 1e-15) -> Column:
    """Binary, probabilities clipped by ``eps``; where it is None, only as far as a logarithm of 0 would come up."""
    low, high = (sys.float_info.min, 1 - sys.float_info.epsilon / 2) if eps is None else (eps, 1 - eps)
    p = F.greatest(F.least(F.col(predicted), F.lit(high)), F.lit(low))
    t = F.col(target)
    return -F.avg(t * F.log(p) + (1 - t) * F.log(1 - p))
