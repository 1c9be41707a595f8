"""Series by key: moving frames, recursive folds, resampling, bands.

Every operator takes ``by`` columns: a window without them would put all rows in one
task. The recursive folds (EMA, RSI, Kalman) stream each key's rows in order through one
task and hold no series; cumulative values of one long series are in ``cumulative``, which works in ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType


def _frame(by: Sequence[str], ord: Sequence[str], period: int):
    w = Window.partitionBy(*by).orderBy(*ord)
    return w, w.rowsBetween(1 - period, 0)


def sma(df: DataFrame, value: str, period: int, by: Sequence[str], ord: Sequence[str], name: str = "sma") -> DataFrame:
    """Trailing mean; rows before the first full window are left out."""
    w, frame = _frame(by, ord, period)
    return df.withColumns({name: F.avg(value).over(frame), "_n": F.row_number().over(w)}).where(F.col("_n") >= period).drop("_n")


def cma(value: str, by: Sequence[str], ord: Sequence[str]) -> Column:
    """Mean of all rows so far."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*ord).rowsBetween(Window.unboundedPreceding, 0))


def cumsum(value: str, by: Sequence[str], ord: Sequence[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*ord).rowsBetween(Window.unboundedPreceding, 0))


def wma(df: DataFrame, value: str, period: int, by: Sequence[str], ord: Sequence[str], name: str = "wma") -> DataFrame:
    """Weights 1 to period, the newest weighs most; full windows only."""
    w, _ = _frame(by, ord, period)
    total = sum((F.lag(value, j).over(w) * (period - j) for j in range(1, period)), F.col(value) * period)
    return df.withColumns({name: total / (period * (period + 1) / 2), "_n": F.row_number().over(w)}).where(F.col("_n") >= period).drop("_n")


def rolling_std(df: DataFrame, value: str, period: int, by: Sequence[str], ord: Sequence[str], name: str = "std") -> DataFrame:
    """Population deviation of full windows."""
    w, frame = _frame(by, ord, period)
    return df.withColumns({name: F.stddev_pop(value).over(frame), "_n": F.row_number().over(w)}).where(F.col("_n") >= period).drop("_n")


def bollinger(df: DataFrame, value: str, period: int, by: Sequence[str], ord: Sequence[str], width: float = 2.0) -> DataFrame:
    """middle, upper, lower: one window serves both means and deviations."""
    w, frame = _frame(by, ord, period)
    out = df.withColumns({"middle": F.avg(value).over(frame), "_sd": F.stddev_pop(value).over(frame), "_n": F.row_number().over(w)}).where(F.col("_n") >= period)
    return out.withColumns({"upper": F.col("middle") + width * F.col("_sd"), "lower": F.col("middle") - width * F.col("_sd")}).drop("_sd", "_n")


def fold(df: DataFrame, by: Sequence[str], ord: Sequence[str], values: Sequence[str], start, step, fields: Sequence[str], kind: DataType = DoubleType(), cast: str | None = "double") -> DataFrame:
    """A recursive fold over each key's rows in order: one row for each input row, with its ``by`` and ``ord`` columns and ``fields``.

    step(state, *values) gives the next state and the fields' values, all of one ``kind``; values are cast to ``cast``. A row with a null among its values has null fields and
    leaves the state as it is. The rows of a task stream through it sorted by key and order, so no key's series is ever held.
    """
    kept = [*by, *ord]
    rows = df.select(*kept, *[(F.col(v).cast(cast) if cast else F.col(v)).alias(f"_{i}") for i, v in enumerate(values)])
    schema = StructType([*[rows.schema[c] for c in kept], *[StructField(f, kind) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, nothing = None, start, (None,) * len(fields)
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            keys = zip(*(b.column(i).to_pylist() for i in range(len(by)))) if by else ((),) * b.num_rows
            for k, x in zip(keys, zip(*(c.to_pylist() for c in b.columns[len(kept) :]))):
                if k != key:
                    key, state = k, start
                if None in x:
                    out.append(nothing)
                else:
                    state, row = step(state, *x)
                    out.append(row)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(c, arrow) for c in zip(*out)]], names=[*kept, *fields])

    arrow = to_arrow_type(kind)
    dealt = rows.repartition(*by) if by else rows.repartition(1)
    return dealt.sortWithinPartitions(*by, *ord).mapInArrow(run, schema)


def ema(df: DataFrame, value: str, alpha: float, by: Sequence[str], ord: Sequence[str], name: str = "ema") -> DataFrame:
    """Exponential mean with weight ``alpha``, seeded by the first value. For a period p, alpha = 2 / (p + 1)."""

    def step(mean: float | None, x: float):
        mean = x if mean is None else alpha * x + (1 - alpha) * mean
        return mean, (mean,)

    return fold(df, by, ord, [value], None, step, [name])


def macd(df: DataFrame, value: str, by: Sequence[str], ord: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (fast less slow EMA), signal (its EMA) and histogram, in one fold."""
    a, b, c = (2 / (p + 1) for p in (fast, slow, signal))

    def step(state, x: float):
        if state is None:
            f, g, s = x, x, 0.0
        else:
            f, g = a * x + (1 - a) * state[0], b * x + (1 - b) * state[1]
            s = c * (f - g) + (1 - c) * state[2]
        return (f, g, s), (f - g, s, f - g - s)

    return fold(df, by, ord, [value], None, step, ["macd", "signal", "histogram"])


def rsi(df: DataFrame, value: str, by: Sequence[str], ord: Sequence[str], period: int = 14) -> DataFrame:
    """Wilder's index: the first mean gain and loss are plain over ``period`` changes, later ones smoothed; 100 without losses. Rows from the period on."""

    def step(state, x: float):
        if state is None:
            return (x, 0, 0.0, 0.0), (None,)
        last, n, gain, loss = state
        n, up, down = n + 1, max(x - last, 0.0), max(last - x, 0.0)
        mix = lambda old, new: old + new / period if n <= period else (old * (period - 1) + new) / period
        gain, loss = mix(gain, up), mix(loss, down)
        index = None if n < period else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        return (x, n, gain, loss), (index,)

    return fold(df, by, ord, [value], None, step, ["rsi"]).where("rsi is not null")


def kalman(df: DataFrame, value: str, by: Sequence[str], ord: Sequence[str], process: float = 1.0, noise: float = 1.0) -> DataFrame:
    """One-dimensional estimate of each row, started at the first value with variance 1."""

    def step(state, x: float):
        estimate, p = (x, 1.0) if state is None else state
        p += process
        gain = p / (p + noise)
        estimate += gain * (x - estimate)
        return (estimate, (1 - gain) * p), (estimate,)

    return fold(df, by, ord, [value], None, step, ["estimate"])


def cumulative(df: DataFrame, value: str, ord: str, name: str = "running") -> DataFrame:
    """Running sum over one long series without a key: sums within ranges of ``ord`` (numeric), moved up by the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(ord, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    area = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(ord).cast("double"))) if cuts else F.lit(0)
    ranged = df.withColumn("_area", area)
    before = ranged.groupBy("_area").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_area").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    local = F.sum(value).over(Window.partitionBy("_area").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_area").withColumn(name, F.col("_local") + F.col("_before")).drop("_area", "_local", "_before")


def series_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows of an inclusive time range; the filter reaches the scan."""
    return df.where(F.col(ts).between(start, end))


def series_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    nan = F.lit(float("nan"))
    return df.groupBy(*by).agg(F.coalesce(F.min(value), nan).alias("min"), F.coalesce(F.max(value), nan).alias("max"), F.coalesce(F.avg(value), nan).alias("mean"), F.coalesce(F.stddev_pop(value), nan).alias("std"), F.count(value).alias("count"))


def resample(df: DataFrame, ts: str, value: str, step: int, by: Sequence[str]) -> DataFrame:
    """A grid of ``step`` from each key's first time on, linear between the points; ``ts`` is an integer, one row for each time."""
    from .joins import interpolate_at

    grid = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(ts))
    return interpolate_at(grid, df.select(*by, ts, value), ts, value, by)


def haar(xs: Column) -> Column:
    """One level of the Haar transform of an array of even length: means, then differences, each over sqrt(2)."""
    half = F.floor(F.size(xs) / 2).cast("int")
    index = F.when(half > 0, F.sequence(F.lit(1), F.greatest(half, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    pair = lambda sign: F.transform(index, lambda i: (F.element_at(xs, 2 * i - 1) + sign * F.element_at(xs, 2 * i)) / F.sqrt(F.lit(2.0)))
    return F.concat(pair(1), pair(-1))
