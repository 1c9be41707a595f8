"""Windows over event time. On a stream give ``late``; rows later than that are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970; times without a zone count as UTC in a UTC session."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = "10 minutes") -> DataFrame:
    """start, end, keys and aggregates of each window with rows."""
    g = with_late(df, ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(*aggregates)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sliding(df: DataFrame, ts: str, width: str, step: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = "10 minutes") -> DataFrame:
    g = with_late(df, ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(*aggregates)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, *aggregates: Column, by: tuple[str, ...] = (), late: str | None = "10 minutes") -> DataFrame:
    """Rows of a key that follow each other within the gap; end is the last row's time and the gap."""
    g = with_late(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggregates)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in g.columns if c != "w"])


def debounced(df: DataFrame, ts: str, gap_seconds: float, by: str) -> DataFrame:
    """The last row of each burst: rows with none of their key after them within the gap."""
    nxt = F.lead(ts).over(Window.partitionBy(by).orderBy(ts))
    return df.withColumn("_next", nxt).where(F.col("_next").isNull() | ((micros("_next") - micros(ts)) > gap_seconds * 1e6)).drop("_next")


def throttled_marks(df: DataFrame, ts: str, gap_seconds: float, by: str) -> DataFrame:
    """The first row of each aligned interval of a key: the aligned form of throttling."""
    slot = F.floor(micros(ts) / (gap_seconds * 1e6))
    return df.withColumn("_slot", slot).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_slot").orderBy(ts))).where("_n = 1").drop("_n", "_slot")


def distinct_events(df: DataFrame, id: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """One row for each id; on a stream within the time that rows may be late."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([id]) if df.isStreaming else df.dropDuplicates([id])


def rate_in_window(df: DataFrame, ts: str, seconds: int, by: str) -> DataFrame:
    """Each row with the count and rate of its key's rows in the ``seconds`` up to it: a sliding log."""
    w = Window.partitionBy(by).orderBy(micros(ts)).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("per_second", F.col("in_window") / seconds)
