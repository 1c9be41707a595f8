"""Admission by key over event time, and folds of event logs.

The same step functions run in batch (one key's rows in order, by applyInPandas) and on streams
(applyInPandasWithState).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


class TokenBucket:
    """Continuous refill of ``rate`` tokens a second up to ``capacity``; a row takes one."""

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate, self.tokens, self.at = capacity, rate, capacity, None

    def admit(self, t: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.capacity, self.tokens + (t - self.at) * self.rate)
        self.at = t
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


class DiscreteBucket:
    """Refill of ``rate`` tokens for each whole interval gone by."""

    def __init__(self, capacity: float, rate: float, interval: float = 1.0):
        self.capacity, self.rate, self.interval, self.tokens, self.at = capacity, rate, interval, capacity, None

    def admit(self, t: float) -> bool:
        if self.at is None:
            self.at = t
        n = int((t - self.at) // self.interval)
        if n > 0:
            self.tokens = min(self.capacity, self.tokens + n * self.rate)
            self.at += n * self.interval
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


class SlidingLog:
    """At most ``limit`` admitted rows in any ``window`` seconds."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.log = limit, window, deque()

    def admit(self, t: float) -> bool:
        while self.log and self.log[0] <= t - self.window:
            self.log.popleft()
        if len(self.log) < self.limit:
            self.log.append(t)
            return True
        return False


class FixedWindow:
    """A window opens at the first row after the last one closed; ``limit`` rows are admitted in it."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.start, self.n = limit, window, None, 0

    def admit(self, t: float) -> bool:
        if self.start is None or t - self.start >= self.window:
            self.start, self.n = t, 0
        if self.n < self.limit:
            self.n += 1
            return True
        return False


class LeakyBucket:
    """A level that leaks ``rate`` a second; a row adds one while it is under ``capacity``."""

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate, self.level, self.at = capacity, rate, 0.0, None

    def admit(self, t: float) -> bool:
        if self.at is not None:
            self.level = max(0.0, self.level - (t - self.at) * self.rate)
        self.at = t
        if self.level < self.capacity:
            self.level += 1
            return True
        return False


def limit(df: DataFrame, ts: str, by: str, make, *tie: str) -> DataFrame:
    """``df`` with admitted, by one limiter for each key; ``make()`` gives a new one. A key's rows stream through its task in order; none are held."""
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("admitted", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            found = []
            for k, t in zip(b.column(names.index(by)).to_pylist(), b.column(names.index(ts)).cast(pa.int64()).to_pylist()):
                if state is None or k != key:
                    key, state = k, make()
                found.append(state.admit(t / 1e6))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.bool_())], names=[*names, "admitted"])

    return df.repartition(by).sortWithinPartitions(by, ts, *tie).mapInArrow(run, schema)


def limit_stream(df: DataFrame, ts: str, by: str, capacity: float, rate: float, late: str = "10 minutes") -> DataFrame:
    """The token bucket on a stream: key, ts and admitted of each row; the state is tokens and time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        bucket = TokenBucket(capacity, rate)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        for b in batches:
            b = b.sort_values(ts)
            seconds = b[ts].astype("datetime64[us]").astype("int64") / 1e6
            yield pd.DataFrame({by: key[0], ts: b[ts], "admitted": [bucket.admit(t) for t in seconds]})
        if bucket.at is not None:
            state.update((float(bucket.tokens), float(bucket.at)))

    kind = df.schema[by].dataType.simpleString()
    return df.withWatermark(ts, late).select(by, ts).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {ts} timestamp, admitted boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, stream: str, version: str, *latest: str) -> DataFrame:
    """The current state of each stream: its last version, its count and the ``latest`` columns at that version."""
    return events.groupBy(stream).agg(F.max(version).alias("version"), F.count(F.lit(1)).alias("events"), *[F.max_by(c, version).alias(c) for c in latest])


def replay_until(events: DataFrame, ts: str, until, stream: str, version: str, *latest: str) -> DataFrame:
    return replay(events.where(F.col(ts) <= until), stream, version, *latest)


def with_versions(events: DataFrame, stream: str, *ord: str) -> DataFrame:
    """Versions from 1 within each stream."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(stream).orderBy(*ord)))


def merge_last_writer(*replicas: DataFrame, key: str = "key", ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Of each key the entry with the greatest time; tombstones win their time and are left out of the result."""
    both = replicas[0]
    for r in replicas[1:]:
        both = both.unionByName(r)
    rest = [c for c in both.columns if c != key]
    order = F.struct(ts, *([F.col("tombstone")] if "tombstone" in both.columns else []), *([F.col(tie)] if tie else []))
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return last.where(~F.col("tombstone")).drop("tombstone") if "tombstone" in both.columns else last


def counter_value(increments: DataFrame, node: str, up: str, down: str | None = None) -> DataFrame:
    """A replicated counter: the greatest seen of each node, summed; with ``down``, increments less decrements."""
    best = increments.groupBy(node).agg(F.max(up).alias("_u"), *([F.max(down).alias("_d")] if down else []))
    return best.agg((F.coalesce(F.sum("_u"), F.lit(0)) - (F.coalesce(F.sum("_d"), F.lit(0)) if down else 0)).alias("value"))
