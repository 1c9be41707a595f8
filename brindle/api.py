"""Fluent wrappers over the operators: tables, ordered streams, collections, series, stores.

Each holds a DataFrame and gives new wrappers; nothing runs until a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, order, relational, search, vectors, windows
from .operators.joins import asof_join, interpolate_at, key_join, theta_join
from .streaming import limiters


class Table:
    """A table with chained filters, sorts, slices and joins."""

    def __init__(self, df: DataFrame):
        self.df = df

    def where(self, test: Column | relational.Filter | Sequence[relational.Filter]) -> Table:
        return Table(self.df.where(F.coalesce(test, F.lit(False))) if isinstance(test, Column) else relational.filter_rows(self.df, test))

    def select(self, *columns: str) -> Table:
        return Table(relational.project(self.df, columns))

    def order_by(self, column: str, direction: str = "asc") -> Table:
        return Table(relational.sort_rows(self.df, (column, direction)))

    def limit(self, n: int) -> Table:
        return Table(self.df.limit(n))

    def offset(self, n: int) -> Table:
        return Table(self.df.offset(n))

    def add(self, rows: DataFrame) -> Table:
        return Table(relational.add_rows(self.df, rows))

    def join(self, other: Table, left_key: str, right_key: str, how: str = "inner") -> Table:
        return Table(key_join(self.df, other.df, left_key, right_key, how))

    def join_on(self, other: Table, condition: Column) -> Table:
        return Table(theta_join(self.df, other.df, condition))

    def group_by(self, *keys: str) -> Callable[..., Table]:
        return lambda *aggregates_: Table(self.df.groupBy(*keys).agg(*aggregates_))

    def distinct(self, column: str, *ord: str) -> list[Any]:
        found = order.distinct_values(self.df, column, *ord) if ord else self.df.select(column).distinct()
        return [r[0] for r in found.collect()]

    def _one(self, c: Column) -> Any:
        return self.df.agg(c).first()[0]

    def count(self) -> int:
        return self.df.count()

    def sum(self, column: str) -> float:
        return self._one(relational.sum_or_zero(column))

    def avg(self, column: str) -> float:
        return self._one(relational.avg_all_rows(column))

    def min(self, column: str) -> float:
        return self._one(relational.min_or_zero(column))

    def max(self, column: str) -> float:
        return self._one(relational.max_or_zero(column))

    def aggregate(self, *columns: Column) -> Any:
        return self.df.agg(*columns).first()

    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.df.collect()]


class Stream:
    """Rows in the order of ``ord``; steps are columns' expressions, so they fuse into one pass where order does not matter."""

    def __init__(self, df: DataFrame, ord: str):
        self.df, self.ord = df, ord

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int, step: int = 1) -> Stream:
        return cls(spark.range(start, end, step).select(F.col("id").alias("value"), F.col("id").alias("ord")), "ord")

    @classmethod
    def repeat(cls, spark: SparkSession, value: Any, n: int) -> Stream:
        return cls(spark.range(n).select(F.lit(value).alias("value"), F.col("id").alias("ord")), "ord")

    def map(self, **columns: Column) -> Stream:
        return Stream(self.df.withColumns(columns), self.ord)

    def filter(self, test: Column) -> Stream:
        return Stream(self.df.where(F.coalesce(test, F.lit(False))), self.ord)

    def flat_map(self, name: str, items: Column) -> Stream:
        """A row for each item; their order is the row's, then the item's."""
        rows = self.df.select("*", F.posexplode(items).alias("_at", name))
        out = order.global_index(rows, self.ord, "_at", name="_new").drop(self.ord, "_at")
        return Stream(out.withColumnRenamed("_new", self.ord), self.ord)

    def take(self, n: int) -> Stream:
        return Stream(order.take(self.df, n, self.ord), self.ord)

    def skip(self, n: int) -> Stream:
        return Stream(order.skip(self.df, n, self.ord), self.ord)

    def take_while(self, test: Column) -> Stream:
        return Stream(order.take_while(self.df, test, self.ord), self.ord)

    def skip_while(self, test: Column) -> Stream:
        return Stream(order.skip_while(self.df, test, self.ord), self.ord)

    def distinct_by(self, *keys: str) -> Stream:
        return Stream(order.distinct_first(self.df, list(keys), self.ord), self.ord)

    def sort_by(self, column: str, direction: str = "asc") -> Stream:
        """The order is the column's from here on; equal values keep theirs."""
        key = relational.order_key(column, direction == "desc")
        ranked = self.df.orderBy(key, self.ord)
        return Stream(ranked.drop(self.ord).withColumn(self.ord, F.monotonically_increasing_id()), self.ord)

    def reverse(self) -> Stream:
        return Stream(self.df.withColumn(self.ord, -F.col(self.ord)), self.ord)

    def zip(self, other: Stream) -> Stream:
        right = other.df.withColumnRenamed(other.ord, "_other")
        return Stream(order.zip_rows(self.df, right, self.ord, "_other").drop("_other"), self.ord)

    def chunk(self, size: int, *columns: str) -> DataFrame:
        return order.chunk(self.df, size, self.ord, columns=columns)

    def group_by(self, key: str, *columns: str) -> DataFrame:
        return relational.group_rows(self.df, key, self.ord, *columns)

    def reduce(self, *columns: Column) -> Any:
        return self.df.agg(*columns).first()

    def pipe(self, fn: Callable[[Stream], Stream]) -> Stream:
        return fn(self)

    def batches(self, size: int) -> Iterator[list[Any]]:
        """Rows in order in lists of ``size``, streamed to the driver."""
        part: list[Any] = []
        for r in self.df.orderBy(self.ord).toLocalIterator():
            part.append(r)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    def rows(self) -> list[Any]:
        return self.df.orderBy(self.ord).collect()

    def first(self) -> Any:
        return self.df.orderBy(self.ord).first()

    def some(self, test: Column) -> bool:
        return self.df.where(test).limit(1).count() > 0

    def every(self, test: Column) -> bool:
        return self.df.where(~F.coalesce(test, F.lit(False))).limit(1).count() == 0


class Collection:
    """Rows by a unique key; changes replace the held DataFrame."""

    def __init__(self, df: DataFrame, key: str = "id"):
        self.df, self.key = df, key

    def insert(self, rows: DataFrame) -> None:
        self.df = relational.insert(self.df, rows, self.key)

    def update(self, changes: DataFrame) -> None:
        self.df = relational.update(self.df, changes, self.key)

    def upsert(self, rows: DataFrame) -> None:
        self.df = relational.upsert(self.df, rows, self.key)

    def delete(self, test: Column) -> int:
        n = self.df.where(test).count()
        self.df = relational.delete(self.df, test)
        return n

    def find(self, where: Mapping[str, Any] | Column | None = None, **how: Any) -> DataFrame:
        return relational.find(self.df, where, **how)

    def find_one(self, where: Mapping[str, Any] | Column | None = None, **how: Any) -> Any:
        return relational.find(self.df, where, **{**how, "limit": 1}).first()

    def get(self, id: Any) -> Any:
        return self.df.where(F.col(self.key).eqNullSafe(F.lit(id))).first()

    def count(self, test: Column | None = None) -> int:
        return (self.df if test is None else self.df.where(test)).count()

    def batch(self, fn: Callable[[Collection], None]) -> None:
        """All of ``fn``'s changes, or none if it raises."""
        before = self.df
        try:
            fn(self)
        except Exception:
            self.df = before
            raise


class TimeSeries:
    """Points of keys (``by``, ts as a whole number, value)."""

    def __init__(self, df: DataFrame, by: Sequence[str], ts: str = "ts", value: str = "value"):
        self.df, self.by, self.ts, self.value = df, list(by), ts, value

    def _with(self, df: DataFrame) -> TimeSeries:
        return TimeSeries(df, self.by, self.ts, self.value)

    def add(self, points: DataFrame) -> TimeSeries:
        return self._with(self.df.unionByName(points))

    def slice(self, start: Any, end: Any) -> TimeSeries:
        return self._with(windows.series_slice(self.df, self.ts, start, end))

    def value_at(self, probes: DataFrame, interpolate: bool = False) -> DataFrame:
        if interpolate:
            return interpolate_at(probes, self.df.select(*self.by, self.ts, self.value), self.ts, self.value, self.by)
        return asof_join(probes, self.df, self.ts, self.value, self.by)

    def resample(self, step: int) -> TimeSeries:
        return self._with(windows.resample(self.df, self.ts, self.value, step, self.by))

    def map(self, value: Column) -> TimeSeries:
        return self._with(self.df.withColumn(self.value, value))

    def stats(self) -> DataFrame:
        return windows.series_stats(self.df, self.value, *self.by)

    def sma(self, period: int) -> DataFrame:
        return windows.sma(self.df, self.value, period, self.by, [self.ts])

    def ema(self, alpha: float) -> DataFrame:
        return windows.ema(self.df, self.value, alpha, self.by, [self.ts])


class VectorStore:
    """Vectors by id with exact search."""

    def __init__(self, df: DataFrame, id: str = "id", vector: str = "vector"):
        self.df, self.id, self.vector = df, id, vector

    def upsert(self, rows: DataFrame) -> None:
        self.df = relational.upsert(self.df, rows, self.id)

    def delete(self, ids: Sequence[Any]) -> None:
        self.df = self.df.where(~F.col(self.id).isin(*ids))

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        return vectors.search(self.df, self.id, self.vector, query, k)

    def search_threshold(self, query: Sequence[float], threshold: float) -> DataFrame:
        return vectors.search_threshold(self.df, self.id, self.vector, query, threshold)

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return vectors.search_many(queries, self.df, self.id, self.vector, k)


class SearchIndex:
    """Documents with text fields; searches split the texts, or read ``postings`` once those are saved."""

    def __init__(self, df: DataFrame, id: str, *fields: str):
        self.df, self.id, self.fields = df, id, fields

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        return search.search_tf(self.df, self.id, list(self.fields), query, limit)

    def search_fields(self, query: str, weights: Mapping[str, float], **how: Any) -> DataFrame:
        return search.search_fields(self.df, self.id, query, dict(weights), **how)

    def postings(self) -> DataFrame:
        return search.postings(self.df, self.id, *self.fields)

    def search_postings(self, postings: DataFrame, query: str) -> DataFrame:
        """id and score from a saved index: a filter on its terms and a sum."""
        found = search.query_terms(query)
        return postings.where(F.col("term").isin(*found)).groupBy(self.id).agg(F.sum("tf").alias("score")).orderBy(F.desc("score"), self.id)

    def upsert(self, rows: DataFrame) -> None:
        self.df = relational.upsert(self.df, rows, self.id)

    def remove(self, id: Any) -> None:
        self.df = self.df.where(F.col(self.id) != id)


class VersionConflict(ValueError):
    """A stream has another version than the writer expected."""


class EventStore:
    """Events (stream, version, type, data, ts) by stream and version from 1."""

    def __init__(self, df: DataFrame):
        self.df = df

    def version(self, stream: str) -> int:
        return self.df.where(F.col("stream") == stream).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def append(self, stream: str, type: str, data: str, ts: Any, expected: int | None = None) -> int:
        now = self.version(stream)
        if expected is not None and expected != now:
            raise VersionConflict(f"{stream} is at {now}, not {expected}")
        row = self.df.sparkSession.createDataFrame([(stream, now + 1, type, data, ts)], self.df.schema)
        self.df = self.df.unionByName(row)
        return now + 1

    def stream(self, stream: str, since: int = 0) -> DataFrame:
        return self.df.where((F.col("stream") == stream) & (F.col("version") > since)).orderBy("version")

    def by_type(self, type: str) -> DataFrame:
        return self.df.where(F.col("type") == type)

    def replay(self, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        """stream and state: each stream's events in order, folded."""
        item = F.struct("version", "type", "data", "ts")
        rows = self.df.groupBy("stream").agg(F.array_sort(F.collect_list(item)).alias("_e"))
        return rows.select("stream", F.aggregate("_e", start, step).alias("state"))

    def latest(self) -> DataFrame:
        return limiters.replay(self.df, "stream", "version", "type", "data")


class Series:
    """Statistics of one column."""

    def __init__(self, df: DataFrame, column: str):
        self.df, self.column = aggregates.require_rows(df, column), column

    def _one(self, c: Column) -> Any:
        return self.df.agg(c).first()[0]

    def mean(self) -> float:
        return self._one(F.avg(self.column))

    def median(self) -> float:
        return self._one(aggregates.quantile(self.column, 0.5))

    def modes(self) -> list[Any]:
        return [r.mode for r in aggregates.modes(self.df, self.column).collect()]

    def variance(self, population: bool = False) -> float:
        return self._one(aggregates.variance(self.column, population))

    def quantile(self, q: float) -> float:
        return self._one(aggregates.quantile(self.column, q))

    def outliers(self) -> DataFrame:
        return aggregates.outliers(self.df, self.column)

    def histogram(self, bins: int) -> DataFrame:
        return aggregates.histogram(self.df, self.column, bins)
