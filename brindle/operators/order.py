"""Operators that rest on input order, by an explicit ordinal column; none numbers all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Rows numbered from 0 in a total order, in parallel: rows are dealt into ranges, numbered there, and moved up by the counts of the ranges before.

    The ranges are cut at quantiles of the first order column, found once, so that numbering and counting agree.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order[0])
    as_double = F.unix_micros(key.cast("timestamp")).cast("double") if dict(df.dtypes)[order[0]].startswith("timestamp") else key.cast("double")
    cuts = sorted(set(df.select(as_double.alias("_k")).approxQuantile("_k", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    area = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= as_double)) if cuts else F.lit(0)
    ranged = df.withColumn("_area", F.coalesce(area, F.lit(-1)))
    # one row for each range
    before = ranged.groupBy("_area").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_area").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_area").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_area").withColumn(name, F.col("_local") + F.col("_before")).drop("_area", "_local", "_before")


def distinct_first(df: DataFrame, key: str | Sequence[str], *ord: str) -> DataFrame:
    """The first row of each key by ``ord``; null is a key. An aggregation, which combines before the shuffle, unlike a window."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ord)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def distinct_values(df: DataFrame, column: str, *ord: str) -> DataFrame:
    """Values in first-seen order, null among them."""
    return df.groupBy(column).agg(F.min(F.struct(*ord)).alias("_first")).orderBy("_first").select(column)


def take(df: DataFrame, n: int, *ord: str) -> DataFrame:
    return df.orderBy(*ord).limit(max(n, 0))


def skip(df: DataFrame, n: int, *ord: str) -> DataFrame:
    return df.orderBy(*ord).offset(max(n, 0))


def take_while(df: DataFrame, test: Column, ord: str) -> DataFrame:
    """Rows before the first that fails ``test`` (null fails): one aggregate, then a filter."""
    stop = df.where(~F.coalesce(test, F.lit(False))).agg(F.min(ord)).scalar()
    return df.where(stop.isNull() | (F.col(ord) < stop))


def skip_while(df: DataFrame, test: Column, ord: str) -> DataFrame:
    """Rows from the first that fails ``test`` on."""
    stop = df.where(~F.coalesce(test, F.lit(False))).agg(F.min(ord)).scalar()
    return df.where(F.col(ord) >= stop)


def chunk(df: DataFrame, size: int, *ord: str, columns: Sequence[str]) -> DataFrame:
    """Arrays of ``size`` rows in order, the last one shorter: chunk and items."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    numbered = global_index(df.select(*dict.fromkeys([*ord, *columns])), *ord)
    item = F.struct("index", *columns)
    return numbered.groupBy(F.floor(F.col("index") / size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("items"))


def zip_rows(a: DataFrame, b: DataFrame, a_ord: str, b_ord: str) -> DataFrame:
    """Rows paired by position; the shorter side ends it."""
    return global_index(a, a_ord, name="_at").join(global_index(b, b_ord, name="_at"), "_at").drop("_at")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k, which is what a bounded heap does."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark prunes to k in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def kth(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value (from 1), or no row."""
    return df.select(column).orderBy(F.col(column).asc_nulls_last()).limit(k).orderBy(F.col(column).desc_nulls_first()).limit(1) if k == 1 else df.select(column).orderBy(F.col(column).asc_nulls_last()).offset(k - 1).limit(1)


def page_of(df: DataFrame, page: int, size: int, *ord: str) -> DataFrame:
    """Page ``page`` from 1; pages under 1 are the first."""
    return df.orderBy(*ord).offset((max(page, 1) - 1) * size).limit(size)


def page_info(page: int, size: int, total: int) -> dict[str, int | bool]:
    """Pages, the page in range, its first and last row (exclusive), and whether there are others."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    start = (page - 1) * size
    return {"page": page, "page_size": size, "total": total, "pages": pages, "start": start, "end": min(start + size, total), "has_next": page < pages, "has_previous": page > 1}


def cursor_of(id: Column) -> Column:
    """The opaque cursor of a row: base64 of {"id": ...}."""
    return F.base64(F.to_json(F.struct(id.alias("id"))).cast("binary"))


def id_of_cursor(cursor: Column, kind: str = "string") -> Column:
    return F.from_json(F.unbase64(cursor).cast("string"), f"id {kind}")["id"]


def page_after(df: DataFrame, ord: str, cursor: object | None, size: int) -> DataFrame:
    """The next ``size`` rows after an ordinal: a filter that reaches the scan, not an offset."""
    return (df if cursor is None else df.where(F.col(ord) > cursor)).orderBy(ord).limit(size)


def page_before(df: DataFrame, ord: str, cursor: object | None, size: int) -> DataFrame:
    """The ``size`` rows before an ordinal, in order."""
    return (df if cursor is None else df.where(F.col(ord) < cursor)).orderBy(F.desc(ord)).limit(size).orderBy(ord)
