"""Sets and bags of rows, and interval algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows with how often each side has them, by one union and one aggregation."""
    cols = a.columns
    return a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(b.select(cols).withColumns({"_a": F.lit(0), "_b": F.lit(1)})).groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def _as_counts(df: DataFrame, count: Column) -> DataFrame:
    return df.withColumn("count", count).where("count > 0").drop("_a", "_b")


def bag(df: DataFrame) -> DataFrame:
    """Distinct rows with their count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("count"))


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts: the greater."""
    return _as_counts(_counted(a, b), F.greatest("_a", "_b"))


def bag_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _as_counts(_counted(a, b), F.least("_a", "_b"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _as_counts(_counted(a, b), F.greatest(F.col("_a") - F.col("_b"), F.lit(0)))


def bag_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    return _as_counts(_counted(a, b), F.col("_a") + F.col("_b"))


def expand(counted: DataFrame) -> DataFrame:
    """Rows of a counted bag as often as their count."""
    return counted.withColumn("_i", F.explode(F.sequence(F.lit(1), "count"))).drop("_i", "count")


def merge_ranges(df: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """Unions of the half-open ranges that overlap or touch, within ``by``: gaps and islands.

    Without ``by`` all ranges would meet in one task; give a bucket and stitch its results, or a group.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(start) < F.col(end)).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def invert_ranges(df: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """The gaps between the merged ranges."""
    w = Window.partitionBy(*by).orderBy(start)
    return merge_ranges(df, start, end, *by).withColumn("_next", F.lead(start).over(w)).where("_next is not null").select(*by, F.col(end).alias(start), F.col("_next").alias(end))


def range_contains(start: str, end: str, value: Column) -> Column:
    return (value >= F.col(start)) & (value < F.col(end))


def ranges_overlap(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))


def range_intersection(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """struct<start, end>, or null where they do not meet."""
    lo, hi = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return F.when(lo < hi, F.struct(lo.alias("start"), hi.alias("end")))


def interval_op(op: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Closed intervals: add, sub, mul, div (null where the divisor holds 0), hull, intersect."""
    (al, ah), (bl, bh) = a, b
    if op == "add":
        lo, hi = al + bl, ah + bh
    elif op == "sub":
        lo, hi = al - bh, ah - bl
    elif op in ("mul", "div"):
        if op == "div":
            ok = (bl > 0) | (bh < 0)
            bl, bh = F.when(ok, 1 / F.nullif(bh, F.lit(0.0))), F.when(ok, 1 / F.nullif(bl, F.lit(0.0)))
        products = [al * bl, al * bh, ah * bl, ah * bh]
        lo, hi = F.least(*products), F.greatest(*products)
        return F.when(bl.isNotNull(), F.struct(lo.alias("low"), hi.alias("high")))
    elif op == "hull":
        lo, hi = F.least(al, bl), F.greatest(ah, bh)
    elif op == "intersect":
        lo, hi = F.greatest(al, bl), F.least(ah, bh)
        return F.when(lo <= hi, F.struct(lo.alias("low"), hi.alias("high")))
    else:
        raise ValueError(op)
    return F.struct(lo.alias("low"), hi.alias("high"))
