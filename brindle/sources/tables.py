"""Keyed tables in a catalog: put, get, delete, count; generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def get(table: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return table.where(F.col(key).eqNullSafe(F.lit(value)))


def put_all(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their key, the rest are added."""
    return table.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove_all(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def save(df: DataFrame, name: str, *bucket_by: str, buckets: int = 0) -> None:
    """A catalog table; bucketed, later joins on the key need no shuffle."""
    w = df.write.mode("overwrite")
    if bucket_by and buckets:
        w = w.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    w.saveAsTable(name)


def number_rows(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """End-exclusive integers as rows."""
    return spark.range(start, end, step)


def repeated(spark: SparkSession, value, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(value).alias("value"))
