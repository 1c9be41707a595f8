"""A session with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow. On a cluster leave ``master`` and the partitions to its settings."""
    b = SparkSession.builder.appName("brindle")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
