"""Vectorised UDFs that are made when they are used, so that modules can be imported before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """As F.pandas_udf, for a result type in DDL."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        return call

    return wrap
