"""Programs over one value (an array, a text, a matrix): dynamic programming, splines, wavelets, simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectorized import vectorized


def _each(fn, kind: str):
    @vectorized(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def _coins(coins, amount) -> int:
    best = [0] + [1 << 60] * int(amount)
    for a in range(1, int(amount) + 1):
        best[a] = min((best[a - c] + 1 for c in coins if 0 < c <= a), default=1 << 60)
    return -1 if best[-1] >= 1 << 60 else best[-1]


def _subset(numbers, target) -> bool:
    sums = {0}
    for n in numbers:
        sums |= {s + n for s in sums}
    return int(target) in sums


def _rising(numbers, _) -> int:
    from bisect import bisect_left

    ends: list = []
    for n in numbers:
        i = bisect_left(ends, n)
        ends[i : i + 1] = [n]
    return len(ends)


#: The fewest coins for an amount, or -1; whether some numbers add up to a target; the length of the longest rising subsequence.
coin_change = _each(_coins, "int")
subset_sum = _each(_subset, "boolean")


def longest_rising(numbers: Column) -> Column:
    return _each(_rising, "int")(numbers, F.lit(0))


@vectorized("double")
def knapsack(weights: pd.Series, values: pd.Series, capacity: pd.Series) -> pd.Series:
    """The greatest value of items within whole weights, each used once."""

    def one(w, v, c) -> float:
        best = np.zeros(int(c) + 1)
        for a, b in zip(w, v):
            if a <= c:
                best[a:] = np.maximum(best[a:], best[: len(best) - a] + b)
        return float(best[-1])

    return pd.Series([None if w is None else one(w, v, c) for w, v, c in zip(weights, values, capacity)])


@vectorized("long")
def matrix_chain(sizes: pd.Series) -> pd.Series:
    """The fewest multiplications for a chain of matrices of neighbouring sizes."""

    def one(d) -> int:
        n = len(d) - 1
        best = [[0] * n for _ in range(n)]
        for span in range(1, n):
            for i in range(n - span):
                best[i][i + span] = min(best[i][k] + best[k + 1][i + span] + int(d[i]) * int(d[k + 1]) * int(d[i + span + 1]) for k in range(i, i + span))
        return best[0][-1] if n > 0 else 0

    return pd.Series([None if d is None else one(d) for d in sizes])


def spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic spline through the points."""
    n = len(xs)
    if n < 3:
        return np.interp(at, xs, ys)
    h = np.diff(xs)
    m = np.zeros((n, n))
    r = np.zeros(n)
    m[0, 0] = m[-1, -1] = 1
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 3 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    c = np.linalg.solve(m, r)
    i = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    b = (ys[i + 1] - ys[i]) / h[i] - h[i] * (2 * c[i] + c[i + 1]) / 3
    d = (c[i + 1] - c[i]) / (3 * h[i])
    t = at - xs[i]
    return ys[i] + b * t + c[i] * t**2 + d * t**3


@vectorized("array<double>")
def cubic_spline(xs: pd.Series, ys: pd.Series, at: pd.Series) -> pd.Series:
    """Values at ``at`` of the natural cubic spline through the points."""
    return pd.Series([None if x is None else spline(np.asarray(x, float), np.asarray(y, float), np.asarray(z, float)).tolist() for x, y, z in zip(xs, ys, at)])


def _haar(x: np.ndarray) -> np.ndarray:
    out, n = x.copy(), len(x)
    while n > 1:
        a = out[:n].copy()
        out[: n // 2], out[n // 2 : n] = (a[::2] + a[1::2]) / np.sqrt(2), (a[::2] - a[1::2]) / np.sqrt(2)
        n //= 2
    return out


def _unhaar(x: np.ndarray) -> np.ndarray:
    out, n = x.copy(), 2
    while n <= len(x):
        a, d = out[: n // 2].copy(), out[n // 2 : n].copy()
        out[:n:2], out[1:n:2] = (a + d) / np.sqrt(2), (a - d) / np.sqrt(2)
        n *= 2
    return out


@vectorized("array<double>")
def denoise(signal: pd.Series, threshold: pd.Series) -> pd.Series:
    """The signal without wavelet coefficients under the threshold; its length is padded with zeros to a power of two and cut back."""

    def one(s, t) -> list[float]:
        x = np.zeros(1 << max(0, (len(s) - 1).bit_length()))
        x[: len(s)] = s
        c = _haar(x)
        c[1:][np.abs(c[1:]) < t] = 0
        return _unhaar(c)[: len(s)].tolist()

    return pd.Series([None if s is None else one(s, t) for s, t in zip(signal, threshold)])


def bezier(points: list[Column], t: Column) -> Column:
    """A point of the curve with these control values, by de Casteljau's steps."""
    while len(points) > 1:
        points = [a + (b - a) * t for a, b in zip(points, points[1:])]
    return points[0]


def quaternion_multiply(a: Column, b: Column) -> Column:
    """Of struct<x, y, z, w>."""
    return F.struct(
        (a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"]).alias("y"),
        (a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"]).alias("z"), (a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"]).alias("w"),
    )


def estimate_pi(spark: SparkSession, samples: int, seed: int = 1) -> DataFrame:
    """By the share of random points in a quarter of a circle, drawn in parallel."""
    p = spark.range(samples).select(F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))
    return p.agg((4 * F.avg(F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1, 1.0).otherwise(0.0))).alias("pi"))


def integrate(spark: SparkSession, expression: str, low: float, high: float, samples: int, seed: int = 1) -> DataFrame:
    """The mean of an expression in x at random places, times the width."""
    from .expressions import compile_expression

    x = spark.range(samples).select((low + F.rand(seed) * (high - low)).alias("x"))
    return x.agg((F.avg(compile_expression(expression, {"x": F.col("x")})) * (high - low)).alias("integral"))
