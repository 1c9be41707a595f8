"""Numeric scalars, number theory, vectors and matrices as arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectorized import vectorized


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return a + (b - a) * t


def inverse_lerp(a: Column, b: Column, x: Column) -> Column:
    return F.when(a == b, 0.0).otherwise((x - a) / (b - a))


def map_range(x: Column, in_low: float, in_high: float, out_low: float, out_high: float) -> Column:
    return out_low + (x - in_low) * (out_high - out_low) / (in_high - in_low)


def round_to(x: Column, digits: int = 0) -> Column:
    """Halves go up, negative ones too: -2.5 becomes -2."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def floor_to(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits) / 10.0**digits


def ceil_to(x: Column, digits: int) -> Column:
    return F.ceil(x * 10.0**digits) / 10.0**digits


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, 96 of them, which is enough for any two longs."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step)["a"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(a).cast("long") / F.nullif(g, F.lit(0).cast("long"))).cast("long") * F.abs(b).cast("long"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n.cast("long")) == 1)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long"))


def is_prime(n: Column) -> Column:
    """By trial division up to the root; for n up to about 10**10."""
    root = F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("long"), F.lit(2).cast("long"))
    return (n >= 2) & ~F.exists(F.sequence(F.lit(2).cast("long"), root), lambda d: (n % d == 0) & (d < n))


def primes_up_to(spark, limit: int) -> DataFrame:
    """Primes as rows, tested in parallel."""
    return spark.range(2, limit + 1).withColumnRenamed("id", "n").where(is_prime(F.col("n")))


@vectorized("array<long>")
def prime_factors(n: pd.Series) -> pd.Series:
    def one(x: int) -> list[int]:
        out, d = [], 2
        while d * d <= x:
            while x % d == 0:
                out.append(d)
                x //= d
            d += 1 + (d > 2)
        return out + ([x] if x > 1 else [])

    return pd.Series([None if pd.isna(x) else one(int(x)) for x in n])


def factorial(n: Column) -> Column:
    return F.factorial(n)


def choose(n: Column, r: Column) -> Column:
    """Binomial coefficient, by a product that stays whole; 0 out of range."""
    k = F.least(r, n - r)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    product = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda acc, i: ((acc * (n - k + i)) / i).cast("decimal(38,0)"))
    return F.when((r < 0) | (r > n), F.lit(0).cast("decimal(38,0)")).otherwise(product)


# fixed values: the numbers of the roman numerals
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def to_roman(n: Column) -> Column:
    """Null outside 1 to 3999."""
    out, rest = F.lit(""), n.cast("int")
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), out)


def from_roman(s: Column) -> Column:
    """Null for texts that are no numeral."""
    valid = F.upper(s).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (s != "")
    one = F.create_map(*[F.lit(x) for v, k in ROMAN if len(k) == 1 for x in (k, v)])
    values = F.transform(F.split(F.upper(s), ""), lambda c: F.coalesce(one[c], F.lit(0)))
    pairs = F.zip_with(values, F.concat(F.slice(values, 2, 1 << 20), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(valid, F.aggregate(pairs, F.lit(0), lambda a, b: a + b))


def format_compact(x: Column, digits: int = 1) -> Column:
    """1.5K, 2M, 3.1B, 1T."""
    out = round_to(x, digits).cast("string")
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= size, F.concat(F.regexp_replace(round_to(x / size, digits).cast("string"), r"\.0$", ""), F.lit(unit))).otherwise(out)
    return F.regexp_replace(out, r"\.0$", "")


def format_bytes(n: Column, digits: int = 2) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.regexp_replace(round_to(n / 1024.0**i, digits).cast("string"), r"\.0$", ""), F.lit(f" {unit}"))).otherwise(out)
    return out


def ordinal(n: Column) -> Column:
    t, u = n % 100, n % 10
    return F.concat(n.cast("long").cast("string"), F.when(t.between(11, 13), "th").when(u == 1, "st").when(u == 2, "nd").when(u == 3, "rd").otherwise("th"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """A zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def cross(a: Column, b: Column) -> Column:
    x, y = [a[i] for i in range(3)], [b[i] for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def polynomial(coefficients: Column, x: Column) -> Column:
    """Coefficients by rising power; Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse (row, col, value) matrices: a join on the inner index and a sum."""
    x = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value")).where("value <> 0")


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def matrix_scale(a: DataFrame, k: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * k).where("value <> 0")


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def matrix_trace(a: DataFrame) -> DataFrame:
    return a.where("row = col").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("trace"))


def _dense(fn, kind: str):
    @vectorized(kind)
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(np.array([np.asarray(r, float) for r in x])) for x in m])

    return run


def _inverse(m: np.ndarray):
    return None if m.shape[0] != m.shape[1] or abs(np.linalg.det(m)) < 1e-12 else np.linalg.inv(m).tolist()


#: Of a dense matrix in one value, an array of rows.
determinant = _dense(lambda m: float(np.linalg.det(m)), "double")
inverse = _dense(_inverse, "array<array<double>>")
rank = _dense(lambda m: int(np.linalg.matrix_rank(m)), "int")


@vectorized("array<double>")
def fft_magnitudes(signal: pd.Series) -> pd.Series:
    """Of the signal padded with zeros to a power of two."""
    def one(x) -> list[float]:
        n = 1 << max(0, (len(x) - 1).bit_length())
        return np.abs(np.fft.fft(np.asarray(x, float), n)).tolist()

    return pd.Series([None if x is None else one(x) for x in signal])


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)
