import math

import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregates as agg
from brindle.operators import sketches, windows


@pytest.fixture
def numbers(spark):
    return lambda xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "ord int, x double")


def one(df, c):
    return df.agg(c.alias("v")).first().v


def test_spread(numbers):
    df = numbers([2, 4, 4, 4, 5, 5, 7, 9])
    assert one(df, agg.stddev("x", True)) == 2.0 and one(df, agg.variance("x")) == pytest.approx(32 / 7)
    assert [r.mode for r in agg.modes(df, "x").collect()] == [4.0]
    assert [r.mode for r in agg.modes(numbers([1, 1, 2, 2, 3]), "x").collect()] == [1.0, 2.0]
    assert one(df, agg.value_range("x")) == 7


def test_shape(numbers):
    xs = [1, 2, 2, 3, 9]
    df, m = numbers(xs), sum(xs) / 5
    m2, m3, m4 = (sum((x - m) ** k for x in xs) / 5 for k in (2, 3, 4))
    g1 = m3 / m2**1.5
    assert one(df, agg.skewness("x")) == pytest.approx(g1) and one(df, agg.skewness_adjusted("x")) == pytest.approx(g1 * 25 / 12)
    assert one(df, agg.kurtosis("x")) == pytest.approx(m4 / m2**2 - 3)


def test_quantiles(numbers):
    df = numbers([5, 3, 1, 4, 2])
    assert one(df, agg.quantile("x", 0.5)) == 3 and one(df, agg.iqr("x")) == 2 and one(df, agg.percentile("x", 150)) == 5
    assert one(numbers(range(1, 11)), agg.quantile("x", 0.25)) == 3.25
    assert one(df, agg.percentile_rank("x", 3)) == 60
    assert agg.nearest_rank(numbers(range(1, 11)), "x", 0.95).first().value == 10
    with pytest.raises(ValueError):
        agg.quantile("x", 1.1)
    with pytest.raises(agg.EmptyInput):
        agg.require_rows(df.limit(0), "x")


def test_outliers_and_histogram(numbers):
    assert [r.x for r in agg.outliers(numbers([1, 2, 3, 4, 5, 100]), "x").collect()] == [100]
    assert agg.outliers(numbers([1, 2, 3, 4, 5, 100]), "x", keep=True).count() == 5
    h = agg.histogram(numbers(range(1, 9)), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2] and h[0].lower == 1 and h[-1].upper == 8
    assert [r["count"] for r in agg.histogram(numbers([3, 3]), "x", 3).orderBy("bin").collect()] == [2, 0, 0]
    assert agg.histogram(numbers([]), "x", 3).count() == 0


def test_pairs(spark, numbers):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    r = df.agg(*agg.linear_regression("x", "y")).first()
    assert (r.slope, r.intercept, r.r2) == (2, 0, 1)
    assert math.isnan(one(df.withColumn("y", F.lit(1.0)), agg.pearson("x", "y"))) and one(df.withColumn("y", F.lit(1.0)), agg.pearson("x", "y", 0.0)) == 0
    s = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (2.0, 20.0), (5.0, 99.0)], "x double, y double")
    assert agg.spearman(s, "x", "y").first().spearman == pytest.approx(0.9486832980505138)
    assert agg.trend(numbers([1, 2, 3]), "x", "ord").first().trend == "increasing" and agg.trend(numbers([2, 2]), "x", "ord").first().trend == "flat"


def test_normal(numbers):
    df = numbers([0, 1.96, -1])
    got = [r.v for r in df.orderBy("ord").select(agg.normal_cdf(F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([0.5, 0.9750021, 0.1586553], abs=2e-7)


def test_moving_averages(spark):
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5])], "k string, i int, x double")
    values = lambda out, c: [r[c] for r in out.orderBy("i").collect()]
    assert values(windows.sma(df, "x", 3, ["k"], ["i"]), "sma") == [2, 3, 4]
    assert values(windows.wma(df, "x", 3, ["k"], ["i"]), "wma") == pytest.approx([14 / 6, 20 / 6, 26 / 6])
    assert values(windows.ema(df, "x", 0.5, ["k"], ["i"]), "ema") == [1, 1.5, 2.25, 3.125, 4.0625]
    assert values(windows.sma(df, "x", 9, ["k"], ["i"]), "sma") == []
    b = windows.bollinger(df, "x", 5, ["k"], ["i"]).first()
    assert (b.middle, b.upper) == (3, pytest.approx(3 + 2 * math.sqrt(2)))
    r = windows.rsi(df, "x", ["k"], ["i"], 3)
    assert [x.rsi for x in r.collect()] == [100, 100]
    assert sorted((x.i, x.running) for x in windows.cumulative(df, "x", "i").collect()) == [(0, 1), (1, 3), (2, 6), (3, 10), (4, 15)]
    assert windows.ema(df.limit(0), "x", 0.5, ["k"], ["i"]).count() == 0


def test_rsi_by_hand(spark):
    xs = [44.0, 44.5, 43.9, 44.2, 44.9, 44.4, 45.1]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    d = [b - a for a, b in zip(xs, xs[1:])]
    g, lo = sum(max(x, 0) for x in d[:3]) / 3, sum(max(-x, 0) for x in d[:3]) / 3
    want = [100 - 100 / (1 + g / lo)]
    for x in d[3:]:
        g, lo = (g * 2 + max(x, 0)) / 3, (lo * 2 + max(-x, 0)) / 3
        want.append(100 - 100 / (1 + g / lo))
    assert [r.rsi for r in windows.rsi(df, "x", ["k"], ["i"], 3).orderBy("i").collect()] == pytest.approx(want)


def test_sketches(spark):
    df = spark.range(5000).selectExpr("id % 1000 as k", "id")
    parts = df.groupBy((F.col("id") % 4).alias("p")).agg(sketches.distinct_sketch("k").alias("s"))
    assert abs(parts.agg(sketches.merged_distinct("s").alias("n")).first().n - 1000) < 50
    with pytest.raises(ValueError):
        sketches.distinct_sketch("k", 3)
    cm = sketches.count_min_table(df, "k")
    assert all(r.estimate >= 5 for r in sketches.count_min_lookup(df.select("k").distinct(), cm, "k").collect())
    assert sketches.count_min_lookup(spark.createDataFrame([(-1,)], "k long"), cm, "k").first().estimate <= 20
    bloom = sketches.bloom_table(df.select("k").distinct(), "k", 1000)
    assert all(r.maybe for r in sketches.bloom_has(df.select("k").distinct(), bloom, "k", 1000).collect())
    false = sketches.bloom_has(spark.range(2000, 4000).withColumnRenamed("id", "k"), bloom, "k", 1000).where("maybe").count()
    assert false < 80
    assert sketches.reservoir(df, 10, 3, "id").collect() == sketches.reservoir(df.repartition(7), 10, 3, "id").collect()
    many = sketches.weighted_reservoir(spark.range(1000).selectExpr("id", "if(id < 100, 100.0, 1.0) as w"), "w", 50, 1, "id")
    assert many.where("id < 100").count() > 30
    before = {r.id: r.n for r in spark.range(500).select("id", sketches.ring_node(F.col("id"), ["a", "b", "c"]).alias("n")).collect()}
    after = {r.id: r.n for r in spark.range(500).select("id", sketches.ring_node(F.col("id"), ["a", "b", "c", "d"]).alias("n")).collect()}
    assert set(before.values()) == {"a", "b", "c"} and all(after[i] in (before[i], "d") for i in before)
    root = sketches.merkle_root(spark.range(5).selectExpr("id", "cast(id as string) as v"), "v", "id")
    assert len(root) == 64 and root != sketches.merkle_root(spark.range(6).selectExpr("id", "cast(id as string) as v"), "v", "id")
