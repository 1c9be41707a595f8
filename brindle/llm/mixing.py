"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n rows and target weight w gets the mean repetition rate w * total / n.
Each row draws its count by inverting the Poisson distribution of that mean at a
uniform number made from a hash of the seed and its doc_id, and is exploded into so
many copies, which are dealt out and ordered by a hash: the global shuffle.

The distribution is held as its cumulated terms around the mode, twelve deviations to
either side, each made from its neighbour's and all divided by their sum; so a rate of
any size is inverted as it is, and nothing underflows.

The rates stand in a table of one row for each source that is joined on by Spark's own
choice: sent to all tasks if its measured size allows it, else by shuffle, where a hot
source is split at run time.

Defined results: a null source is a source of its own. A source without a given weight
has weight 0 and is left out. Rows that repeat a doc_id draw the same count, each for
itself; a null doc_id draws as the text 'null'. A null or empty text is replicated like
any other. Empty tables give no rows. Columns of the input named copy or shuffle_key are
replaced by those of the result; all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named

SEED = "brindle"


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1): the first 52 bits of an MD5, hash-seeded, alike in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(rate: str) -> Column:
    """The Poisson distribution of the mean named, as low and cdf: the chances of low at most, low + 1 at most, and so on."""
    most, low = f"floor({rate})", f"greatest(0, floor({rate} - 12 * sqrt({rate}) - 25))"
    down = f"aggregate(sequence(0, cast({most} - {low} as int)), array(double(1)), (s, i) -> if(i = 0, s, concat(s, array(element_at(s, -1) * ({most} - i + 1) / {rate}))))"
    up = f"aggregate(sequence(0, cast(ceil(12 * sqrt({rate}) + 25) as int)), array(double(1)), (s, i) -> if(i = 0, s, concat(s, array(element_at(s, -1) * {rate} / ({most} + i)))))"
    terms = f"concat(reverse({down}), slice({up}, 2, 1000000000))"
    sums = f"aggregate({terms}, cast(array() as array<double>), (s, p) -> concat(s, array(coalesce(try_element_at(s, -1), double(0)) + p)))"
    return F.expr(f"transform(array({sums}), s -> named_struct('low', cast({low} as bigint), 'cdf', transform(s, c -> c / element_at(s, -1))))[0]")


def rates(docs: DataFrame, weights: DataFrame | None, size: float, alpha: float) -> DataFrame:
    """src, rate, low and cdf (the Poisson distribution function from low on) of each source.

    weights: (source, weight); without them, the weight is the row count to the power ``alpha``.
    size: wanted rows as a multiple of those there are.
    """
    by = docs.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        by = by.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").cast("double").alias("w"))
        by = by.join(given, F.col("src").eqNullSafe(F.col("given"))).where("w > 0").drop("given")
    sums = by.agg(F.struct(F.sum("n").alias("n"), F.sum("w").alias("w"))).scalar()
    all_rows = docs.agg(F.count(F.lit(1)).cast("double")).scalar() if weights is not None else sums["n"]
    by = by.withColumn("rate", F.col("w") / sums["w"] * all_rows * size / F.col("n"))
    return by.withColumn("d", distribution("rate")).select("src", "rate", "d.low", "d.cdf")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, size: float = 1.0, alpha: float = 0.7, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source and others) by their counts, with copy (from 0) and shuffle_key, dealt out and sorted by the key."""
    docs = docs.drop("copy", "shuffle_key")
    src, low, cdf, draw, n = fresh(docs, "_src", "_low", "_cdf", "_draw", "_n")
    table = rates(docs, weights, size, alpha).select(F.col("src").alias(src), F.col("low").alias(low), F.col("cdf").alias(cdf))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col(src))).withColumn(draw, uniform(key, seed))
    drawn = drawn.withColumn(n, F.col(low).cast("int") + F.size(F.filter(cdf, lambda c: c <= F.col(draw)))).where(F.col(n) > 0)
    out = drawn.select(*named(docs.columns), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string")).cast("binary")))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
