"""Approximate aggregates and samplers: mergeable sketches as DataFrame aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sketch(c: str, precision: int = 12) -> Column:
    """A mergeable distinct-count sketch, precision 4 to 16."""
    if not 4 <= precision <= 16:
        raise ValueError("precision must be 4 to 16")
    return F.hll_sketch_agg(c, precision)


def merged_distinct(sketch: str) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def count_min(c: str, epsilon: float = 0.001, confidence: float = 0.99, seed: int = 1) -> Column:
    return F.count_min_sketch(F.col(c), F.lit(epsilon), F.lit(confidence), F.lit(seed))


def count_min_table(df: DataFrame, key: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """The sketch as rows (row, cell, n): merging two is a union and a sum, and keys are looked up by a join."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("row"), F.pmod(F.xxhash64(F.col(key).cast("string"), d), F.lit(width)).alias("cell")))
    return df.select(F.explode(cells).alias("x")).groupBy("x.row", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def count_min_lookup(keys: DataFrame, sketch: DataFrame, key: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """Estimates, never too low: the least of a key's cells, 0 where one is empty."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("row"), F.pmod(F.xxhash64(F.col(key).cast("string"), d), F.lit(width)).alias("cell")))
    return keys.select(key, F.explode(cells).alias("x")).select(key, "x.*").join(sketch, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom_size(expected: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for a number of items and a rate of false positives."""
    bits = max(8, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(expected, 1) * math.log(2)))


def _positions(key: str, bits: int, hashes: int) -> Column:
    a, b = F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.xxhash64(F.col(key).cast("string"), F.lit(2))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.expr("0L") + F.pmod(a, F.lit(1 << 40)) + i * F.pmod(b, F.lit(1 << 20)), F.lit(bits)))


def bloom_table(df: DataFrame, key: str, expected: int, rate: float = 0.01) -> DataFrame:
    """The set bits with how often each was set, so that items can be taken out again: bit, n."""
    bits, hashes = bloom_size(expected, rate)
    return df.select(F.explode(F.array_distinct(_positions(key, bits, hashes))).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


def bloom_has(keys: DataFrame, bloom: DataFrame, key: str, expected: int, rate: float = 0.01) -> DataFrame:
    """key, maybe: false only for keys that were never added."""
    bits, hashes = bloom_size(expected, rate)
    at = keys.select(key, F.array_distinct(_positions(key, bits, hashes)).alias("at"))
    found = at.select(key, F.size("at").alias("need"), F.explode("at").alias("bit")).join(bloom.where("n > 0").select("bit", F.lit(1).alias("set")), "bit", "left")
    return found.groupBy(key).agg((F.count("set") >= F.max("need")).alias("maybe"))


def top_items(df: DataFrame, c: str, k: int) -> DataFrame:
    """Exact heaviest items: counts combine before the shuffle, and each task keeps k."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), c).limit(k)


def reservoir(df: DataFrame, k: int, seed: int = 1, *key: str) -> DataFrame:
    """A uniform sample of k rows: the least hashes of seed and key, the same in every run; without key columns, random."""
    mark = F.xxhash64(F.lit(seed), *[F.col(c) for c in key]) if key else F.rand(seed)
    return df.orderBy(mark, *key).limit(k)


def weighted_reservoir(df: DataFrame, weight: str, k: int, seed: int = 1, *key: str) -> DataFrame:
    """k rows without replacement with chances by weight: the largest u ** (1 / w)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) if key else F.rand(seed)
    return df.where(F.col(weight) > 0).orderBy((F.log(u) / F.col(weight)).desc(), *key).limit(k)


def ring_node(key: Column, nodes: Sequence[str], replicas: int = 64) -> Column:
    """Consistent hashing: the node of the first point at or after the key's. The ring is a constant of nodes x replicas points."""
    import zlib

    points = sorted((zlib.crc32(f"{n}#{i}".encode()), n) for n in nodes for i in range(replicas))
    at = F.crc32(key.cast("string").cast("binary"))
    ring = F.array(*[F.lit(p) for p, _ in points])
    i = F.size(F.filter(ring, lambda p: p < at))
    return F.element_at(F.array(*[F.lit(n) for _, n in points]), F.pmod(i, F.lit(len(points))) + 1)


def rendezvous_node(key: Column, nodes: Sequence[str]) -> Column:
    """Highest random weight: the node whose hash with the key is greatest."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(key.cast("string"), F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in nodes]))["n"]


def rendezvous_nodes(key: Column, nodes: Sequence[str], count: int) -> Column:
    ranked = F.sort_array(F.array(*[F.struct(F.xxhash64(key.cast("string"), F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in nodes]), asc=False)
    return F.transform(F.slice(ranked, 1, count), lambda x: x["n"])


def merkle_root(df: DataFrame, value: str, ord: str) -> str | None:
    """Root over the rows in order: level by level, pairs hashed together, an odd last node with itself. Each level is an aggregation half the size."""
    from .order import global_index

    level = global_index(df.select(ord, F.sha2(F.col(value).cast("string"), 256).alias("h")), ord, name="i").select("i", "h")
    n = level.count()
    if not n:
        return None
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        level = pair.select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))
        n = (n + 1) // 2
        if n <= 4096:  # few enough to end in one aggregation each
            level = level.coalesce(1)
    return level.first()["h"]
