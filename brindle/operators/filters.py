"""Membership filters with fingerprints: one that items can be taken out of, and a static one of three places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(key: str, buckets: int, bits: int) -> tuple[Column, Column]:
    """The smaller of a key's two buckets, each the other's by the fingerprint, and the fingerprint. buckets: a power of two."""
    print_ = (F.pmod(F.xxhash64(F.lit("print"), key), F.lit((1 << bits) - 1)) + 1).alias("print")
    one = F.xxhash64(key).bitwiseAND(F.lit(buckets - 1))
    return F.least(one, one.bitwiseXOR(F.xxhash64(print_).bitwiseAND(F.lit(buckets - 1)))).alias("bucket"), print_


def cuckoo_table(df: DataFrame, key: str, expected: int, bits: int = 16) -> DataFrame:
    """bucket, print and n, how often it was added. A pair of buckets is held under its smaller one, so nothing is ever moved."""
    return df.select(*_places(key, 1 << max(1, (2 * expected - 1).bit_length()), bits)).groupBy("bucket", "print").agg(F.count(F.lit(1)).alias("n"))


def cuckoo_without(table: DataFrame, gone: DataFrame) -> DataFrame:
    """``table`` after the items of the table ``gone`` were taken out, once for each time they are in it."""
    left = table.unionAll(gone.select("bucket", "print", -F.col("n"))).groupBy("bucket", "print").agg(F.sum("n").alias("n"))
    return left.where("n > 0")


def cuckoo_has(keys: DataFrame, table: DataFrame, key: str, expected: int, bits: int = 16) -> DataFrame:
    """key and maybe: false only for keys that are not in it."""
    at = keys.select(key, *_places(key, 1 << max(1, (2 * expected - 1).bit_length()), bits))
    return at.join(table.select("bucket", "print", F.lit(True).alias("_in")), ["bucket", "print"], "left").select(key, F.coalesce("_in", F.lit(False)).alias("maybe"))


def _three(h: np.ndarray, seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places of each hash, one in each third, and its fingerprint of eight bits."""
    with np.errstate(over="ignore"):
        x = (h.astype(np.uint64) ^ np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    third = size // 3
    at = [((x >> np.uint64(s)) & np.uint64(0xFFFFF)).astype(np.int64) % third + i * third for i, s in enumerate((0, 20, 40))]
    return np.stack(at), ((x >> np.uint64(56)) & np.uint64(255)).astype(np.uint8)


def _built(h: np.ndarray) -> tuple[int, bytes]:
    """A seed, and a table in which the three places of each hash give its fingerprint by exclusive or."""
    n = len(h)
    size = 3 * (int(1.23 * n) // 3 + 11)
    for seed in range(1000):
        at, prints = _three(h, seed, size)
        count, mixed = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in at:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(mixed, row, np.arange(n))
        alone, order = list(np.flatnonzero(count == 1)), []
        while alone:
            p = alone.pop()
            if count[p] != 1:
                continue
            k = int(mixed[p])
            order.append((k, p))
            for q in at[:, k]:
                count[q] -= 1
                mixed[q] ^= k
                if count[q] == 1:
                    alone.append(q)
        if len(order) == n:
            table = np.zeros(size, np.uint8)
            for k, p in reversed(order):
                table[p] = prints[k] ^ np.bitwise_xor.reduce(table[at[:, k]]) ^ table[p]
            return seed, table.tobytes()
    raise RuntimeError("no seed serves")


def xor_filter(df: DataFrame, key: str, shards: int) -> DataFrame:
    """shard, seed and data: a static filter for the distinct keys of each of so many shards, some 1.23 bytes a key. A shard is built in one task: choose shards so that it has a million keys at most."""
    keys = df.select(F.xxhash64(key).alias("h")).distinct().withColumn("shard", F.pmod(F.hash("h"), F.lit(shards)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        seed, data = _built(rows["h"].to_numpy())
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "seed": [seed], "data": [data]})

    return keys.groupBy("shard").applyInPandas(build, "shard int, seed int, data binary")


def xor_has(keys: DataFrame, made: DataFrame, key: str, shards: int) -> DataFrame:
    """key and maybe: false only for keys that are not in the filter."""

    def found(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(table):
            return pd.DataFrame({"k": rows["k"], "maybe": False})
        t = np.frombuffer(table["data"].iloc[0], np.uint8)
        at, prints = _three(rows["h"].to_numpy(), int(table["seed"].iloc[0]), len(t))
        return pd.DataFrame({"k": rows["k"], "maybe": np.bitwise_xor.reduce(t[at], axis=0) == prints})

    asked = keys.select(F.col(key).alias("k"), F.xxhash64(key).alias("h")).withColumn("shard", F.pmod(F.hash("h"), F.lit(shards)))
    kind = keys.schema[key].dataType.simpleString()
    return asked.groupBy("shard").cogroup(made.groupBy("shard")).applyInPandas(found, f"k {kind}, maybe boolean").withColumnRenamed("k", key)
