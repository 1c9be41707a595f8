"""Caches, topics, snapshots, schedules and other keyed state as relations over logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .windows import fold


def live_entries(log: DataFrame, key: str, ts: str, now: Column, ttl: Column, *tie: str, gone: Column | None = None) -> DataFrame:
    """The last row of each key that is not past ``ttl`` (of the units of ``ts``) at ``now``, nor a removal (``gone``); rows after ``now`` do not count."""
    last = log.withColumns({"_ttl": ttl, "_gone": F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)}).where(F.col(ts) <= now)
    order = F.struct(ts, *tie)
    row = last.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")
    return row.where(~F.col("_gone") & (now < F.col(ts) + F.col("_ttl"))).drop("_ttl", "_gone")


def recent_keys(accesses: DataFrame, key: str, capacity: int, *ord: str) -> DataFrame:
    """The keys that a cache of ``capacity`` holds after all accesses if it drops the least recently used, with place (1: the last used) and uses. Each task keeps ``capacity``."""
    last = accesses.groupBy(key).agg(F.max(F.struct(*ord)).alias("_last"), F.count(F.lit(1)).alias("uses"))
    top = last.orderBy(F.desc("_last"), key).limit(capacity)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_last"), key))).select(key, "place", "uses")  # capacity rows


def frequent_keys(accesses: DataFrame, key: str, capacity: int, *ord: str) -> DataFrame:
    """The ``capacity`` most used keys, of those alike the last used."""
    last = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("uses"), F.max(F.struct(*ord)).alias("_last"))
    return last.orderBy(F.desc("uses"), F.desc("_last"), key).limit(capacity).select(key, "uses")


def delivered(messages: DataFrame, subscriptions: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """A row for each message and subscription whose pattern fits its topic: equal, ``*`` for all, or ``a.*`` for all under ``a``.

    Each topic is cut to the patterns that fit it, and these are equi-joined; so no topic meets every subscription.
    """
    parts = F.split(topic, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n - 1), "."), F.when(n > 1, F.lit(".*")).otherwise(F.lit("*"))))
    named = messages.withColumn("_fits", F.explode(F.array_distinct(F.concat(F.array(topic), above))))
    return named.join(subscriptions, F.col("_fits") == F.col(pattern)).drop("_fits")


def state_at(log: DataFrame, key: str, field: str, value: str, version: str, at: Column) -> DataFrame:
    """key, field and value of each field's last change up to version ``at``."""
    return log.where(F.col(version) <= at).groupBy(key, field).agg(F.max_by(value, version).alias(value))


def state_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, old, new and change (added, removed, changed) between two states; equal values give no row."""
    both = before.withColumnRenamed(value, "old").withColumn("_b", F.lit(True)).join(after.withColumnRenamed(value, "new").withColumn("_a", F.lit(True)), list(keys), "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "old", "new", "change")


def saga_steps(steps: DataFrame, saga: str, ord: str, ok: Column) -> DataFrame:
    """Each step of each saga with outcome: done, or failed at its first that is not ok; those before it are then compensated, those after it skipped. undo: the place of its compensation, last step first."""
    failed = steps.where(~F.coalesce(ok, F.lit(False))).groupBy(saga).agg(F.min(ord).alias("_failed"))
    rows = steps.join(failed, saga, "left")
    outcome = F.when(F.col("_failed").isNull(), "done").when(F.col(ord) == F.col("_failed"), "failed").when(F.col(ord) < F.col("_failed"), "compensated").otherwise("skipped")
    w = Window.partitionBy(saga, "outcome").orderBy(F.desc(ord))
    return rows.withColumn("outcome", outcome).withColumn("undo", F.when(F.col("outcome") == "compensated", F.row_number().over(w))).drop("_failed")


def range_blocks(df: DataFrame, at: str, value: str, levels: int) -> DataFrame:
    """Least, greatest and sum of every aligned block of 2 ** level places, for all levels: level, block, low, high, total. Places are numbers from 0."""
    out = df.select(F.lit(0).alias("level"), F.col(at).cast("long").alias("block"), F.col(value).alias("low"), F.col(value).alias("high"), F.col(value).alias("total"))
    explode = df.select(F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), F.col(at).cast("long").alias("p"), F.col(value).alias("v")) if levels else None
    if explode is None:
        return out
    up = explode.groupBy("level", F.expr("shiftright(p, level)").alias("block")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))
    return out.unionAll(up)


def range_aggregates(queries: DataFrame, blocks: DataFrame, id: str, first: str, last: str, levels: int) -> DataFrame:
    """Least, greatest and sum of the places ``first`` to ``last`` of each query: the range is cut into aligned blocks, two of a level at most, which are equi-joined."""
    steps = F.expr(
        f"""aggregate(sequence(0, {levels}), named_struct('a', cast({first} as bigint), 'z', cast({last} as bigint) + 1, 'out', cast(array() as array<struct<level: int, block: bigint>>)),
        (s, k) -> if(s.a >= s.z, s, if(k = {levels},
            named_struct('a', s.z, 'z', s.z, 'out', concat(s.out, transform(sequence(s.a, s.z - 1), b -> named_struct('level', k, 'block', b)))),
            named_struct('a', (s.a + 1) div 2, 'z', s.z div 2, 'out', concat(s.out,
                if(s.a % 2 = 1, array(named_struct('level', k, 'block', s.a)), array()), if(s.z % 2 = 1 and s.z - 1 >= (s.a + s.a % 2), array(named_struct('level', k, 'block', s.z - 1)), array()))))))"""
    )
    cut = queries.select(id, F.explode(steps["out"]).alias("x")).select(id, "x.level", "x.block")
    return cut.join(blocks, ["level", "block"]).groupBy(id).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


def places(sorted_rows: DataFrame, value: str, probes: DataFrame, probe: str) -> DataFrame:
    """For each probe the number of values under it (the first place where it could stand) and under or equal to it (the last)."""
    counts = sorted_rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_p"))
    both = counts.unionAll(probes.select(F.col(probe).alias("_v"), F.lit(0).cast("long"), F.lit(1)).distinct()).groupBy("_v").agg(F.sum("_n").alias("_n"), F.max("_p").alias("_p"))
    from .windows import cumulative

    run = cumulative(both.where("_v is not null"), "_n", "_v", "_to")
    return run.where("_p = 1").select(F.col("_v").alias(probe), (F.col("_to") - F.col("_n")).cast("long").alias("first"), F.col("_to").cast("long").alias("last"))


def with_components(parts: DataFrame, entity: str, name: str, needed: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """The entities that have all components ``needed`` and none of ``without``, by one aggregation."""
    has = parts.where(F.col(name).isin(*needed, *without)).groupBy(entity).agg(F.collect_set(name).alias("_has"))  # as many as are named
    return has.where((F.size(F.array_intersect("_has", F.lit(list(needed)))) == len(set(needed))) & (F.size(F.array_intersect("_has", F.array(*[F.lit(x) for x in without]))) == 0 if without else F.lit(True))).select(entity)


def dense(sparse: DataFrame, at: str, value: str, size: int, zero=0) -> DataFrame:
    """All places 0 to size - 1, with ``zero`` where the sparse rows have none."""
    all_places = sparse.sparkSession.range(size).withColumnRenamed("id", at)
    return all_places.join(sparse.select(F.col(at).cast("long").alias(at), value), at, "left").select(at, F.coalesce(value, F.lit(zero)).alias(value))


def scheduled(tasks: DataFrame, group: str, seconds: str, *ord: str) -> DataFrame:
    """start and end of each task of each group's queue, one after another in order; a fold that streams."""

    def step(at, x: float):
        begin = at or 0.0
        return begin + x, (begin, begin + x)

    return fold(tasks, [group], list(ord), [seconds], None, step, ["start", "end"], DoubleType())


def piped(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after another."""
    for s in steps:
        df = s(df)
    return df


def wrapped(step: Callable[[DataFrame], DataFrame], *around: Callable) -> Callable[[DataFrame], DataFrame]:
    """``step`` within middleware: each takes the frame and the next step; the first is outermost."""
    for a in reversed(around):
        step = (lambda a, inner: lambda df: a(df, inner))(a, step)
    return step


def memoized(df: DataFrame, keys: Sequence[str], name: str, costly: Callable[[DataFrame], Column]) -> DataFrame:
    """``df`` with ``name``, computed once for each distinct ``keys`` and joined back, null keys included."""
    once = df.select(*keys).distinct()
    once = once.withColumn(name, costly(once)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(once, match, "left").drop(*[f"_k{i}" for i in range(len(keys))])
