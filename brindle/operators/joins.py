"""Joins with explicit rules: nulls are keys that join, and the right side wins where names collide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(joined: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Left columns but for those that the right has too, then all right ones."""
    return joined.select(*[left[c] for c in left.columns if c not in right.columns], *[right[c] for c in right.columns])


def _prefixed(right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"_right_{c}" for c in right.columns}
    return right.select(*[F.col(c).alias(n) for c, n in names.items()]), names


def key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """inner, left, right or full by null-safe equality. Unmatched left rows have nulls in all columns that the right has, shared ones too.

    No side is forced to be broadcast: Spark does it where a side's measured size allows it.
    """
    r, names = _prefixed(right)
    joined = left.join(r, F.col(left_key).eqNullSafe(F.col(names[right_key])), how)
    return joined.select(*[c for c in left.columns if c not in right.columns], *[F.col(n).alias(c) for c, n in names.items()])


def sort_merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """As key_join, with keys compared as text (1 joins '1'), by a sort-merge join."""
    r, names = _prefixed(right)
    on = F.col(left_key).cast("string").eqNullSafe(F.col(names[right_key]).cast("string"))
    joined = left.hint("merge").join(r.hint("merge"), on, how)
    return joined.select(*[c for c in left.columns if c not in right.columns], *[F.col(n).alias(c) for c, n in names.items()])


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows with a match; null matches null."""
    keys = right.select(F.col(right_key).alias("_key"))
    return left.join(keys, F.col(left_key).eqNullSafe(F.col("_key")), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a match."""
    keys = right.select(F.col(right_key).alias("_key"))
    return left.join(keys, F.col(left_key).eqNullSafe(F.col("_key")), "left_anti")


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, as asked for; the right side wins collisions."""
    r, names = _prefixed(right)
    return left.crossJoin(r).select(*[c for c in left.columns if c not in right.columns], *[F.col(n).alias(c) for c, n in names.items()])


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """By any condition over both sides' columns, which must have different names where the condition uses them."""
    return _merged(left.join(right, condition, how), left, right)


def stab_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the closed intervals that hold them, by an equi-join on cells of ``width``: no nested loop.

    An interval stands in each cell that it meets, so ``width`` should be about the usual length.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(point)).join(spread, "_cell").where(F.col(point).between(F.col(low), F.col(high))).drop("_cell")


def overlap_join(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, width: float) -> DataFrame:
    """Pairs of closed intervals that meet; each pair is made in one cell only, the first that both are in."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    x = a.where(F.col(a_low) <= F.col(a_high)).withColumn("_cell", F.explode(F.sequence(cell(a_low), cell(a_high))))
    y = b.where(F.col(b_low) <= F.col(b_high)).withColumn("_cell", F.explode(F.sequence(cell(b_low), cell(b_high))))
    meet = (F.col(a_low) <= F.col(b_high)) & (F.col(b_low) <= F.col(a_high))
    return x.join(y, "_cell").where(meet & (F.col("_cell") == F.greatest(cell(a_low), cell(b_low)))).drop("_cell")


def asof_join(probes: DataFrame, facts: DataFrame, ts: str, value: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Each probe with ``value`` of the last fact at or before it, of equal ``by`` columns.

    One union and one window for each key; facts at equal times go by ``tie``, the last counts.
    For few and long series give a time bucket among ``by`` and fill its start with fill_forward.
    """
    f = facts.select(*by, F.col(ts), F.col(value).alias("_fact"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.lit(0).alias("_probe"), F.lit(True).alias("_is"))
    p = probes.withColumns({"_tie": F.lit(0).cast("long"), "_probe": F.lit(1)})
    both = p.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_probe", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_is"), F.struct("_fact")), ignorenulls=True).over(w)
    return both.withColumn(f"asof_{value}", found["_fact"]).where("_probe = 1").drop("_tie", "_probe", "_fact", "_is")


def interpolate_at(probes: DataFrame, facts: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each probe with the value linear in time between the facts around it; after the last fact its value, before the first null. ``ts`` is numeric, facts have one row for each time."""
    f = facts.select(*by, F.col(ts), F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")).alias("_fact"), F.lit(0).alias("_probe"))
    both = probes.withColumn("_probe", F.lit(1)).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_probe")
    a = F.last("_fact", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_fact", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"_a": a, "_b": b}).where("_probe = 1")
    exact = F.col("_a.t") == F.col(ts)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(ts) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    return both.withColumn(value, F.when(exact | F.col("_b").isNull(), F.col("_a.v")).otherwise(line)).drop("_a", "_b", "_fact", "_probe")
