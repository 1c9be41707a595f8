"""Array, map and nested-value scalars."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersection(a: Column, b: Column) -> Column:
    """Items of a that are in b; duplicates of a stay."""
    return F.filter(a, lambda x: F.exists(b, lambda y: x.eqNullSafe(y)))


def difference(a: Column, b: Column) -> Column:
    """Items of a that are not in b; duplicates stay."""
    return F.filter(a, lambda x: ~F.exists(b, lambda y: x.eqNullSafe(y)))


def unique(a: Column) -> Column:
    return F.array_distinct(a)


def chunk(a: Column, size: int) -> Column:
    n = F.ceil(F.size(a) / size).cast("int")
    return F.when(n <= 0, F.slice(F.array(a), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(a, i * size + 1, size)))


def zip_shortest(a: Column, b: Column) -> Column:
    return F.slice(F.arrays_zip(a, b), 1, F.least(F.size(a), F.size(b)))


def partition(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.struct(F.filter(a, test).alias("yes"), F.filter(a, lambda x: ~F.coalesce(test(x), F.lit(False))).alias("no"))


def rotate(a: Column, n: int) -> Column:
    """To the right by n, around the end."""
    size = F.size(a)
    k = F.when(size == 0, 0).otherwise(F.pmod(F.lit(n), F.nullif(size, F.lit(0))))
    return F.when(k == 0, a).otherwise(F.concat(F.slice(a, size - k + 1, k), F.slice(a, 1, size - k)))


def compact(a: Column, zero=0) -> Column:
    """Without nulls and what counts as false: 0, '' or False, as given."""
    return F.filter(a, lambda x: x.isNotNull() & (x != zero))


def number_range(start: Column, end: Column, step: int = 1) -> Column:
    """End-exclusive; empty where start is not before end."""
    ok = start < end if step > 0 else start > end
    last = F.when(ok, end - (1 if step > 0 else -1)).otherwise(start)
    return F.when(ok, F.sequence(start, last, F.lit(step))).otherwise(F.slice(F.array(start), 1, 0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(total(a) / F.size(a))


def median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def running(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0.0), lambda s, y: s + y))


def run_lengths(a: Column) -> Column:
    """Runs of equal items, as (value, count)."""
    start = F.transform(F.slice(a, 1, 0), lambda x: F.struct(x.alias("value"), F.lit(0).alias("count")))
    grow = lambda out, x: F.when(
        (F.size(out) > 0) & F.try_element_at(out, F.lit(-1))["value"].eqNullSafe(x),
        F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(x.alias("value"), (F.try_element_at(out, F.lit(-1))["count"] + 1).alias("count")))),
    ).otherwise(F.concat(out, F.array(F.struct(x.alias("value"), F.lit(1).alias("count")))))
    return F.aggregate(a, start, grow)


def run_lengths_expand(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["count"])))


def delta_encode(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(a, i - 1)))


def delta_decode(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i + 1), x - x, lambda s, y: s + y))


def zigzag_encode(n: Column) -> Column:
    return F.shiftleft(n.cast("long"), 1).bitwiseXOR(F.shiftright(n.cast("long"), 63))


def zigzag_decode(n: Column) -> Column:
    return F.shiftrightunsigned(n.cast("long"), 1).bitwiseXOR(-(n.cast("long").bitwiseAND(F.lit(1).cast("long"))))


def pick(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def omit(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def merge(a: Column, b: Column) -> Column:
    """The right map wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def json_get(text: Column, path: str) -> Column:
    """By a dotted path, as text; null where there is none or the text is no JSON."""
    return F.get_json_object(text, "$." + path)


def is_valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_minify(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def json_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def _per_json(fn):
    """A vectorised UDF over JSON text: null for null or bad JSON."""

    @vectorized("string")
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(fn(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return pd.Series([one(t) for t in text], dtype=object)

    return run


def _flat(value, path: str = "") -> dict:
    items = value.items() if isinstance(value, Mapping) else enumerate(value) if isinstance(value, list) else None
    if items is None or not value:
        return {path: value} if path else {}
    out: dict = {}
    for k, v in items:
        out |= _flat(v, f"{path}.{k}" if path else str(k))
    return out


def _nested(flat: dict):
    out: dict = {}
    for path, v in flat.items():
        *parts, last = path.split(".")
        at = out
        for p in parts:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def _deep(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _deep(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


json_flatten = _per_json(_flat)
json_unflatten = _per_json(_nested)


@vectorized("string")
def json_merge(base: pd.Series, override: pd.Series) -> pd.Series:
    """Objects merged at every level; the override wins."""
    return pd.Series([None if a is None or b is None else json.dumps(_deep(json.loads(a), json.loads(b)), ensure_ascii=False, separators=(",", ":")) for a, b in zip(base, override)], dtype=object)


def _changes(a, b, path: str = "") -> list[dict]:
    """Added, removed and changed paths."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted({**a, **b}):
            at = f"{path}.{k}" if path else k
            if k not in b:
                out.append({"path": at, "kind": "removed", "old": a[k]})
            elif k not in a:
                out.append({"path": at, "kind": "added", "new": b[k]})
            else:
                out += _changes(a[k], b[k], at)
        return out
    return [] if a == b else [{"path": path, "kind": "changed", "old": a, "new": b}]


@vectorized("array<struct<path: string, kind: string, old: string, new: string>>")
def json_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(a, b):
        rows = _changes(json.loads(a), json.loads(b))
        return [{"path": r["path"], "kind": r["kind"], "old": json.dumps(r["old"]) if "old" in r else None, "new": json.dumps(r["new"]) if "new" in r else None} for r in rows]

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(old, new)])


def json_set(text: Column, path: str, value: Column) -> Column:
    """The text with the value (JSON text) at a dotted path."""
    nested = value
    for part in reversed(path.split(".")):
        nested = F.concat(F.lit("{" + json.dumps(part) + ":"), nested, F.lit("}"))
    return json_merge(text, nested)


def coerce_boolean(s: Column) -> Column:
    """true, 1, yes, on without case; anything else is false."""
    return F.coalesce(F.lower(F.trim(s.cast("string"))).isin("true", "1", "yes", "on"), F.lit(False))


def coerce_number(s: Column) -> Column:
    """Null for texts that are no number."""
    return F.trim(s.cast("string")).try_cast("double")


def validate(rules: Mapping[str, tuple[Column, str]]) -> Column:
    """Array of struct<path, message> of the rules (a test and its message) that fail; null fails."""
    checks = [F.when(~F.coalesce(test, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, (test, message) in rules.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def walk(df, id: str, parent: str, depth: int = 64):
    """Nodes of a forest with their root and depth; a parent that is not there makes a root. Iterative joins, one for each level; ``depth`` levels at most, beyond which it raises."""
    known = df.select(F.col(id).alias("_known")).distinct()
    rows = df.join(known, F.col(parent) == F.col("_known"), "left")
    at = rows.where("_known is null").select(F.col(id).alias("id"), F.col(id).alias("root"), F.lit(0).alias("depth"))
    out = at
    children = df.select(F.col(id).alias("_child"), F.col(parent).alias("_up"))
    for level in range(1, depth + 1):
        at = at.join(children, F.col("id") == F.col("_up")).select(F.col("_child").alias("id"), "root", F.lit(level).alias("depth"))
        if at.limit(1).count() == 0:
            return out
        out = out.unionAll(at)
    raise RuntimeError("deeper than asked for, or a cycle")
