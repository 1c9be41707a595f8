"""Table operators: filter specifications, null ordering, projections, zero-on-empty aggregates, keyed collections, statements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: (column, operator, value); operators: eq ne lt gt lte gte contains startsWith endsWith
Filter = tuple[str, str, Any]


def _is(df: DataFrame, name: str, kind: type) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, kind)


def predicate(df: DataFrame, spec: Filter) -> Column:
    """Never null: a comparison of unlike types, or with null, is false; eq and ne are null-safe."""
    name, op, value = spec
    c = F.col(name) if name in df.columns else F.lit(None)
    if op in ("eq", "ne"):
        same = c.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op in ("lt", "gt", "lte", "gte"):
        if not _is(df, name, NumericType) or not isinstance(value, (int, float)):
            return F.lit(False)
        test = {"lt": c < value, "gt": c > value, "lte": c <= value, "gte": c >= value}[op]
    elif op in ("contains", "startsWith", "endsWith"):
        if not _is(df, name, StringType) or not isinstance(value, str):
            return F.lit(False)
        test = {"contains": c.contains(value), "startsWith": c.startswith(value), "endsWith": c.endswith(value)}[op]
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(test, F.lit(False))


def filter_rows(df: DataFrame, specs: Filter | Sequence[Filter]) -> DataFrame:
    """Rows that meet all specifications."""
    specs = [specs] if specs and isinstance(specs[0], str) else list(specs)
    return df.where(reduce(lambda a, b: a & b, (predicate(df, s) for s in specs), F.lit(True)))


def order_key(name: str, descending: bool = False) -> Column:
    """Nulls last when ascending, first when descending."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def sort_rows(df: DataFrame, *keys: str | tuple[str, str], ord: str | None = None) -> DataFrame:
    """By keys, or (key, 'desc') pairs; ``ord`` is the input position, which makes the sort stable."""
    cols = [order_key(k) if isinstance(k, str) else order_key(k[0], k[1] == "desc") for k in keys]
    return df.orderBy(*cols, *([F.col(ord)] if ord else []))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns by name; a name that is not there becomes a null column."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append; the columns become the union, first-seen order."""
    return df.unionByName(rows, allowMissingColumns=True)


def row_at(df: DataFrame, index: int, ord: str) -> DataFrame:
    """The row of a position by ``ord``, or none: a bounded sort, not a numbering of all rows."""
    if index < 0:
        return df.limit(0)
    return df.orderBy(ord).limit(index + 1).orderBy(F.desc(ord)).limit(1) if index else df.orderBy(ord).limit(1)


def sum_or_zero(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def avg_all_rows(c: str) -> Column:
    """Sum over the count of all rows, nulls among them; 0 for no rows."""
    return F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.coalesce(F.sum(c), F.lit(0)) / F.count(F.lit(1)))


def min_or_zero(c: str) -> Column:
    return F.coalesce(F.min(c), F.lit(0))


def max_or_zero(c: str) -> Column:
    return F.coalesce(F.max(c), F.lit(0))


def group_rows(df: DataFrame, key: str, ord: str, *columns: str) -> DataFrame:
    """Each key with its rows as an array in input order, and first, the place of the first. For groups that fit in a row; aggregate otherwise."""
    item = F.struct(F.col(ord), *[F.col(c) for c in columns])
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"), F.min(ord).alias("first"))


def find(df: DataFrame, where: Mapping[str, Any] | Column | None = None, order_by: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Equality map or predicate, then order, offset and limit."""
    if isinstance(where, Mapping):
        df = filter_rows(df, [(k, "eq", v) for k, v in where.items()])
    elif where is not None:
        df = df.where(where)
    if order_by:
        df = df.orderBy(order_key(order_by, descending))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


class DuplicateKey(ValueError):
    """An insert met a key that is there already."""


def insert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Append rows whose keys must be new, among themselves too."""
    again = rows.groupBy(key).count().where("count > 1").select(key).unionAll(rows.join(table, key, "left_semi").select(key)).limit(1)
    found = again.first()
    if found is not None:
        raise DuplicateKey(f"duplicate {key}: {found[0]!r}")
    return add_rows(table, rows)


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the columns of ``changes`` where its key matches; null changes keep the old value."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in cols])
    return table.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns])


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Replace by key, append the rest."""
    return table.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which ``where`` is not true."""
    return table.where(~F.coalesce(where, F.lit(False)))


def query_log(log: DataFrame, *, since: Any = None, until: Any = None, limit: int | None = None, ts: str = "timestamp", **equal: Any) -> DataFrame:
    """Filter an event log by equal columns and an inclusive time range, oldest first."""
    for k, v in equal.items():
        if v is not None:
            log = log.where(F.col(k) == v)
    if since is not None:
        log = log.where(F.col(ts) >= since)
    if until is not None:
        log = log.where(F.col(ts) <= until)
    return log if limit is None else log.orderBy(ts).limit(limit)


def retain_last(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows: a bounded log."""
    return log.orderBy(*[F.desc(o) for o in order]).limit(n)


def match(*cases: tuple[Column, Any], otherwise: Any = None) -> Column:
    """The value of the first true case."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def matches(pattern: Mapping[str, Any]) -> Column:
    """Whether all named columns equal the pattern's values; nested mappings go into structs."""

    def test(path: str, value: Any) -> Column:
        if isinstance(value, Mapping):
            return reduce(lambda a, b: a & b, (test(f"{path}.{k}" if path else k, v) for k, v in value.items()), F.lit(True))
        return F.col(path).eqNullSafe(F.lit(value))

    return test("", pattern)


def bijection(df: DataFrame, key: str, value: str, ord: str) -> DataFrame:
    """One row for each key and each value: of pairs that share either, the later one by ``ord`` stays, as setting them in turn would leave it where chains do not occur."""
    last = lambda d, k: d.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(F.desc(ord)))).where("_n = 1").drop("_n")
    return last(last(df, key), value)


_NAME = r"[A-Za-z_][A-Za-z0-9_.]*"


@dataclass
class Statement:
    """A SELECT built step by step, run with positional parameters; text is never spliced into it.

    ``where`` replaces the first condition; ``and_where`` and ``or_where`` follow flat, so AND binds tighter.
    """

    columns: tuple[str, ...] = ("*",)
    table: str = ""
    joins: list[str] = field(default_factory=list)
    conditions: list[tuple[str, str]] = field(default_factory=list)
    groups: tuple[str, ...] = ()
    having_: str | None = None
    orders: list[str] = field(default_factory=list)
    limit_: int | None = None
    offset_: int | None = None
    params: list[Any] = field(default_factory=list)

    def from_(self, table: str) -> Statement:
        self.table = table
        return self

    def join(self, table: str, condition: str, kind: str = "INNER") -> Statement:
        self.joins.append(f"{kind} JOIN {table} ON {condition}")
        return self

    def where(self, condition: str, *params: Any) -> Statement:
        self.conditions[:1] = [("", condition)]
        self.params += params
        return self

    def and_where(self, condition: str, *params: Any) -> Statement:
        self.conditions.append(("AND" if self.conditions else "", condition))
        self.params += params
        return self

    def or_where(self, condition: str, *params: Any) -> Statement:
        self.conditions.append(("OR" if self.conditions else "", condition))
        self.params += params
        return self

    def group_by(self, *columns: str) -> Statement:
        self.groups = columns
        return self

    def having(self, condition: str) -> Statement:
        self.having_ = condition
        return self

    def order_by(self, column: str, direction: str = "ASC") -> Statement:
        self.orders.append(f"{column} {direction}")
        return self

    def limit(self, n: int) -> Statement:
        self.limit_ = n
        return self

    def offset(self, n: int) -> Statement:
        self.offset_ = n
        return self

    def build(self) -> tuple[str, list[Any]]:
        if not self.table:
            raise ValueError("a statement needs a table")
        parts = [f"SELECT {', '.join(self.columns)} FROM {self.table}", *self.joins]
        if self.conditions:
            parts.append("WHERE " + " ".join(f"{w} {c}".strip() for w, c in self.conditions))
        if self.groups:
            parts.append(f"GROUP BY {', '.join(self.groups)}")
        if self.having_:
            parts.append(f"HAVING {self.having_}")
        if self.orders:
            parts.append(f"ORDER BY {', '.join(self.orders)}")
        if self.limit_ is not None:
            parts.append(f"LIMIT {int(self.limit_)}")
        if self.offset_ is not None:
            parts.append(f"OFFSET {int(self.offset_)}")
        return " ".join(parts), list(self.params)

    def run(self, spark: SparkSession) -> DataFrame:
        text, params = self.build()
        return spark.sql(text, args=params) if params else spark.sql(text)


def select(*columns: str) -> Statement:
    return Statement(columns or ("*",))
