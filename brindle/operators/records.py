"""Replicated values, access rules, queues, state machines and grids as relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .windows import fold


def clock_merge(a: Column, b: Column) -> Column:
    """Vector clocks (node -> count): the greater count of each node."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def _all_at_most(a: Column, b: Column) -> Column:
    return ~F.exists(F.map_entries(a), lambda e: e["value"] > F.coalesce(F.try_element_at(b, e["key"]), F.lit(0).cast("long")))


def happens_before(a: Column, b: Column) -> Column:
    return _all_at_most(a, b) & ~_all_at_most(b, a)


def is_concurrent(a: Column, b: Column) -> Column:
    return ~_all_at_most(a, b) & ~_all_at_most(b, a)


def lamport_receive(own: Column, received: Column) -> Column:
    return F.greatest(own, received) + 1


def observed_remove_set(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Items with a tag (item, tag) that was added and not removed."""
    return added.select("item", "tag").distinct().join(removed.select("item", "tag").distinct(), ["item", "tag"], "left_anti").select("item").distinct()


def allowed(grants: DataFrame, subject: str, resource: str, permission: str) -> DataFrame:
    """Grants (subject, resource, permission) that match; * stands for any resource or permission."""
    return grants.where((F.col("subject") == subject) & F.col("resource").isin(resource, "*") & F.col("permission").isin(permission, "*"))


def check_all(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (subject, resource, permission) with allowed: equi-joins for each place a star can stand in."""
    out = requests.withColumn("_r", F.explode(F.array("resource", F.lit("*")))).withColumn("_p", F.explode(F.array("permission", F.lit("*"))))
    g = grants.select(F.col("subject").alias("_s"), F.col("resource").alias("_gr"), F.col("permission").alias("_gp"), F.lit(True).alias("_ok")).distinct()
    hit = out.join(g, (out["subject"] == g["_s"]) & (out["_r"] == g["_gr"]) & (out["_p"] == g["_gp"]), "left")
    return hit.groupBy("subject", "resource", "permission").agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("allowed"))


def inherited(roles: DataFrame, parents: DataFrame, depth: int = 32) -> DataFrame:
    """(user, role) with all roles that a role inherits: parents is (role, parent)."""
    at = roles.select("user", "role").distinct()
    out = at
    up = parents.select(F.col("role").alias("_child"), F.col("parent").alias("_parent"))
    for _ in range(depth):
        at = at.join(up, F.col("role") == F.col("_child")).select("user", F.col("_parent").alias("role")).distinct().join(out, ["user", "role"], "left_anti")
        if at.limit(1).count() == 0:
            return out
        out = out.unionAll(at)
    raise RuntimeError("deeper than asked for")


def dequeue(queue: DataFrame, n: int, priority: str, *ord: str) -> DataFrame:
    """The next n entries: highest priority first, then in order."""
    return queue.orderBy(F.desc(priority), *ord).limit(n)


def retried(jobs: DataFrame, failed: Column, attempts: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(to run again with one more attempt, dead letters) of jobs whose run failed."""
    bad = jobs.where(failed)
    return bad.where(F.col(attempts) + 1 < most).withColumn(attempts, F.col(attempts) + 1), bad.where(F.col(attempts) + 1 >= most)


def quota_use(df: DataFrame, key: str, ts: str, amount: str, period_seconds: int, most: float, *tie: str) -> DataFrame:
    """Rows with granted: whether the key's amounts in its aligned period stay within ``most``; a refused amount is not charged.

    The charge is a fold over the rows of one key and period in order.
    """
    period = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (period_seconds * 1_000_000))

    def step(used, x: float):
        used = used or 0.0
        return (used + x, (True,)) if used + x <= most else (used, (False,))

    return fold(df.withColumn("_period", period), [key, "_period"], [ts, *tie], [amount], None, step, ["granted"], BooleanType()).drop("_period")


def state_machine(df: DataFrame, by: str, event: str, start: str, transitions: Mapping[tuple[str, str], str], *ord: str) -> DataFrame:
    """Each row with state, its key's state after it; events that the state does not know change nothing."""

    def step(state: str, e: str):
        state = transitions.get((state, e), state)
        return state, (state,)

    coded = df.withColumn("_e", F.coalesce(F.col(event).cast("string"), F.lit("")))
    return fold(coded, [by], list(ord), ["_e"], start, step, ["state"], StringType(), None)


def life_step(cells: DataFrame) -> DataFrame:
    """The next generation of live cells (x, y): neighbours are counted by exploding each cell onto the eight around it."""
    around = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), F.lit(int(i == j == 0)).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    n = cells.select(F.explode(around).alias("c")).groupBy("c.x", "c.y").agg(F.sum(1 - F.col("c.own")).alias("n"), F.max("c.own").alias("alive"))
    return n.where("n = 3 or (n = 2 and alive = 1)").select("x", "y")


def automaton_step(cells: Column, rule: int) -> Column:
    """One generation of a one-dimensional automaton on an array of 0 and 1, around the ends."""
    n = F.size(cells)
    at = lambda i: F.get(cells, F.pmod(i, n).cast("int"))
    return F.transform(cells, lambda _, i: F.lit(rule).bitwiseAND(F.pow(F.lit(2), at(i - 1) * 4 + at(i) * 2 + at(i + 1)).cast("int")).cast("boolean").cast("int"))


def hash_chain(df: DataFrame, by: str, payload: str, *ord: str) -> DataFrame:
    """Each row with hash: the SHA-256 of the hash before it in its key and its payload; the first follows 64 zeros."""
    item = F.struct(*[F.col(o) for o in ord], F.col(payload).cast("string").alias("_p"))
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    fields = list(ord)
    start = F.struct(F.repeat(F.lit("0"), 64).alias("h"), F.transform(F.slice("_rows", 1, 0), lambda r: F.struct(*[r[f].alias(f) for f in fields], F.lit("").alias("hash"))).alias("out"))

    def step(acc, r):
        h = F.sha2(F.concat(acc["h"], r["_p"]).cast("binary"), 256)
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(F.struct(*[r[f].alias(f) for f in fields], h.alias("hash")))).alias("out"))

    return rows.select(by, F.explode(F.aggregate("_rows", start, step)["out"]).alias("r")).select(by, "r.*")


def verify_chain(chain: DataFrame, by: str, payload: str, *ord: str) -> DataFrame:
    """Rows of a chain (with hash and payload) whose hash does not follow from the row before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(by).orderBy(*ord)), F.repeat(F.lit("0"), 64))
    return chain.withColumn("_want", F.sha2(F.concat(before, F.col(payload).cast("string")).cast("binary"), 256)).where("hash <> _want").drop("_want")


def compare_pages(a: DataFrame, b: DataFrame, page: str, text: str) -> DataFrame:
    """page and status (same, changed, added or removed) of two documents' pages."""
    x, y = a.select(page, F.col(text).alias("_a"), F.lit(1).alias("_x")), b.select(page, F.col(text).alias("_b"), F.lit(1).alias("_y"))
    status = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return x.join(y, page, "full").select(page, status.alias("status"))


def reading_order(items: DataFrame, page: str, x: str, y: str, text: str, line_height: float) -> DataFrame:
    """page and text: items with their places in lines of ``line_height``, from top to bottom, then left to right."""
    line = F.floor(F.col(y) / line_height)
    item = F.struct(F.col(x), F.col(text).alias("t"))
    lines = items.groupBy(page, line.alias("_line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["t"]), " ").alias("_text"))
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda i: i["_text"]), "\n").alias("text"))


def detect_tables(items: DataFrame, page: str, x: str, y: str, text: str, row_height: float, column_width: float) -> DataFrame:
    """page, row, column and text of cells: items gathered by their place in a grid."""
    cell = items.withColumns({"row": F.floor(F.col(y) / row_height), "column": F.floor(F.col(x) / column_width)})
    return cell.groupBy(page, "row", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(x), F.col(text).alias("t")))), lambda i: i["t"]), " ").alias("text"))
