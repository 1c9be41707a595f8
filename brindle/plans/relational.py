"""Queries of the table, join, order and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, order, relational, sets
from ..operators import aggregates as agg
from .base import Tables, query

_SEGMENTS = """
SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS avg_price
FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey WHERE o_totalprice > 100000
GROUP BY c_mktsegment ORDER BY revenue DESC NULLS FIRST LIMIT 10
"""


@query(_SEGMENTS)
def flagship(t: Tables):
    """Join, filter specification, grouping, null order and limit in one plan."""
    dear = relational.filter_rows(t.orders, ("o_totalprice", "gt", 100000))
    joined = joins.key_join(dear, t.customer, "o_custkey", "c_custkey")
    groups = joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    return relational.sort_rows(groups, ("revenue", "desc")).limit(10)


def _sides(t: Tables):
    """All orders and all customers; the customers' keys are doubled, so that either side has rows without a match. Both have a column of one name."""
    return t.orders.select("o_orderkey", "o_custkey", F.lit("order").alias("side")), t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name", F.lit("customer").alias("side"))


def _join_sql(kind: str) -> str:
    return f"SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name, c.side FROM orders o {kind} JOIN (SELECT c_custkey * 2 AS c_custkey, c_name, 'customer' AS side FROM customer) c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey"


@query(_join_sql("INNER"))
def join_inner(t):
    return joins.key_join(*_sides(t), "o_custkey", "c_custkey")


@query(_join_sql("LEFT"))
def join_left(t):
    return joins.key_join(*_sides(t), "o_custkey", "c_custkey", "left")


@query(_join_sql("RIGHT"))
def join_right(t):
    return joins.key_join(*_sides(t), "o_custkey", "c_custkey", "right")


@query(_join_sql("FULL"))
def join_full(t):
    return joins.key_join(*_sides(t), "o_custkey", "c_custkey", "full")


@query("SELECT l.l_linenumber, r.k, r.n_name FROM (SELECT l_linenumber, nullif(l_linenumber % 3, 0) AS k FROM lineitem) l JOIN (SELECT nullif(n_nationkey % 4, 0) AS k, n_name FROM nation) r ON l.k IS NOT DISTINCT FROM r.k")
def join_null_keys(t):
    """Null keys join each other."""
    left = t.lineitem.selectExpr("l_linenumber", "nullif(l_linenumber % 3, 0) as k")
    return joins.key_join(left, t.nation.selectExpr("nullif(n_nationkey % 4, 0) as k", "n_name"), "k", "k")


@query("SELECT c.* FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return joins.semi_join(t.customer, t.orders.where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@query("SELECT c.* FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return joins.anti_join(t.customer, t.orders, "c_custkey", "o_custkey")


@query("SELECT region.*, nation.* FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.cross_join(t.region, t.nation)


@query("SELECT s.s_suppkey, s.s_name, n.n_nationkey, n.n_name, n.n_regionkey FROM (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS k FROM supplier) s JOIN nation n ON s.k = CAST(n.n_nationkey AS VARCHAR)")
def join_sort_merge(t):
    """Text keys join numbers."""
    left = t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("k"))
    return joins.sort_merge_join(left, t.nation, "k", "n_nationkey").drop("k")


@query("SELECT s.s_suppkey, s.s_name, n.n_nationkey, n.n_name, n.n_regionkey FROM (SELECT s_suppkey, s_name, s_nationkey + 12 AS k FROM supplier) s LEFT JOIN nation n ON s.k = n.n_nationkey")
def join_sort_merge_left(t):
    left = t.supplier.select("s_suppkey", "s_name", (F.col("s_nationkey") + 12).alias("k"))
    return joins.sort_merge_join(left, t.nation, "k", "n_nationkey", "left").drop("k")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_suppkey <= 50")
def join_theta(t):
    left = t.supplier.select("s_suppkey", "s_nationkey")
    return joins.theta_join(left, t.nation.select("n_nationkey"), (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_suppkey") <= 50)).drop("s_nationkey")


_BANDS = "(SELECT CAST(range AS INTEGER) AS band, CAST(range * 3 AS DOUBLE) AS low, CAST(range * 3 + 7 AS DOUBLE) AS high FROM range(0, 18))"


def _bands(t):
    return t.spark.range(18).select(F.col("id").cast("int").alias("band"), (F.col("id") * 3).cast("double").alias("low"), (F.col("id") * 3 + 7).cast("double").alias("high"))


@query(f"SELECT band, count(*) AS n, min(p_partkey) AS first FROM part JOIN {_BANDS} b ON p_size BETWEEN low AND high GROUP BY band")
def join_interval(t):
    """Points in closed intervals, by cells."""
    found = joins.stab_join(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size")), _bands(t), "size", "low", "high", 7.0)
    return found.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query(f"SELECT a.band AS a_band, b.band AS b_band FROM {_BANDS} a JOIN {_BANDS} b ON a.low <= b.high AND b.low <= a.high WHERE a.band < b.band")
def join_overlap(t):
    side = lambda p: _bands(t).select(*[F.col(c).alias(f"{p}_{c}") for c in ("band", "low", "high")])
    return joins.overlap_join(side("a"), side("b"), "a_low", "a_high", "b_low", "b_high", 7.0).where("a_band < b_band").select("a_band", "b_band")


_LAST = "(SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY user_id, ts)"


@query(f"SELECT p.event_id, round(f.value, 6) AS asof_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') p ASOF LEFT JOIN {_LAST} f ON p.user_id = f.user_id AND p.ts >= f.ts")
def join_asof(t):
    """The last value of other events of the user, at or before each click."""
    probes = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    found = joins.asof_join(probes, t.events.where("event_type <> 'click'"), "ts", "value", ["user_id"], tie="event_id")
    return found.select("event_id", F.round("asof_value", 6).alias("asof_value"))


@query("SELECT * FROM part WHERE p_size >= 10 AND p_size < 30 AND p_brand <> 'Brand#11' AND p_name LIKE '%a%' AND p_type IS NOT DISTINCT FROM p_type")
def table_filter(t):
    return relational.filter_rows(t.part, [("p_size", "gte", 10), ("p_size", "lt", 30), ("p_brand", "ne", "Brand#11"), ("p_name", "contains", "a")])


@query("SELECT count(*) AS n FROM part WHERE false")
def table_filter_types(t):
    """Operators on values of another type are false, not errors."""
    return relational.filter_rows(t.part, [("p_name", "gt", 3)]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_orderkey % 5, 0) AS k FROM orders) ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 100")
def table_sort_nulls(t):
    rows = t.orders.selectExpr("o_orderkey", "nullif(o_orderkey % 5, 0) as k")
    return relational.sort_rows(rows, ("k", "desc"), ord="o_orderkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def table_limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS missing FROM customer")
def table_select(t):
    return relational.project(t.customer, ["c_custkey", "missing"])


@query("SELECT round(sum(CASE WHEN event_type = 'click' THEN value END) / count(*), 6) AS avg_all, coalesce(min(CASE WHEN event_type = 'none' THEN value END), 0) AS min_none, coalesce(sum(CASE WHEN event_type = 'none' THEN value END), 0) AS sum_none FROM events")
def table_aggregates(t):
    rows = t.events.select(F.expr("case when event_type = 'click' then value end").alias("v"), F.expr("case when event_type = 'none' then value end").alias("w"))
    return rows.agg(F.round(relational.avg_all_rows("v"), 6).alias("avg_all"), relational.min_or_zero("w").alias("min_none"), relational.sum_or_zero("w").alias("sum_none"))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC LIMIT 3 OFFSET 1")
def collection_find(t):
    return relational.find(t.nation, {"n_regionkey": 1}, order_by="n_name", descending=True, offset=1, limit=3).select("n_name", "n_regionkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 99, 'new', NULL")
def collection_upsert(t):
    rows = t.nation.where("n_nationkey < 5").select("n_nationkey").unionAll(t.spark.sql("select 99 as n_nationkey")).withColumn("n_name", F.lit("new"))
    return relational.upsert(t.nation, rows, "n_nationkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def collection_update(t):
    changes = t.nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    return relational.update(t.nation, changes, "n_nationkey")


@query("SELECT * FROM nation WHERE NOT n_regionkey = 2")
def collection_delete(t):
    return relational.delete(t.nation, F.col("n_regionkey") == 2)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderkey < 5000 OR o_orderstatus = 'P' GROUP BY o_orderstatus HAVING count(*) > 1 ORDER BY o_orderstatus LIMIT 5")
def statement(t):
    """A built statement with positional parameters."""
    t.orders.createOrReplaceTempView("brindle_orders")
    s = relational.select("o_orderstatus", "count(*) AS n").from_("brindle_orders").where("o_totalprice > ?", 1000).and_where("o_orderkey < ?", 5000).or_where("o_orderstatus = ?", "P")
    return s.group_by("o_orderstatus").having("count(*) > 1").order_by("o_orderstatus").limit(5).run(t.spark)


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'sale' WHEN value > 50 THEN 'big' ELSE 'other' END AS class FROM events")
def match_first(t):
    return t.events.select("event_id", relational.match((F.col("event_type") == "purchase", "sale"), (F.col("value") > 50, "big"), otherwise="other").alias("class"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 1000000")
def log_query(t):
    from datetime import datetime

    return relational.query_log(t.events, since=datetime(2024, 1, 5), until=datetime(2024, 1, 20), ts="ts", event_type="error").select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def log_summary(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_retention(t):
    return relational.retain_last(t.events, 500, "ts", "event_id").select("event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_first(t):
    return order.distinct_first(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT l_returnflag FROM lineitem GROUP BY l_returnflag ORDER BY min((l_orderkey, l_linenumber))")
def distinct_values(t):
    return order.distinct_values(t.lineitem, "l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events")
def global_index(t):
    """All rows numbered in order, in parallel ranges."""
    return order.global_index(t.events.select("ts", "event_id"), "ts", "event_id").select("event_id", "index")


@query("SELECT i // 100 AS chunk, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def chunks(t):
    return order.chunk(t.events, 100, "event_id", columns=["event_id"]).select("chunk", F.size("items").cast("long").alias("n"), F.element_at("items", 1)["event_id"].alias("first"))


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)")
def zip_rows(t):
    return order.zip_rows(t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), "c_custkey", "s_suppkey")


@query("SELECT event_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 1e18) FROM events WHERE NOT value < 99)")
def take_while(t):
    return order.take_while(t.events, F.col("value") < 99, "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 99)")
def skip_while(t):
    return order.skip_while(t.events, F.col("value") < 99, "event_id").select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t):
    return order.top_k(t.orders.select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_k_by_group(t):
    return order.top_k_by(t.orders, "o_custkey", 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("SELECT l_quantity FROM lineitem ORDER BY l_quantity LIMIT 1 OFFSET 999")
def kth_smallest(t):
    return order.kth(t.lineitem, "l_quantity", 1000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_by_offset(t):
    return order.page_of(t.orders.select("o_orderkey"), 3, 50, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def page_after_key(t):
    return order.page_after(t.orders.select("o_orderkey"), "o_orderkey", 500, 50)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 50")
def page_before_key(t):
    return order.page_before(t.orders.select("o_orderkey"), "o_orderkey", 500, 50)


_A, _B = "SELECT l_linenumber AS k FROM lineitem WHERE l_quantity < 20", "SELECT l_linenumber AS k FROM lineitem WHERE l_quantity > 35"


def _bags(t):
    return t.lineitem.where("l_quantity < 20").selectExpr("l_linenumber as k"), t.lineitem.where("l_quantity > 35").selectExpr("l_linenumber as k")


def _bag_sql(expression: str) -> str:
    return f"WITH a AS (SELECT k, count(*) AS n FROM ({_A}) GROUP BY k), b AS (SELECT k, count(*) AS n FROM ({_B}) GROUP BY k) SELECT * FROM (SELECT k, CAST({expression} AS BIGINT) AS count FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn FROM a FULL JOIN b ON a.k = b.k)) WHERE count > 0"


@query(_bag_sql("greatest(an, bn)"))
def bag_union(t):
    return sets.bag_union(*_bags(t))


@query(_bag_sql("least(an, bn)"))
def bag_intersect(t):
    return sets.bag_intersect(*_bags(t))


@query(_bag_sql("greatest(an - bn, 0)"))
def bag_difference(t):
    return sets.bag_difference(*_bags(t))


@query(_bag_sql("an + bn"))
def bag_sum(t):
    return sets.bag_sum(*_bags(t))


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def bag_except_all(t):
    return t.customer.selectExpr("c_nationkey as k").exceptAll(t.supplier.selectExpr("s_nationkey as k"))


_SPANS = "SELECT o_custkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS s, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) + 60 AS e FROM orders"
_MERGED = f"WITH r AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT o_custkey, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2)"


def _spans(t):
    day = F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long")
    return t.orders.select("o_custkey", day.alias("s"), (day + 60).alias("e"))


@query(f"{_MERGED} SELECT o_custkey, s, e FROM g")
def range_merge(t):
    return sets.merge_ranges(_spans(t), "s", "e", "o_custkey")


@query(f"{_MERGED} SELECT o_custkey, e AS s, n AS e FROM (SELECT o_custkey, e, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) AS n FROM g) WHERE n IS NOT NULL")
def range_invert(t):
    return sets.invert_ranges(_spans(t), "s", "e", "o_custkey")


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def group_pivot(t):
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in "FOP"])


@query("SELECT event_type, array_to_string(list(event_id ORDER BY event_id)[1:5], ',') AS first_five, count(*) AS n FROM events GROUP BY event_type")
def group_rows(t):
    top = order.top_k_by(t.events, "event_type", 5, F.col("event_id"))
    groups = relational.group_rows(top, "event_type", "event_id").select("event_type", F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("first_five"))
    return groups.join(agg.frequency(t.events, "event_type").withColumnRenamed("count", "n"), "event_type")
