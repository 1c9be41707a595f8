"""Queries of text structures, keyed state, filters, page texts, and of functions that no other query calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import serial, texts
from ..operators import filters, stores
from ..sources import documents, pdf
from .base import Tables, query


@query("SELECT n_nationkey, substr(n_name, 1, 2) || 'xy' || substr(n_name, 5) || '!' AS text FROM nation")
def edit_buffer(t: Tables):
    """Two edits one after another: two signs replaced, one put at the end."""
    edit = lambda at, remove, insert: F.struct(F.lit(at).alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    return t.nation.select("n_nationkey", texts.applied(F.col("n_name"), F.array(edit(2, 2, "xy"), edit(10_000, 0, "!"))).alias("text"))


@query("SELECT n_nationkey, true AS same FROM nation")
def edit_transform(t):
    """Two edits of one text give the same text in either order, once the later is transformed."""
    n = F.col("n_nationkey")
    a = F.struct((n % 5).cast("int").alias("at"), (n % 3).cast("int").alias("remove"), F.lit("AA").alias("insert"))
    b = F.struct((n % 4).cast("int").alias("at"), (n % 2).cast("int").alias("remove"), F.lit("bbb").alias("insert"))
    one = texts.applied(F.col("n_name"), F.array(a, texts.transformed(b, a, False)))
    two = texts.applied(F.col("n_name"), F.array(b, texts.transformed(a, b, True)))
    return t.nation.select("n_nationkey", one.alias("one"), two.alias("two")).select("n_nationkey", (F.col("one") == F.col("two")).alias("same"))


@query("SELECT n_nationkey, list_transform(list_sort(list_transform(range(1, length(n_name) + 1), lambda i: {'s': substr(n_name, i), 'i': i - 1})), lambda x: x.i::INTEGER) AS suffixes FROM nation")
def text_suffix_array(t):
    return t.nation.select("n_nationkey", texts.suffix_array(F.col("n_name")).alias("suffixes"))


@query("SELECT p_partkey, len(list_filter(range(1, length(p_type) + 1), lambda i: substr(p_type, i, 1) = 'E'))::BIGINT AS n, len(list_distinct(flatten(list_transform(range(1, length(p_type) + 1), lambda i: list_transform(range(1, length(p_type) - i + 2), lambda k: substr(p_type, i, k))))))::BIGINT AS parts FROM part")
def text_substrings(t):
    return t.part.select("p_partkey", texts.occurrences(F.col("p_type"), F.lit("E")).alias("n"), texts.distinct_substrings(F.col("p_type")).alias("parts"))


@query("SELECT n_nationkey, 'abc' || n_nationkey AS part FROM nation")
def text_longest_repeat(t):
    x = F.concat(F.lit("abc"), F.col("n_nationkey").cast("string"))
    return t.nation.select("n_nationkey", texts.longest_repeat(F.concat(x, F.lit("-"), x, F.lit("+"))).alias("part"))


@query("SELECT n_nationkey, n_nationkey::VARCHAR AS id, 'x/' || n_name AS rest, CAST(NULL AS VARCHAR) AS none, '/users/' || n_nationkey || '/files/a' AS built FROM nation")
def url_patterns(t):
    path = F.concat(F.lit("/users/"), F.col("n_nationkey"), F.lit("/files/x/"), F.col("n_name"))
    m = texts.path_match(path, "/users/:id/files/*")
    return t.nation.select("n_nationkey", m["id"].alias("id"), m["*"].alias("rest"), texts.path_match(path, "/groups/:id")["id"].alias("none"), texts.path_build("/users/:id/files/a", {"id": F.col("n_nationkey")}).alias("built"))


@query("SELECT n_nationkey, (a // g)::BIGINT AS num, (b // g)::BIGINT AS den, a * 6 < b * 5 AS less FROM (SELECT n_nationkey, (n_nationkey * 6 + 5 * (n_nationkey + 2)) AS a, (n_nationkey + 2) * 6 AS b, gcd(n_nationkey * 6 + 5 * (n_nationkey + 2), (n_nationkey + 2) * 6) AS g FROM nation)")
def math_fractions(t):
    a, b = texts.fraction(F.col("n_nationkey"), F.col("n_nationkey") + 2), texts.fraction(F.lit(5), F.lit(6))
    rows = t.nation.select("n_nationkey", a.alias("a"), b.alias("b")).select("n_nationkey", texts.fraction_add(F.col("a"), F.col("b")).alias("s"), "b")
    return rows.select("n_nationkey", "s.num", "s.den", texts.fraction_less(F.col("s"), F.col("b")).alias("less"))


@query("SELECT n_nationkey, true AS same, n_nationkey = 1 AS one, CASE WHEN n_nationkey % 2 = 0 THEN 'number' ELSE 'array' END AS kind FROM nation")
def json_equal(t):
    n = F.col("n_nationkey").cast("string")
    a, b = F.concat(F.lit('{"a": '), n, F.lit(', "b": [1, 2.0]}')), F.concat(F.lit('{"b":[1.0,2],"a":'), n, F.lit("}"))
    kind = texts.kind_of(F.when(F.col("n_nationkey") % 2 == 0, n).otherwise(F.concat(F.lit("["), n, F.lit("]"))))
    return t.nation.select("n_nationkey", texts.deep_equal(a, b).alias("same"), texts.deep_equal(n, F.lit("1")).alias("one"), kind.alias("kind"))


@query("SELECT p_partkey, p_size % 7 <> 0 AS ok, CASE WHEN p_size % 7 <> 0 THEN p_size * 2 END AS value, CASE WHEN p_size % 7 = 0 THEN 'seven' END AS error, CASE WHEN p_size % 7 <> 0 THEN p_size * 2 ELSE -1 END AS other FROM part")
def result_values(t):
    r = texts.result_map(texts.result(F.col("p_size"), F.when(F.col("p_size") % 7 == 0, "seven")), lambda v: v * 2)
    return t.part.select("p_partkey", r.alias("r")).select("p_partkey", "r.*", texts.result_or(F.col("r"), F.lit(-1)).alias("other"))


@query("SELECT count(*) AS n, true AS fits FROM part")
def id_short(t):
    made = t.part.select(texts.short_id(F.col("p_partkey")).alias("id"))
    return made.agg(F.countDistinct("id").alias("n"), F.min(F.col("id").rlike("^[A-Za-z0-9_-]{21}$")).alias("fits"))


@query("SELECT o_orderkey, CASE WHEN k < 128 THEN printf('%02X', k) WHEN k < 16384 THEN printf('%02X%02X', k % 128 + 128, k // 128) ELSE printf('%02X%02X%02X', k % 128 + 128, k // 128 % 128 + 128, k // 16384) END AS bytes FROM (SELECT o_orderkey, o_orderkey::BIGINT AS k FROM orders)")
def byte_varints(t):
    return t.orders.select("o_orderkey", texts.varint(F.col("o_orderkey")).alias("bytes"))


@query("SELECT n_nationkey, (n_nationkey + 2) * 3 - n_regionkey / 2.0::DOUBLE AS value, CAST(NULL AS DOUBLE) AS broken FROM nation")
def parse_arithmetic(t):
    """A grammar put together from small parsers."""
    read = texts.parsed(texts.arithmetic(), "double")
    return t.nation.select("n_nationkey", read(F.concat(F.lit("("), F.col("n_nationkey"), F.lit(" + 2) * 3 - "), F.col("n_regionkey"), F.lit("/2"))).alias("value"), read(F.concat(F.lit("1 + ("), F.col("n_nationkey"))).alias("broken"))


@query("SELECT n_nationkey, [0, 1, 0, 1, 2]::INTEGER[] AS colors, CAST(NULL AS INTEGER[]) AS none FROM nation")
def constraint_colors(t):
    """A ring of five in three colours, by backtracking; and three that all differ in two."""
    three, two = F.array(*[F.lit(x) for x in range(3)]), F.array(F.lit(0), F.lit(1))
    pairs = lambda *p: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in p])
    return t.nation.select("n_nationkey", texts.assignment(F.array_repeat(three, 5), pairs((0, 1), (1, 2), (2, 3), (3, 4), (4, 0))).alias("colors"), texts.assignment(F.array_repeat(two, 3), pairs((0, 1), (1, 2), (0, 2))).alias("none"))


_NOW = "TIMESTAMP '2024-01-20'"


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE ts <= {_NOW}) WHERE i = 1 AND event_type <> 'error' AND {_NOW} < ts + to_hours(CAST(6 + user_id % 24 AS BIGINT))")
def cache_live(t):
    """Entries that live six hours or more after they were written; an error takes its entry out."""
    ttl = F.make_dt_interval(F.lit(0), (F.col("user_id") % 24 + 6).cast("int"))
    return stores.live_entries(t.events, "user_id", "ts", F.expr(_NOW), ttl, "event_id", gone=F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY l DESC, user_id) AS INTEGER) AS place, uses FROM (SELECT user_id, max((ts, event_id)) AS l, count(*) AS uses FROM events GROUP BY 1) ORDER BY l DESC, user_id LIMIT 12")
def cache_recent(t):
    return stores.recent_keys(t.events, "user_id", 12, "ts", "event_id")


@query("SELECT user_id, uses FROM (SELECT user_id, max((ts, event_id)) AS l, count(*) AS uses FROM events GROUP BY 1) ORDER BY uses DESC, l DESC, user_id LIMIT 12")
def cache_frequent(t):
    return stores.frequent_keys(t.events, "user_id", 12, "ts", "event_id")


@query("SELECT event_id, s.who FROM (SELECT event_id, event_type || '.' || user_id % 3 AS topic FROM events) m JOIN (VALUES ('all', '*'), ('clicks', 'click.*'), ('one', 'view.1'), ('none', 'vie.*')) s(who, pattern) ON pattern = '*' OR topic = pattern OR (pattern LIKE '%.*' AND starts_with(topic, substr(pattern, 1, length(pattern) - 1)))")
def topic_delivery(t):
    subscriptions = t.spark.createDataFrame([("all", "*"), ("clicks", "click.*"), ("one", "view.1"), ("none", "vie.*")], "who string, pattern string")
    messages = t.events.select("event_id", F.concat("event_type", F.lit("."), F.col("user_id") % 3).alias("topic"))
    return stores.delivered(messages, subscriptions).select("event_id", "who")


_STATE = "(SELECT user_id, event_type AS field, arg_max(value, event_id) AS value FROM events WHERE event_id <= {n} GROUP BY 1, 2)"


@query(f"SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.field, b.field) AS field, a.value AS old, b.value AS new, CASE WHEN a.user_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM {_STATE.format(n=500)} a FULL JOIN {_STATE.format(n=800)} b ON a.user_id = b.user_id AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value")
def state_snapshots(t):
    """Fields of each user as they were after 500 events and after 800, and what differs."""
    log = t.events.withColumnRenamed("event_type", "field")
    at = lambda n: stores.state_at(log, "user_id", "field", "value", "event_id", F.lit(n))
    return stores.state_changes(at(500), at(800), ["user_id", "field"], "value")


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'P' AS ok FROM orders), f AS (SELECT o_custkey, min(o_orderkey) AS k FROM s WHERE NOT ok GROUP BY 1), r AS (SELECT s.o_custkey, o_orderkey, CASE WHEN k IS NULL THEN 'done' WHEN o_orderkey = k THEN 'failed' WHEN o_orderkey < k THEN 'compensated' ELSE 'skipped' END AS outcome FROM s LEFT JOIN f USING (o_custkey)) SELECT o_custkey, o_orderkey, outcome, CASE WHEN outcome = 'compensated' THEN CAST(row_number() OVER (PARTITION BY o_custkey, outcome ORDER BY o_orderkey DESC) AS INTEGER) END AS undo FROM r")
def saga_outcomes(t):
    return stores.saga_steps(t.orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey", "outcome", "undo")


@query("SELECT c_custkey AS id, min(p_size) AS low, max(p_size) AS high, sum(p_size)::BIGINT AS total FROM customer JOIN part ON p_partkey - 1 BETWEEN c_custkey % 150 AND c_custkey % 150 + c_custkey % 37 GROUP BY 1")
def range_queries(t):
    """Least, greatest and sum of parts' sizes over a range for each customer, from blocks."""
    blocks = stores.range_blocks(t.part.select((F.col("p_partkey") - 1).alias("at"), F.col("p_size").cast("long").alias("size")), "at", "size", 8)
    asked = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).alias("a"), (F.col("c_custkey") % 150 + F.col("c_custkey") % 37).alias("z"))
    return stores.range_aggregates(asked, blocks, "id", "a", "z", 8).select("id", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "total")


@query("SELECT p AS probe, (SELECT count(*) FROM lineitem WHERE l_quantity < p) AS first, (SELECT count(*) FROM lineitem WHERE l_quantity <= p) AS last FROM (SELECT DISTINCT n_nationkey * 2.5::DOUBLE AS p FROM nation)")
def search_places(t):
    """Where each probe stands among sorted values, as a binary search finds it."""
    return stores.places(t.lineitem, "l_quantity", t.nation.select((F.col("n_nationkey") * 2.5).alias("probe")), "probe")


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error')")
def entity_query(t):
    return stores.with_components(t.events, "user_id", "event_type", ["click", "purchase"], ["error"])


@query("SELECT i AS n_nationkey, coalesce(n_regionkey, 0) AS n_regionkey FROM range(0, 40) r(i) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON i = n_nationkey")
def array_dense(t):
    return stores.dense(t.nation.where("n_nationkey % 2 = 0"), "n_nationkey", "n_regionkey", 40)


@query("SELECT o_custkey, o_orderkey, sum(d) OVER w - d AS start, sum(d) OVER w AS end FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 9 + 1)::DOUBLE AS d FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def queue_schedule(t):
    return stores.scheduled(t.orders.withColumn("d", F.col("o_orderkey") % 9 + 1), "o_custkey", "d", "o_orderkey")


@query("SELECT n_regionkey, count(*) + 1 AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def steps_wrapped(t):
    """Steps one after another within middleware that filters before and adds after."""
    def outer(df, inner):
        return inner(df.where("n_nationkey > 3")).withColumn("n", F.col("n") + 1)

    return stores.piped(t.nation, stores.wrapped(lambda df: df.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), outer))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS square FROM lineitem")
def steps_memoized(t):
    return stores.memoized(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "square", lambda df: F.col("l_quantity") * F.col("l_quantity")).drop("l_quantity")


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS maybe FROM customer")
def sketch_cuckoo(t):
    """All customers go in and every third is taken out again; with 30 bits none is found by chance here."""
    keys = t.customer.select("c_custkey")
    made = lambda df: filters.cuckoo_table(df, "c_custkey", 200_000, 30)
    left = filters.cuckoo_without(made(keys), made(keys.where("c_custkey % 3 = 0")))
    return filters.cuckoo_has(keys, left, "c_custkey", 200_000, 30)


@query("SELECT count(*) AS found, true AS rare FROM customer")
def sketch_xor(t):
    """All customers are found, and of as many others one in 256 or so."""
    keys = t.customer.select("c_custkey")
    made = filters.xor_filter(keys, "c_custkey", 4)
    asked = keys.unionAll(keys.select(F.col("c_custkey") + 10_000_000))
    got = filters.xor_has(asked, made, "c_custkey", 4)
    inside = F.col("c_custkey") < 10_000_000
    return got.agg(F.count(F.when(inside & F.col("maybe"), 1)).alias("found"), (F.count(F.when(~inside & F.col("maybe"), 1)) < 0.04 * F.count(F.when(~inside, 1)) + 3).alias("rare"))


@query("SELECT n_regionkey AS book, n_name AS text, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS page FROM nation")
def pdf_round_trip(t):
    """A file for each region with a page for each nation, written and read."""
    pages = t.nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("p"))
    files = pages.select(F.col("n_regionkey").alias("path"), pdf.pdf_of(F.col("p")).alias("content"))
    return pdf.read_pdf(files).select(F.col("path").alias("book"), "page", "text")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'heading' WHEN s_suppkey % 10 = 9 THEN 'footnote' WHEN s_suppkey % 10 = 5 THEN 'list' ELSE 'paragraph' END AS role FROM supplier")
def layout_roles(t):
    n = F.col("s_suppkey") % 10
    lines = t.supplier.select("s_suppkey", F.floor(F.col("s_suppkey") / 10).alias("page"), F.when(n == 0, 18.0).when(n == 9, 8.0).otherwise(11.0).alias("size"), F.when(n == 5, F.concat(F.lit("- "), "s_name")).otherwise(F.col("s_name")).alias("text"), (n * 80.0).alias("y"))
    return pdf.line_roles(lines, "page", "size", "text", "y", 800.0).select("s_suppkey", "role")


@query("SELECT n_nationkey, 'total 1050 hello' || chr(10) || 'world-wide example ' || n_nationkey AS text FROM nation")
def text_repaired(t):
    return t.nation.select("n_nationkey", pdf.repaired(F.concat(F.lit("total 1O50  he1lo\nworld-wide exam-\nple "), F.col("n_nationkey").cast("string"))).alias("text"))


@query("SELECT n_nationkey, '{\"name\":\"x\",\"keys\":[' || n_regionkey || ',9]}' AS patched FROM nation")
def json_patches(t):
    doc = F.concat(F.lit('{"name": "'), F.col("n_name"), F.lit('", "keys": ['), F.col("n_regionkey"), F.lit("]}"))
    ops = F.lit('[{"op": "replace", "path": "/name", "value": "x"}, {"op": "add", "path": "/keys/-", "value": 9}]')
    return t.nation.select("n_nationkey", F.regexp_replace(serial.json_patch(doc, ops), r"([:,])\s+", "$1").alias("patched"))


@query("SELECT n_nationkey, n_nationkey < 5 AS wrong FROM nation")
def json_schemas(t):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5}}}
    return t.nation.select("n_nationkey", (F.size(serial.json_schema_errors(F.concat(F.lit('{"k": '), F.col("n_nationkey"), F.lit("}")), schema)) > 0).alias("wrong"))


@query("SELECT p_partkey, p_type AS text FROM part")
def byte_windows(t):
    """Text as references into what went before, and back."""
    return t.part.select("p_partkey", serial.unlz77(serial.lz77(F.col("p_type"))).alias("text"))


@query("SELECT n_nationkey, 6 AS pairs, 6 AS orders, 16 AS subsets FROM nation")
def arr_combinations(t):
    a = F.array(*[F.col("n_nationkey") * i for i in range(1, 5)])
    return t.nation.select("n_nationkey", F.size(serial.combinations(a.cast("array<string>"), F.lit(2))).alias("pairs"), F.size(serial.permutations(F.slice(a, 1, 3).cast("array<string>"))).alias("orders"), F.size(serial.power_set(a)).alias("subsets"))


@query("SELECT n_nationkey, 'A ' || n_name AS heading, n_name AS link FROM nation")
def markdown_parts(t):
    md = F.concat(F.lit("# A "), F.col("n_name"), F.lit("\n\nsome *text* ["), F.col("n_name"), F.lit("](http://x.y/z)\n"))
    return t.nation.select("n_nationkey", documents.markdown_headings(md)[0]["text"].alias("heading"), documents.markdown_links(md)[0]["text"].alias("link"))
