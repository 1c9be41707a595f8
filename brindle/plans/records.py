"""Queries of replicated values, access rules, queues, state machines, diffs, checks and solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, diffs, solvers
from ..operators import records
from ..sources import sinks
from .base import Tables, query


@query("SELECT n_nationkey, greatest(n_nationkey, 7) AS a, greatest(n_regionkey, 2) AS b, (n_nationkey <= 7 AND n_regionkey <= 2) AND NOT (7 <= n_nationkey AND 2 <= n_regionkey) AS before, NOT (n_nationkey <= 7 AND n_regionkey <= 2) AND NOT (7 <= n_nationkey AND 2 <= n_regionkey) AS concurrent FROM nation")
def clock_vectors(t: Tables):
    own = F.create_map(F.lit("a"), F.col("n_nationkey").cast("long"), F.lit("b"), F.col("n_regionkey").cast("long"))
    other = F.create_map(F.lit("a"), F.lit(7).cast("long"), F.lit("b"), F.lit(2).cast("long"))
    m = records.clock_merge(own, other)
    return t.nation.select("n_nationkey", m["a"].alias("a"), m["b"].alias("b"), records.happens_before(own, other).alias("before"), records.is_concurrent(own, other).alias("concurrent"))


@query("SELECT DISTINCT user_id % 40 AS item FROM (SELECT user_id, event_id FROM events WHERE event_type <> 'error' EXCEPT SELECT user_id, event_id - 1 FROM events WHERE event_type = 'error')")
def crdt_observed_remove(t):
    """An error takes away the add of the event before it, if that is by the same user."""
    added = t.events.where("event_type <> 'error'").selectExpr("user_id as item", "event_id as tag")
    removed = t.events.where("event_type = 'error'").selectExpr("user_id as item", "event_id - 1 as tag")
    return records.observed_remove_set(added, removed).select((F.col("item") % 40).alias("item")).distinct()


@query("SELECT 'u' || n_nationkey AS subject, 'doc' || n_regionkey AS resource, 'read' AS permission, n_nationkey % 3 = 0 OR (n_nationkey % 5 = 0 AND n_regionkey = 1) AS allowed FROM nation")
def access_checks(t):
    who = F.concat(F.lit("u"), F.col("n_nationkey"))
    grants = t.nation.where("n_nationkey % 3 = 0").select(who.alias("subject"), F.lit("*").alias("resource"), F.lit("read").alias("permission"))
    grants = grants.unionAll(t.nation.where("n_nationkey % 5 = 0").select(who, F.lit("doc1"), F.lit("*")))
    return records.check_all(t.nation.select(who.alias("subject"), F.concat(F.lit("doc"), F.col("n_regionkey")).alias("resource"), F.lit("read").alias("permission")), grants)


@query("SELECT s_suppkey AS user, 'nation' || s_nationkey AS role FROM supplier UNION SELECT s_suppkey, 'region' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT s_suppkey, 'world' FROM supplier")
def access_roles(t):
    roles = t.supplier.select(F.col("s_suppkey").alias("user"), F.concat(F.lit("nation"), F.col("s_nationkey")).alias("role"))
    parents = t.nation.select(F.concat(F.lit("nation"), F.col("n_nationkey")).alias("role"), F.concat(F.lit("region"), F.col("n_regionkey")).alias("parent"))
    return records.inherited(roles, parents.unionAll(t.region.select(F.concat(F.lit("region"), F.col("r_regionkey")), F.lit("world"))))


@query("SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END DESC, ts, event_id LIMIT 30")
def queue_priority(t):
    rows = t.events.withColumn("p", F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0))
    return records.dequeue(rows, 30, "p", "ts", "event_id").select("event_id")


@query("SELECT count(*) FILTER (WHERE event_id % 4 + 1 < 3) AS again, count(*) FILTER (WHERE event_id % 4 + 1 >= 3) AS dead FROM events WHERE event_type = 'error'")
def queue_retries(t):
    again, dead = records.retried(t.events.withColumn("tries", F.col("event_id") % 4), F.col("event_type") == "error", "tries", 3)
    return again.select(F.lit(1).alias("a"), F.lit(0).alias("d")).unionAll(dead.select(F.lit(0), F.lit(1))).agg(F.sum("a").alias("again"), F.sum("d").alias("dead"))


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) // 86400000000 AS d, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, d, event_id, i, CASE WHEN value <= 100 THEN value ELSE 0 END AS used, value <= 100 AS granted FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.d, e.event_id, e.i, CASE WHEN f.used + e.value <= 100 THEN f.used + e.value ELSE f.used END, f.used + e.value <= 100 FROM f JOIN e ON e.user_id = f.user_id AND e.d = f.d AND e.i = f.i + 1) SELECT event_id, granted FROM f")
def quota_daily(t):
    return records.quota_use(t.events, "user_id", "ts", "value", 86400, 100.0, "event_id").select("event_id", "granted")


_STEPS = {("new", "view"): "seen", ("seen", "click"): "warm", ("warm", "purchase"): "buyer", ("buyer", "error"): "new", ("seen", "error"): "new"}


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, 'new' AS state FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN f.state = 'new' AND event_type = 'view' THEN 'seen' WHEN f.state = 'seen' AND event_type = 'click' THEN 'warm' WHEN f.state = 'warm' AND event_type = 'purchase' THEN 'buyer' WHEN f.state IN ('buyer', 'seen') AND event_type = 'error' THEN 'new' ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, state FROM f WHERE i > 0")
def state_machine(t):
    return records.state_machine(t.events, "user_id", "event_type", "new", _STEPS, "ts", "event_id").select("event_id", "state")


@query("WITH c AS (SELECT DISTINCT p_size AS x, p_partkey AS y FROM part), n AS (SELECT x + i AS x, y + j AS y, sum(CASE WHEN i = 0 AND j = 0 THEN 0 ELSE 1 END) AS n, max(CASE WHEN i = 0 AND j = 0 THEN 1 ELSE 0 END) AS alive FROM c, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) GROUP BY 1, 2) SELECT x::BIGINT AS x, y::BIGINT AS y FROM n WHERE n = 3 OR (n = 2 AND alive = 1)")
def grid_life(t):
    return records.life_step(t.part.select(F.col("p_size").cast("long").alias("x"), F.col("p_partkey").cast("long").alias("y")).distinct())


@query()
def grid_automaton(t):
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.floor(F.col("n_nationkey") * 977 / F.pow(F.lit(2), i)) % 2).cast("int"))
    return t.nation.select("n_nationkey", records.automaton_step(cells, 110).alias("next"))


@query("WITH RECURSIVE e AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), f AS (SELECT n_regionkey, n_nationkey, i, sha256(repeat('0', 64) || n_name) AS hash FROM e WHERE i = 1 UNION ALL SELECT e.n_regionkey, e.n_nationkey, e.i, sha256(f.hash || e.n_name) FROM f JOIN e ON e.n_regionkey = f.n_regionkey AND e.i = f.i + 1) SELECT n_regionkey, n_nationkey, hash FROM f")
def hash_chain(t):
    return records.hash_chain(t.nation, "n_regionkey", "n_name", "n_nationkey")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'removed' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM pages")
def compare_pages(t):
    after = t.pages.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"))
    return records.compare_pages(t.pages, after, "page_id", "html")


@query("SELECT p, string_agg(line, chr(10) ORDER BY l) AS text FROM (SELECT s_nationkey AS p, s_suppkey // 10 AS l, string_agg(s_name, ' ' ORDER BY s_suppkey % 10) AS line FROM supplier GROUP BY 1, 2) GROUP BY p")
def layout_reading_order(t):
    items = t.supplier.select(F.col("s_nationkey").alias("p"), (F.col("s_suppkey") % 10 * 12.0).alias("x"), (F.floor(F.col("s_suppkey") / 10) * 14.0 + 2).alias("y"), "s_name")
    return records.reading_order(items, "p", "x", "y", "s_name", 14.0)


@query("SELECT 1 AS page, s_suppkey // 10 AS \"row\", s_suppkey % 10 AS \"column\", s_name AS text FROM supplier")
def layout_tables(t):
    items = t.supplier.select(F.lit(1).alias("page"), (F.col("s_suppkey") % 10 * 50.0 + 3).alias("x"), (F.floor(F.col("s_suppkey") / 10) * 14.0 + 2).alias("y"), "s_name")
    return records.detect_tables(items, "page", "x", "y", "s_name", 14.0, 50.0)


@query("SELECT n_nationkey, true AS patched, true AS empty FROM nation")
def diff_patches(t):
    old = F.concat(F.lit("a\nb\nc\n"), F.col("n_name"), F.lit("\nd\ne\nf\ng\nh"))
    new = F.concat(F.lit("a\nc\n"), F.lower("n_name"), F.lit("\nd\ne\nf\ng\nmore\nh"))
    return t.nation.select("n_nationkey", (diffs.apply_patch(old, diffs.create_patch(old, new)) == new).alias("patched"), (diffs.create_patch(old, old) == "").alias("empty"))


@query()
def diff_words(t):
    return t.nation.select("n_nationkey", diffs.diff_words(F.concat(F.lit("one two "), F.col("n_name")), F.concat(F.lit("one 2 "), F.col("n_name"))).alias("chunks"))


@query("SELECT n_nationkey, 'Dear ' || n_name || ': ' || n_regionkey || ',' || n_nationkey || ',' AS text FROM nation")
def template_render(t):
    data = F.to_json(F.struct(F.col("n_name").alias("name"), F.array("n_regionkey", "n_nationkey").alias("keys")))
    return t.nation.select("n_nationkey", diffs.render(F.lit("Dear {{name}}: {{#keys}}{{.}},{{/keys}}{{^keys}}none{{/keys}}"), data).alias("text"))


@query("SELECT p_partkey, len(regexp_extract_all(p_name, '[A-Za-z]+')) AS words, len(regexp_extract_all(p_name, '[0-9]+')) AS numbers FROM part")
def lexer_tokens(t):
    tokens = diffs.lexer([("word", "[A-Za-z]+"), ("number", "[0-9]+"), ("", r"\s+")])(F.col("p_name"))
    rows = t.part.select("p_partkey", tokens.alias("t"))
    count = lambda kind: F.size(F.filter("t", lambda x: x["type"] == kind)).cast("long")
    return rows.select("p_partkey", count("word").alias("words"), count("number").alias("numbers"))


@query("SELECT p_partkey, (length(p_type) - length(replace(p_type, 'E', ''))) // 1 AS es FROM part")
def multi_pattern(t):
    return t.part.select("p_partkey", F.size(F.filter(diffs.find_patterns(F.col("p_type"), ["E", "ZZ"]), lambda m: m["word"] == "E")).cast("long").alias("es"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'zero' WHEN p_partkey % 3 = 1 THEN 'one' ELSE 'two' END AS state FROM part")
def automaton_remainders(t):
    """A text of decimal digits read by the automaton of remainders by three."""
    names = ["zero", "one", "two"]
    steps = {(names[r], str(d)): names[(r * 10 + d) % 3] for r in range(3) for d in range(10)}
    return t.part.select("p_partkey", diffs.run_automaton(F.col("p_partkey").cast("string"), "zero", steps).alias("state"))


@query("SELECT p_partkey, p_partkey % 300 <= 255 AS ip, regexp_matches('#' || lower(printf('%06x', p_partkey)), '^#[0-9a-f]{6}$') AS color, p_partkey // 65536 % 256 AS r, p_partkey // 256 % 256 AS g, p_partkey % 256 AS b FROM part")
def check_values(t):
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex("p_partkey")), 6, "0"))
    ip = F.concat(F.lit("10.0.0."), (F.col("p_partkey") % 300).cast("string"))
    c = checks.rgb(code)
    return t.part.select("p_partkey", checks.is_ipv4(ip).alias("ip"), checks.is_hex_color(code).alias("color"), *[c[x].cast("long").alias(x) for x in "rgb"])


@query()
def check_more(t):
    n = F.col("n_nationkey")
    rgb = [(n * 7 % 256), (n * 31 % 256), (n * 101 % 256)]
    return t.nation.select("n_nationkey", checks.luhn((F.lit(4111111111111100) + n).cast("string")).alias("luhn"), checks.is_ipv6(F.concat(F.lit("fe80::"), F.hex(n))).alias("v6"), checks.hsl(*rgb).alias("hsl"), F.round(checks.luminance(*rgb), 6).alias("light"), checks.mime_type(F.lit("a/b.PDF")).alias("mime"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey // 5 WHEN n_nationkey < 5 THEN n_nationkey ELSE n_nationkey // 5 + n_nationkey % 5 END AS coins, n_nationkey <= 10 AS sums FROM nation")
def dynamic_programs(t):
    coins, four = F.array(F.lit(1), F.lit(5)), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    return t.nation.select("n_nationkey", solvers.coin_change(coins, F.col("n_nationkey")).cast("long").alias("coins"), solvers.subset_sum(four, F.col("n_nationkey")).alias("sums"))


@query()
def numeric_programs(t):
    xs = F.array(*[F.lit(float(x)) for x in range(6)])
    ys = F.array(*[(F.col("n_nationkey") * x % 7).cast("double") for x in range(6)])
    return t.nation.select("n_nationkey", solvers.cubic_spline(xs, ys, F.array(F.lit(0.5), F.lit(2.25))).alias("spline"), solvers.denoise(ys, F.lit(0.5)).alias("smooth"), solvers.longest_rising(ys).alias("rising"), solvers.bezier([ys[0], ys[1], ys[2], ys[3]], F.lit(0.25)).alias("bezier"), solvers.matrix_chain(F.array(F.lit(10), F.col("n_nationkey") + 1, F.lit(5), F.lit(60))).alias("chain"), solvers.knapsack(F.array(F.lit(1), F.lit(3), F.lit(4)), F.array(F.lit(15), F.lit(20), F.lit(30)), F.col("n_nationkey")).alias("value"))


@query()
def monte_carlo(t):
    return solvers.estimate_pi(t.spark, 100_000).crossJoin(solvers.integrate(t.spark, "x ^ 2", 0, 3, 100_000))  # one row each


@query("SELECT n_nationkey, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS html, '<nation><key>' || n_nationkey || '</key><name>' || n_name || '</name></nation>' AS xml FROM nation")
def sink_records(t):
    return t.nation.select("n_nationkey", sinks.html_row(F.col("n_nationkey"), F.col("n_name")).alias("html"), sinks.xml_record("nation", key=F.col("n_nationkey"), name=F.col("n_name")).alias("xml"))
