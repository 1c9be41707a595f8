"""Queries of paths, curves, rollouts, books, networks and learning programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import learning, networks
from ..sources import books
from .base import Tables, query


@query("SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, split_part(rtrim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/'), '/', -1) AS base FROM pages")
def path_parts(t: Tables):
    p = F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    return t.pages.select("page_id", paths.normalize(paths.join(p, F.lit("x/.."), F.lit("."))).alias("path"), paths.base_name(p).alias("base"))


@query("SELECT n_nationkey, round(pow(n_nationkey / 24.0, 3), 6) AS cubic, round(1 - pow(1 - n_nationkey / 24.0, 2), 6) AS quad, round(CASE WHEN n_nationkey / 24.0 < 0.5 THEN (1 - cos(n_nationkey / 24.0 * pi())) / 2 ELSE 1 - (1 - cos((1 - n_nationkey / 24.0) * pi())) / 2 END, 6) AS sine FROM nation")
def ease_curves(t):
    x = F.col("n_nationkey") / 24.0
    return t.nation.select("n_nationkey", *[F.round(paths.ease(k, x), 6).alias(n) for n, k in (("cubic", "cubic_in"), ("quad", "quad_out"), ("sine", "sine_in_out"))])


@query()
def rollout_flags(t):
    return t.customer.select("c_custkey", paths.in_rollout("beta", F.col("c_custkey"), 25, ["1", "2"]).alias("enabled"))


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN 'deny' WHEN c_mktsegment = 'BUILDING' OR c_nationkey = 7 THEN 'allow' ELSE 'deny' END AS effect FROM customer")
def access_attributes(t):
    rules = [("allow", {"c_mktsegment": "BUILDING"}), ("allow", {"c_nationkey": 7}), ("deny", {"c_nationkey": [3, 4]})]
    return t.customer.select("c_custkey", paths.rule_effect(rules).alias("effect"))


@query("SELECT 'book.epub' AS path, CAST(n_nationkey + 1 AS INTEGER) AS page, n_name || chr(10) || 'about ' || n_name AS text FROM nation")
def book_round_trip(t):
    """Nations as chapters of a book that is written, and read again as pages."""
    data = books.epub("Nations", t.nation.withColumn("about", F.concat(F.lit("about "), F.col("n_name"))), "n_name", "about", "n_nationkey")
    files = t.spark.createDataFrame([("book.epub", data)], "path string, content binary")
    return books.read_pages(files).select("path", "page", "text")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def byte_frames(t):
    framed = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", books.frame(F.col("n_name").cast("binary")).alias("f")))).alias("x"))
    stream = F.aggregate(F.transform("x", lambda i: i["f"]), F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return framed.select("n_regionkey", F.array_join(F.transform(books.unframe(stream), lambda b: b.cast("string")), ",").alias("names"))


def _ring(t):
    return t.nation.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("s")).select("src", ((F.col("src") + F.col("s")) % 25).alias("dst"), (F.col("src") % 4 + 1).cast("double").alias("weight"))


@query("SELECT true AS valid")
def graph_coloring(t):
    valid = networks.is_valid_coloring(_ring(t), networks.coloring(_ring(t)))
    return t.spark.createDataFrame([(valid,)], "valid boolean")


@query("SELECT true AS equal")
def graph_max_flow(t):
    """The greatest flow is the capacity of the minimum cut."""
    f = networks.max_flow(_ring(t), 0, 12)
    cut = f.where("cut").join(_ring(t), ["src", "dst"]).agg(F.sum("weight").alias("c"))
    out = f.where("src = 0").agg(F.sum("flow").alias("f"))
    into = f.where("dst = 0").agg(F.sum("flow").alias("i"))
    return cut.crossJoin(out).crossJoin(into).select((F.abs(F.col("c") - (F.col("f") - F.col("i"))) < 1e-9).alias("equal"))  # one row each


@query("SELECT range::INTEGER AS step FROM range(0, 21)")
def grid_path(t):
    cells = t.spark.range(11).select(F.col("id").alias("x")).crossJoin(t.spark.range(11).select(F.col("id").alias("y"))).where("x = 0 or y = 10 or (x + y) % 2 = 0")  # a grid
    return networks.grid_path(cells, (0, 0), (10, 10)).select("step")


@query("SELECT o_orderkey, o_orderstatus AS predicted FROM orders")
def learn_decision_tree(t):
    """A label that follows from two attributes is learnt without error."""
    rows = t.orders.select("o_orderkey", F.ascii(F.substring("o_orderstatus", 1, 1)).alias("code"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("status"))
    rows = rows.withColumns({"a": F.col("code") % 2, "b": F.floor(F.col("code") / 2) % 4})
    tree = learning.train_tree(rows.select("a", "b", "code", "p", "status"), ["p", "a", "b", "code"], "status")
    return rows.select("o_orderkey", learning.predict_tree(tree).alias("predicted"))


@query("SELECT round(0.5 * 0.9 * 0.8 / (0.5 * 0.9 * 0.8 + 0.5 * 0.2 * 0.1), 6) AS p")
def learn_bayes_network(t):
    network = {"rain": ((), {(): 0.5}), "wet": (("rain",), {(True,): 0.9, (False,): 0.2}), "late": (("rain",), {(True,): 0.8, (False,): 0.1})}
    p = learning.bayes_query(network, "rain", True, {"wet": True, "late": True})
    return t.spark.createDataFrame([(round(p, 6),)], "p double")


@query("SELECT n_nationkey, round(1 / (1 + exp(-(2 / (1 + exp(-(n_nationkey / 10.0 - 1))) - 0.5))), 6) AS out FROM nation")
def learn_perceptron(t):
    layers = [([[1.0]], [-1.0]), ([[2.0]], [-0.5])]
    return t.nation.select("n_nationkey", F.round(learning.perceptron([F.col("n_nationkey") / 10.0], layers)[0], 6).alias("out"))


@query()
def text_language(t):
    return t.documents.select("doc_id", learning.detect_language(F.col("text")).alias("guess"))


@query()
def text_confidence(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = t.documents.select("doc_id", F.explode(words).alias("w")).select("doc_id", learning.word_confidence(F.col("w")).alias("c"))
    return rows.groupBy("doc_id").agg(F.round(F.avg("c"), 4).alias("confidence"), F.count_if(F.col("c") < 0.6).alias("low"))
