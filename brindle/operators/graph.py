"""Graph operators over edges (src, dst, weight), as joins and aggregations that iterate to a fixpoint.

Each round's rows are written to spark.checkpoint.dir, so plans stay short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut by writing the rows to the shared folder that the cluster names; where none is named and all tasks run in this process, as in tests, to one of our own.

    Rows are read back as files, whose size is known: a Spark checkpoint hands on the estimate, and that of a join is the product of
    its sides, so in a loop its digits double with each round until they fill the driver's memory.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/brindle-{sc.applicationId}-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_cut = path
    return out


def _drop(df: DataFrame) -> None:
    """Delete what _cut wrote for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._brindle_cut)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree by one union and one aggregation."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (its smallest node), by min labels that also jump to their label's label."""
    cols = edges.columns
    e = undirected(edges.select(F.col(cols[0]).alias("src"), F.col(cols[1]).alias("dst")))
    label = _cut(e.groupBy("src").agg(F.least("src", F.min("dst")).alias("component")).withColumnRenamed("src", "node"))
    e = _cut(e)
    for _ in range(rounds):
        low = e.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("_low"))
        new = label.join(low, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("_low", "component")).alias("component"))
        up = new.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        new = _cut(new.join(up, F.col("component") == F.col("_n"), "left").select("node", F.least("component", F.coalesce("_up", "component")).alias("component")))
        changed = new.join(label.select("node", F.col("component").alias("_old")), "node").where("component <> _old").limit(1).count()
        _drop(label)
        label = new
        if not changed:
            _drop(e)
            return label
    raise RuntimeError("components did not settle")


def bfs(edges: DataFrame, start, rounds: int = 1000) -> DataFrame:
    """node and level, the steps from ``start``: a frontier join for each level."""
    e = edges.select("src", "dst").distinct()
    kind = dict(edges.dtypes)["src"]
    seen = edges.sparkSession.createDataFrame([(start, 0)], f"node {kind}, level int")
    front = seen
    for level in range(1, rounds + 1):
        nxt = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        front = _cut(nxt)
        if front.limit(1).count() == 0:
            return seen
        seen = _cut(seen.unionAll(front))
    raise RuntimeError("more levels than asked for")


def shortest_paths(edges: DataFrame, start, rounds: int = 1000) -> DataFrame:
    """node and distance from ``start`` by relaxation until nothing shrinks. Negative weights are allowed; a negative cycle raises."""
    e = edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    kind = dict(edges.dtypes)["src"]
    best = edges.sparkSession.createDataFrame([(start, 0.0)], f"node {kind}, distance double")
    for _ in range(rounds):
        step = best.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        new = _cut(best.unionAll(step).groupBy("node").agg(F.min("distance").alias("distance")))
        same = new.join(best.withColumnRenamed("distance", "_old"), "node", "left").where("_old is null or distance < _old").limit(1).count() == 0
        best = new
        if same:
            return best
    raise RuntimeError("a negative cycle, or longer paths than asked for")


def topological_layers(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node and layer: nodes without incoming edges, then those that only they lead to, and so on. A cycle raises."""
    e = edges.select("src", "dst").distinct()
    left = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = None
    for layer in range(rounds):
        free = _cut(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.limit(1).count() == 0:
            if left.limit(1).count():
                raise ValueError("the graph has a cycle")
            break
        row = free.withColumn("layer", F.lit(layer))
        out = row if out is None else out.unionAll(row)
        left = _cut(left.join(free, "node", "left_anti"))
        e = _cut(e.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
    return out if out is not None else left.withColumn("layer", F.lit(0))


def has_cycle(edges: DataFrame) -> bool:
    try:
        topological_layers(edges)
    except ValueError:
        return True
    return False


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node and rank; what nodes without outgoing edges hold is dealt out to all."""
    e = edges.select("src", "dst").distinct()
    nodes = _cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = _cut(e.join(out, "src"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        given = rank.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        given = _cut(given)
        idle = 1 - (given.agg(F.sum("got")).first()[0] or 0.0)
        rank = _cut(nodes.join(given, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + idle / n)).alias("rank")))
    return rank


def minimum_spanning_tree(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Edges of a minimum spanning forest by Boruvka's rounds: each component takes its lightest edge out; ties by ends.

    After each round the edges are relabelled by component and only the lightest between two components stays, so the graph shrinks.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("weight")).where("a <> b")
    light = lambda df: _cut(df.groupBy("a", "b").agg(F.min(F.struct("weight", "src", "dst")).alias("m")).select("a", "b", "m.*"))
    e = light(e.withColumns({"src": F.col("a"), "dst": F.col("b")}))
    tree = e.limit(0).select("src", "dst", "weight")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "src", "dst"))
        picked = _cut(both.groupBy("a").agg(F.min(F.struct("weight", "src", "dst", "b")).alias("m")).select("a", "m.b", "m.weight", "m.src", "m.dst"))
        if picked.limit(1).count() == 0:
            return tree
        tree = _cut(tree.unionByName(picked.select("src", "dst", "weight").distinct()))
        comp = components(picked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        of = lambda n, c: comp.select(F.col("node").alias(n), F.col("component").alias(c))
        moved = e.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        e = light(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight", "src", "dst"))
    raise RuntimeError("more rounds than asked for")


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c of every triangle.

    Edges lead from the node of the smaller degree to the other, so that no node leads to more than some root of
    the number of edges, and a hub makes no pairs of its neighbours; pairs led to from one node are closed by a join.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    of = lambda n: degree.select(F.col("node").alias(n), F.struct("d", "node").alias(f"r{n}"))
    ranked = e.join(of("a"), "a").join(of("b"), "b")
    low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
    led = _cut(ranked.select(low["node"].alias("u"), high["node"].alias("v"), high["d"].alias("d")))
    pairs = led.join(led.select("u", F.col("v").alias("w"), F.col("d").alias("dw")), "u").where("struct(d, v) < struct(dw, w)").select("u", "v", "w")
    closed = pairs.join(led.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    nodes = F.array_sort(F.array("u", "v", "w"))
    return closed.select(nodes[0].alias("a"), nodes[1].alias("b"), nodes[2].alias("c"))
