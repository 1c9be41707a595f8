"""Vector search, classification and clustering over array columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import maths


def _query_literal(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def search(df: DataFrame, id: str, vector: str, query: Sequence[float], k: int = 10) -> DataFrame:
    """id and cosine of the k nearest to one query; each task keeps k. Vectors of another length raise."""
    score = F.when(F.size(vector) == len(query), maths.cosine(F.col(vector), _query_literal(query))).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return df.select(id, score.alias("score")).orderBy(F.desc("score"), id).limit(k)


def search_threshold(df: DataFrame, id: str, vector: str, query: Sequence[float], threshold: float) -> DataFrame:
    return df.select(id, maths.cosine(F.col(vector), _query_literal(query)).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), id)


def search_many(queries: DataFrame, df: DataFrame, id: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """The k nearest (cosine) of every query row, over all rows: query, id, score.

    The queries are sent to the tasks in blocks of at most ``block``; each task multiplies its rows by a
    block and hands on k for each query, which are merged by a top-k of each query.
    """
    spark, out = df.sparkSession, None
    part: list = []
    rows = queries.select(F.col(id).alias("query"), vector).toLocalIterator()

    def searched(held: list) -> DataFrame:
        names = [r["query"] for r in held]
        q = np.array([r[vector] for r in held], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list | None = None
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array(b.column(vector).to_pylist(), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                ids = np.array(b.column(id).to_pylist(), dtype=object)
                order = np.argsort(ids, kind="stable")  # so that of equal scores the smaller ids are kept
                s = (q @ x.T)[:, order]
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, who = np.take_along_axis(s, at, 1), ids[order][at]
                if best is not None:
                    s, who = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], who], axis=1)
                    rank = np.unique(who, return_inverse=True)[1].reshape(who.shape)
                    at = np.lexsort((rank, -s), axis=1)[:, :k]
                    s, who = np.take_along_axis(s, at, 1), np.take_along_axis(who, at, 1)
                best = [s, who]
            if best is not None:
                m = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([n for n in names for _ in range(m)], arrow), pa.array(best[1].ravel().tolist(), arrow), pa.array(best[0].ravel())], names=["query", "id", "score"])

        arrow = to_arrow_type(df.schema[id].dataType)
        kind = df.schema[id].dataType.simpleString()
        found = df.select(id, vector).mapInArrow(run, f"query {kind}, id {kind}, score double")
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    for r in rows:
        part.append(r)
        if len(part) == block:
            out, part = searched(part) if out is None else out.unionAll(searched(part)), []
    if part:
        out = searched(part) if out is None else out.unionAll(searched(part))
    kind = df.schema[id].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")


def knn_predict(train: DataFrame, point: Sequence[float], vector: str, label: str, k: int, id: str) -> DataFrame:
    """The majority label of the k nearest by Euclidean distance; ties by the nearer sum, then label."""
    near = train.select(label, maths.euclidean(F.col(vector), _query_literal(point)).alias("d"), id).orderBy("d", id).limit(k)
    votes = near.groupBy(label).agg(F.count(F.lit(1)).alias("votes"), F.sum("d").alias("distance"))
    return votes.orderBy(F.desc("votes"), "distance", label).limit(1).select(label, "votes")


def nearest_centroid(centroids: Sequence[Sequence[float]], vector: Column) -> Column:
    """The index of the nearest of a few centroids."""
    distances = F.array(*[F.named_struct(F.lit("d"), maths.euclidean(vector, _query_literal(c)), F.lit("i"), F.lit(i)) for i, c in enumerate(centroids)])
    return F.array_min(distances)["i"]


def kmeans(df: DataFrame, vector: str, k: int, max_iter: int = 20, tol: float = 1e-6, id: str | None = None) -> list[list[float]]:
    """Lloyd's centroids. The first ones are the rows with the least hashes; an empty cluster keeps its own.

    A pass is one aggregation of k sums; the centroids are all that reaches the driver.
    """
    first = df.select(vector).orderBy(F.xxhash64(id or vector)).limit(k).collect()
    centroids = [[float(x) for x in r[0]] for r in first]
    for _ in range(max_iter):
        at = df.select(nearest_centroid(centroids, F.col(vector)).alias("c"), F.posexplode(vector).alias("i", "x"))
        rows = at.groupBy("c", "i").agg(F.avg("x").alias("m")).collect()  # k times the dimension
        new = [list(c) for c in centroids]
        for r in rows:
            new[r["c"]][r["i"]] = r["m"]
        moved = max((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 for x, y in zip(centroids, new)), default=0.0)
        centroids = new
        if moved <= tol:
            break
    return centroids


def dbscan(df: DataFrame, id: str, vector: str, eps: float, least: int) -> DataFrame:
    """id, cluster (the smallest core id in it, null for noise) and core; for few dimensions.

    Equal vectors are one point. Points of a cell of side eps / sqrt(dimensions) are all within eps of each other, so in a cell of
    ``least`` rows all are core, and only points of emptier cells are compared with those around them: fewer than ``least`` rows a cell.
    Cells are linked by their outermost core points; cells that this leaves in unlike clusters by all their core points in reach of each other.
    """
    from ..operators.graph import _cut, components

    v = F.col("v")
    points = df.select(F.col(id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    whole = points.where(v.isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    first = whole.select("v").first()
    dims = range(len(first[0]) if first else 0)
    side = eps / math.sqrt(len(dims) or 1) * (1 - 1e-9)
    far = math.floor(eps / side) + 1
    shifts = [s for s in product(range(-far, far + 1), repeat=len(dims)) if sum(max(0, abs(d) - 1) ** 2 for d in s) * side**2 <= eps**2 * (1 + 1e-6)]
    around = lambda some: F.explode(F.array(*[F.array(*[F.col("cell")[i] + F.lit(d).cast("long") for i, d in enumerate(s)]) for s in some]))
    near = lambda a, b: maths.euclidean(a, b) <= eps

    cell = F.array(*[F.floor(v[i] / side).cast("long") for i in dims])
    distinct = _cut(whole.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("cell", cell))
    distinct = _cut(distinct.join(distinct.groupBy("cell").agg(F.sum("n").alias("held")), "cell"))
    sparse = distinct.where(F.col("held") < least)
    other = distinct.select("cell", F.col("v").alias("w"), F.col("n").alias("m"))
    found = sparse.select("v", around(shifts).alias("cell")).join(other, "cell").where(near(v, F.col("w"))).groupBy("v").agg(F.sum("m").alias("m"))
    sparse = _cut(sparse.join(found, "v").select("v", "id", "cell", (F.col("m") >= least).alias("core")))
    core = distinct.where(F.col("held") >= least).select("v", "id", "cell").unionAll(sparse.where("core").select("v", "id", "cell"))

    ends = F.array(*[by(v, v[i]) for i in dims for by in (F.min_by, F.max_by)])
    cells = _cut(core.groupBy("cell").agg(F.min("id").alias("label"), ends.alias("ends"), *[F.array(*[of(v[i]) for i in dims]).alias(n) for n, of in (("low", F.min), ("high", F.max))]))
    side_of = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("cell", "label", "ends", "low", "high")]
    ahead = [s for s in shifts if s > (0,) * len(dims)]
    pairs = cells.select(*side_of("a"), around(ahead).alias("cell")).join(cells.select("cell", *side_of("b")), "cell").drop("cell") if ahead else None
    cluster = cells.select("cell", F.col("label").alias("cluster"))
    if pairs is not None:
        linked = F.exists("a_ends", lambda x: F.exists("b_ends", lambda y: near(x, y)))
        pairs = _cut(pairs.withColumn("linked", linked).drop("a_ends", "b_ends"))
        to = lambda roots, n: roots.select(F.col("node").alias("cluster"), F.col("component").alias(n))
        roots = components(pairs.where("linked").select("a_label", "b_label"))
        cluster = cluster.join(to(roots, "root"), "cluster", "left").select("cell", F.coalesce("root", "cluster").alias("cluster"))
        of = lambda p: cluster.select(F.col("cell").alias(f"{p}_cell"), F.col("cluster").alias(f"{p}_cluster"))
        left = _cut(pairs.where("not linked").join(of("a"), "a_cell").join(of("b"), "b_cell").where("a_cluster <> b_cluster"))
        if left.limit(1).count():
            gap = lambda p, box: F.sqrt(sum((F.pow(F.greatest(F.col(f"{box}_low")[i] - F.col(p)[i], F.col(p)[i] - F.col(f"{box}_high")[i], F.lit(0.0)), 2) for i in dims), F.lit(0.0)))
            reach = eps * (1 + 1e-9)
            x = left.join(core.select(F.col("cell").alias("a_cell"), F.col("v").alias("x")), "a_cell").where(gap("x", "b") <= reach)
            both = x.join(core.select(F.col("cell").alias("b_cell"), F.col("v").alias("y")), "b_cell").where((gap("y", "a") <= reach) & near(F.col("x"), F.col("y")))
            more = components(both.select("a_cluster", "b_cluster").distinct())
            cluster = cluster.join(to(more, "more"), "cluster", "left").select("cell", F.coalesce("more", "cluster").alias("cluster"))
    core = core.join(cluster, "cell")
    edge = sparse.where("not core").select("v", around(shifts).alias("cell")).join(core.select("cell", "cluster", F.col("v").alias("w")), "cell").where(near(v, F.col("w"))).groupBy("v").agg(F.min("cluster").alias("cluster"))
    label = _cut(core.select("v", "cluster", F.lit(True).alias("core")).unionAll(edge.select("v", "cluster", F.lit(False))))
    return points.join(label, "v", "left").select(F.col("id").alias(id), "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def naive_bayes_train(docs: DataFrame, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(label, word, n) and (label, docs, words): the counts of a multinomial model."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(F.col(label).alias("label"), words.alias("w"))
    counts = rows.select("label", F.explode("w").alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts, rows.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("w")).alias("words"))


def naive_bayes_predict(docs: DataFrame, id: str, text: str, counts: DataFrame, priors: DataFrame, alpha: float = 1.0) -> DataFrame:
    """id, label and log score of the likeliest label; smoothing ``alpha`` over the vocabulary. A label's constant part is added once, so only known words are joined."""
    vocabulary = counts.agg(F.countDistinct("word")).scalar()
    total = priors.agg(F.sum("docs")).scalar()
    prior = priors.select("label", F.log(F.col("docs") / total).alias("prior"), (F.col("words") + alpha * vocabulary).alias("norm"))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(F.col(id).alias("id"), words.alias("w"))
    tf = rows.select("id", F.explode("w").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    gain = tf.join(counts, "word").groupBy("id", "label").agg(F.sum(F.col("tf") * F.log((F.col("n") + alpha) / F.lit(alpha))).alias("gain"))
    base = rows.select("id", F.size("w").alias("len")).crossJoin(prior)  # a row for each label
    score = base.join(gain, ["id", "label"], "left").select("id", "label", (F.col("prior") + F.coalesce("gain", F.lit(0.0)) + F.col("len") * (F.log(F.lit(alpha)) - F.log("norm"))).alias("score"))
    return score.groupBy("id").agg(F.max_by("label", F.struct("score", "label")).alias("label"), F.max("score").alias("score")).withColumnRenamed("id", id)


def entropy(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Entropy in bits of the label, in each group."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    t = n.groupBy(*by).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    return t.select(*by, (F.log2("_t") - F.col("_s") / F.col("_t")).alias("entropy"))


def information_gain(df: DataFrame, attribute: str, label: str) -> DataFrame:
    """Entropy of the label less its mean within the attribute's values, by one table of counts."""
    n = df.groupBy(attribute, label).agg(F.count(F.lit(1)).alias("_n"))
    within = n.groupBy(attribute).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2("_n")).alias("_s")).agg(F.sum(F.col("_t") * F.log2("_t") - F.col("_s")).alias("w"), F.sum("_t").alias("n"))
    whole = n.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.sum("_n").alias("t"), F.sum(F.col("_n") * F.log2("_n")).alias("s"))
    return within.crossJoin(whole).select((F.log2("t") - F.col("s") / F.col("t") - F.col("w") / F.col("n")).alias("gain"))  # one row each


def logistic_fit(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.1, steps: int = 100) -> list[float]:
    """Weights, the intercept first, by batch gradient descent; each step is one aggregation of as many sums."""
    w = [0.0] * (len(features) + 1)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    for _ in range(steps):
        z = sum((c * x for c, x in zip(cols, w)), F.lit(0.0))
        error = 1 / (1 + F.exp(-z)) - F.col(label)
        g = df.agg(*[F.avg(error * c).alias(f"g{i}") for i, c in enumerate(cols)]).first()
        w = [x - rate * (g[i] or 0.0) for i, x in enumerate(w)]
    return w


def logistic_probability(features: Sequence[str], weights: Sequence[float]) -> Column:
    z = sum((F.col(f).cast("double") * x for f, x in zip(features, weights[1:])), F.lit(float(weights[0])))
    return 1 / (1 + F.exp(-z))


def markov_transitions(df: DataFrame, state: str, by: str, *ord: str) -> DataFrame:
    """from, to, n and p of the steps between neighbouring states of each key."""
    step = F.lead(state).over(Window.partitionBy(by).orderBy(*ord))
    n = df.select(F.col(state).alias("from"), step.alias("to")).where("`to` is not null").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("from").agg(F.sum("n").alias("_t")), "from").select("from", "to", "n", (F.col("n") / F.col("_t")).alias("p"))
