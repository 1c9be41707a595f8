import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import quality


def corpus(n=300):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(20, 200))).capitalize() + "." for _ in range(n)]
    bad = [" ".join(word().upper() + rng.choice(["!!", "$$$", " |"]) for _ in range(rng.randint(20, 200))) for _ in range(n // 3)]
    return [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]


def tables(spark, make_docs):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows]).select("doc_id", "text")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int"), {i: y for i, _, y in rows}


def test_held_out_accuracy(spark, make_docs):
    docs, labels, truth = tables(spark, make_docs)
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    rows = quality.score(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and sum((r.score >= 0.3) == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_moments_and_density(spark, make_docs):
    docs, labels, truth = tables(spark, make_docs)
    model = quality.fit(docs, labels, shrink=0.1, ridge=0.05)
    x = {r.doc_id: quality.features(r.text.encode()) for r in docs.collect()}
    for c in (0, 1):
        assert np.allclose(model.means[c], np.mean([x[i] for i, y in truth.items() if y == c], axis=0))
    d = len(quality.FEATURES)
    covs = [np.cov(np.array([x[i] for i, y in truth.items() if y == c]).T, bias=True) for c in (0, 1)]
    n = [sum(y == c for y in truth.values()) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    v, logs = x[5], []
    for c in (0, 1):
        a = 0.1 + 0.9 * d / (d + n[c])
        s = (1 - a) * covs[c] + a * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        diff = v - model.means[c]
        logs.append(-0.5 * (diff @ np.linalg.solve(s, diff) + np.linalg.slogdet(s)[1]) + np.log(n[c] / sum(n)))
    words = np.expm1(v[0])
    prior = np.log(n[1] / n[0])
    assert np.isclose(model.score(v[None])[0], 1 / (1 + np.exp(-((logs[1] - logs[0] - prior) * words / (words + 10) + prior))))


def test_the_sample_is_bounded(spark, make_docs):
    docs, labels, _ = tables(spark, make_docs)
    assert quality.fit(docs, labels, max_rows=50).prior in {k / 50 for k in range(51)}


def test_edges(spark, make_docs):
    docs = make_docs([(1, ""), (2, None), (3, "word " * 30000), (None, "x"), (1, "again")]).select("doc_id", "text")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (9, None), (77, 1)], "doc_id long, y int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model, "q").collect()
    assert len(rows) == 5 and {r.q for r in rows} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []
    assert np.isfinite(quality.features(b"\xff\x00" * 9)).all() and (quality.features(b"") == 0).all()


def test_other_columns_stay(make_docs):
    docs = make_docs(["a b"]).withColumn("score", F.lit("mine"))
    out = quality.score(docs, quality.Discriminant({}, 0.1, 0.1), "_q")
    assert out.columns == [*docs.columns, "_q"] and out.first()["score"] == "mine"
