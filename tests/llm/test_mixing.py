import hashlib
import math
from collections import Counter

import pytest

from brindle.llm import mixing, queries


def uniform(doc, seed):
    return int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52


def poisson_inverse(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u and k < 1000:
        k += 1
        p *= rate / k
        c += p
    return k


def rows_of(spark, n=400):
    return spark.createDataFrame([(i, "big" if i % 10 else ("small" if i % 20 else None), f"t{i}") for i in range(n)], "doc_id long, source string, text string").repartition(5)


def test_counts_are_inverted_poisson(spark):
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 2.0), ("none", 5.0)], "source string, weight double")
    for w, size in ((weights, 1.0), (weights, 3.0), (None, 1.0)):
        got = mixing.mix(rows_of(spark), w, size=size).collect()
        n = {"big": 360, "small": 20, None: 20}
        share = {"big": 1.0, "small": 1.0, None: 2.0} if w is not None else {s: c**0.7 for s, c in n.items()}
        total = sum(share.values())
        counts = Counter(r.doc_id for r in got)
        for i in range(400):
            s = "big" if i % 10 else ("small" if i % 20 else None)
            assert counts[i] == poisson_inverse(uniform(i, mixing.SEED), share[s] / total * 400 * size / n[s])
        assert Counter((r.doc_id, r.copy) for r in got).most_common(1)[0][1] == 1
        assert all(r.text == f"t{r.doc_id}" for r in got)


def test_rates_meet_the_targets(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    assert got["a"] == pytest.approx(15000, rel=0.03) and got["b"] == pytest.approx(5000, rel=0.05)


def test_shuffle_and_repeatability(spark):
    a = mixing.mix(rows_of(spark))
    b = mixing.mix(rows_of(spark))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    keys = [r.shuffle_key for r in a.collect()]
    ids = [r.doc_id for r in a.collect()]
    assert len(set(keys)) == len(keys) and ids != sorted(ids)
    for part in a.rdd.glom().collect():
        assert [r.shuffle_key for r in part] == sorted(r.shuffle_key for r in part)


def test_query_mixes_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_mix"](spark, str(tmp_path))
    rows = got.collect()
    assert got.columns == [*docs.columns, "copy", "shuffle_key"] and rows and all(r.text == f"text {r.doc_id}" for r in rows)


@pytest.mark.parametrize("rate", [0.001, 0.7, 12.5, 600.6, 800.0, 5000.0])
def test_distribution_has_the_mean_and_variance_of_its_rate(spark, rate):
    d = spark.createDataFrame([(rate,)], "rate double").select(mixing.distribution("rate").alias("d")).first().d
    p = [b - a for a, b in zip([0.0, *d.cdf], d.cdf)]
    mean = sum((d.low + i) * x for i, x in enumerate(p))
    assert d.cdf[-1] == 1.0 and mean == pytest.approx(rate, rel=1e-9)
    assert sum((d.low + i - mean) ** 2 * x for i, x in enumerate(p)) == pytest.approx(rate, rel=1e-9)


def test_a_large_rate_is_drawn_whole(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'a' as source")
    got = [r["count"] for r in mixing.mix(docs, spark.createDataFrame([("a", 1.0)], "source string, weight double"), size=800.6).groupBy("doc_id").count().collect()]
    mean = sum(got) / 300
    assert mean == pytest.approx(800.6, abs=6) and sum((x - mean) ** 2 for x in got) / 300 == pytest.approx(800, rel=0.25)


def test_names_of_the_result_are_replaced_and_others_stay(spark):
    docs = spark.createDataFrame([(i, "a", 7, "x", "y", "z", "w") for i in range(50)], "doc_id long, source string, _n long, _src string, copy string, shuffle_key string, `a.b` string")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "source", "_n", "_src", "a.b", "copy", "shuffle_key"]
    rows = got.collect()
    assert rows and all((r._n, r._src, r["a.b"]) == (7, "x", "w") and isinstance(r.copy, int) and len(r.shuffle_key) == 32 for r in rows)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(rows_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowSchema", "")


def test_large_rates_and_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "b"), (2, "b")], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = mixing.mix(docs, weights, size=500.0).collect()
    assert {r.doc_id for r in got} == {1} and 1800 < len(got) < 2200
    assert mixing.mix(docs.limit(0)).collect() == []
