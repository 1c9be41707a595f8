"""Extra columns with names that operators use inside, nulls in them, and very long texts."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import brown, decontaminate, imatch, mixing, pii, quality, simhash, suffix_dedup, url_filter, warc

NAMES = ("score", "row", "fp", "key", "word", "c", "n", "kind", "at", "area", "tail", "path", "shard", "doc", "gram", "core", "base", "more", "host", "refers_to", "sha", "src", "rate", "y", "rare", "_n", "_hits", "_items", "_share", "_cut", "_src", "_low", "_cdf", "_draw", "_key", "_row", "_spans", "_quality", "node", "text_hash", "component_id", "copy", "shuffle_key")


@pytest.fixture
def docs(make_docs):
    df = make_docs(["a b c d " * 9, "a b c d " * 9, "mail x@y.zz now", "", None, ("longword " * 60_000) + "end", "z" * 300_000])
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES}).withColumn("text2", F.col("text"))


def untouched(rows):
    """Columns of the input hold what they held."""
    return all(r[n] == f"own {n}" for r in rows for n in NAMES if n in r.__fields__)


def test_documents(spark, docs):
    n = docs.count()
    model, counts = brown.fit(docs)
    assert brown.score(docs, model, counts).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert pii.found_table(docs).count() == n
    assert imatch.fingerprints(docs, parts=3).count() == n
    assert suffix_dedup.dedup(docs, parts=3).count() == n


def test_operators_that_keep_the_columns(spark, docs):
    n = docs.count()
    bench = spark.createDataFrame([(1, "a b c d a b c d a b c d a", None)], "item_id long, text string, words string")
    assert decontaminate.contamination(docs, bench).where("contaminated").count() == 2
    labels = spark.createDataFrame([(0, 1, "x")], "doc_id long, y int, score string")
    results = {
        "redact": pii.redact(docs), "redact joined": pii.redact(docs, sent_patterns=-1), "remove": decontaminate.remove_spans(docs, bench),
        "remove in passes": decontaminate.remove_spans(docs, bench.unionAll(bench.selectExpr("2", "'x y'", "words")), chunk_words=3), "one of each": simhash.one_of_each(docs),
        "score": quality.score(docs, quality.fit(docs, labels), "_q").drop("_q"),
    }
    for name, df in results.items():
        rows = df.collect()
        assert df.columns == docs.columns and rows and untouched(rows), name
        assert len(rows) == {"remove": n - 2, "remove in passes": n - 2, "one of each": n - 2}.get(name, n), name
    replaced = quality.score(docs, quality.fit(docs, labels), "score")
    assert replaced.columns == [c for c in docs.columns if c != "score"] + ["score"] and replaced.schema["score"].dataType.simpleString() == "double"
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c not in ("copy", "shuffle_key")] + ["copy", "shuffle_key"]
    assert all(r[x] == f"own {x}" for r in mixed.collect() for x in NAMES if x not in ("copy", "shuffle_key"))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x", None), (2, None, None, None)], "page_id long, url string, html string, host string").withColumns({x: F.lit(None).cast("string") for x in ("n", "k", "path", "rule", "domain", "sha", "top", "refers_to", "body")})
    assert warc.round_trip(pages).count() == 2
    outcomes = spark.createDataFrame([(1, 1, "x")], "page_id long, good int, host string")
    assert url_filter.judge(pages, outcomes, ()).count() == 2
