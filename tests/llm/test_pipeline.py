import zlib

import pytest

import corpus_pipeline
from brindle.llm import decontaminate, mixing, pii, quality, simhash
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import poisson_inverse, uniform
from tests.llm.test_pii import brute as spans_of
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import partition_wide

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture
def tables(spark, tmp_path):
    """Documents good and bad, copies, a benchmark passage, an address, an empty and a null text."""
    rows = [(i, t) for i, t, _ in corpus(120)]
    good = [t for _, t in rows[:100]]
    rows += [(1000, good[3]), (1001, good[3]), (1002, good[4][: len(good[4]) // 2] + " " + PASSAGE + " " + good[9][: len(good[9]) // 2]), (1003, good[5][: len(good[5]) // 2] + " Mail to some.one@mail.example.com about it. " + good[8][: len(good[8]) // 2]), (1004, good[6] + " " + good[7] * 9 + " one two three")]
    documents = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    d = str(tmp_path)
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_brute_force(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    truth = {i: y for i, _, y in corpus(120)}

    kept = step["quality"](spark, docs, tables)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in ids) == truth[i] for i in held) / len(held) > 0.95 and {1000, 1001, 1002, 1003} <= ids

    single = step["near_dedup"](spark, kept, tables)
    assert single.columns == COLUMNS
    before = {r.doc_id: r.text for r in kept.collect()}
    order = sorted(before)
    roots = partition_wide([before[i] for i in order])
    after = {r.doc_id: r.text for r in single.collect()}
    assert set(after) == {order[r] for r in roots} and not {1000, 1001} & set(after) and {1002, 1003} <= set(after)

    clean = step["decontamination"](spark, single, tables)
    assert clean.columns == COLUMNS
    bad = contaminated(list(after.items()), [(1, PASSAGE)], 13)
    rest = {r.doc_id: r.text for r in clean.collect()}
    assert set(rest) == {i for i in after if not bad[i][4]} and 1002 not in rest
    assert all(t == after[i] for i, t in rest.items() if not bad[i][1]) and not any(x[1] for x in contaminated(list(rest.items()), [(1, PASSAGE)], 13).values())

    masked = step["pii"](spark, clean, tables)
    assert masked.columns == COLUMNS
    for r in masked.collect():
        assert not spans_of(r.text) and r.n_chars == len(r.text)
        if not spans_of(rest[r.doc_id]):
            assert r.text == rest[r.doc_id]
    assert "[EMAIL]" in next(r.text for r in masked.collect() if r.doc_id == 1003)

    mixed = step["mixing"](spark, masked, tables)
    n = {s: c for s, c in masked.groupBy("source").count().collect()}
    share = {s: c**0.7 for s, c in n.items()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in masked.collect():
        rate = share[r["source"]] / sum(share.values()) * sum(n.values()) / n[r["source"]]
        assert counts.get(r.doc_id, 0) == poisson_inverse(uniform(r.doc_id, mixing.SEED), rate)


def test_run_is_the_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and {"doc_id", "text", "copy", "shuffle_key"} <= set(rows[0].asDict())


def test_each_stage_calls_its_operator():
    import inspect

    for name, module in (("quality", quality), ("near_dedup", simhash), ("decontamination", decontaminate), ("pii", pii), ("mixing", mixing)):
        assert module.__name__.rpartition(".")[2] in inspect.getsource(dict(corpus_pipeline.STAGES)[name])


def test_near_dedup_loses_no_text_without_a_copy(spark):
    """Null and repeated doc_ids, null and empty texts, repeated rows, and columns with the names of the operator's own."""
    rows = [(None, "hello there you"), (None, "another one of these"), (2, "something else again"), (2, "a different text here"), (2, "a different text here"), (7, "something else again"), (None, "something else again"), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _key string, node string").repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(2, "a different text here"), (2, "something else again"), (8, None), (None, "another one of these"), (None, "hello there you")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in all columns, repeated rows, no labels and no benchmark, very long texts, and no rows at all."""
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "same words here", "en", "s", 15), (1, "same words here", "en", "s", 15), (2, "long " * 150_000, "en", None, None), (3, "mail a@b.cc now " + "z" * 300_000, None, "s", 5)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).collect() == []
        got = stage(spark, docs, d)
        assert got.columns[:5] == COLUMNS
        n = got.count()
        assert n == (4 if name == "near_dedup" else 6) or name == "mixing"


def test_spans_under_a_twentieth_are_cut(spark, tables):
    docs = spark.createDataFrame([(1, "other words " * 300 + PASSAGE, "en", "s", 1), (2, "clean text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in corpus_pipeline.decontamination_stage(spark, docs, tables).collect()}
    assert rows[1].text.split() == ["other", "words"] * 300 and rows[1].n_chars == len(rows[1].text) and rows[2].text == "clean text"
