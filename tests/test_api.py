import pytest
from pyspark.sql import functions as F

from brindle import api
from brindle.functions import encoding, serial


def test_table(spark):
    t = api.Table(spark.createDataFrame([("Alice", 90, "a"), ("Bob", 70, "b"), ("Carol", None, "a")], "name string, score int, k string"))
    assert [r["name"] for r in t.where(("score", "gt", 60)).order_by("score", "desc").limit(1).rows()] == ["Alice"]
    assert (t.sum("score"), t.avg("score"), t.min("score"), t.max("score"), t.count()) == (160, pytest.approx(160 / 3), 70, 90, 3)
    assert t.distinct("k", "name") == ["a", "b"] and t.select("name", "x").rows()[0]["x"] is None
    assert t.join(api.Table(spark.createDataFrame([("a", 1)], "k string, v int")), "k", "k").count() == 2
    assert {r["k"]: r["n"] for r in t.group_by("k")(F.count(F.lit(1)).alias("n")).rows()} == {"a": 2, "b": 1}


def test_stream(spark):
    s = api.Stream.range(spark, 0, 10)
    out = s.map(value=F.col("value") * 2).filter(F.col("value") > 4).skip(1).take(3).rows()
    assert [r.value for r in out] == [8, 10, 12]
    assert [r.x for r in s.take(2).flat_map("x", F.array("value", F.col("value") + 100)).rows()] == [0, 100, 1, 101]
    assert [r.value for r in s.take_while(F.col("value") < 3).reverse().rows()] == [2, 1, 0]
    assert [len(b) for b in s.batches(4)] == [4, 4, 2] and s.some(F.col("value") == 9) and not s.every(F.col("value") > 0)
    assert [r.value for r in s.map(k=F.col("value") % 3).distinct_by("k").rows()] == [0, 1, 2]
    assert [r.value for r in s.map(k=F.col("value") % 2).sort_by("k", "desc").rows()] == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]
    assert s.reduce(F.sum("value"))[0] == 45 and s.first().value == 0 and api.Stream.repeat(spark, "x", 3).reduce(F.count("value"))[0] == 3
    other = api.Stream(spark.createDataFrame([("a", 5), ("b", 6)], "letter string, at int"), "at")
    assert [(r.value, r.letter) for r in s.zip(other).rows()] == [(0, "a"), (1, "b")]


def test_collection(spark):
    c = api.Collection(spark.createDataFrame([(1, "Alice")], "id int, name string"))
    row = lambda i, n: spark.createDataFrame([(i, n)], "id int, name string")
    c.insert(row(2, "Bob"))
    c.upsert(row(2, "Rob"))
    assert c.get(2).name == "Rob" and c.find_one({"name": "Alice"}).id == 1 and c.count(F.col("id") > 1) == 1

    def failing(x):
        x.insert(row(3, "Eve"))
        x.insert(row(3, "Eve"))

    with pytest.raises(ValueError):
        c.batch(failing)
    assert c.count() == 2 and c.delete(F.col("id") == 1) == 1 and c.count() == 1


def test_series_and_stores(spark):
    t = api.TimeSeries(spark.createDataFrame([("k", 0, 0.0), ("k", 10, 10.0), ("k", 20, 0.0)], "by string, ts long, value double"), ["by"])
    assert [r.value for r in t.resample(5).df.orderBy("ts").collect()] == [0, 5, 10, 5, 0]
    assert t.slice(5, 20).stats().first()["count"] == 2 and [r.sma for r in t.sma(3).collect()] == [pytest.approx(10 / 3)]
    v = api.VectorStore(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>"))
    v.upsert(spark.createDataFrame([("a", [0.0, 2.0])], "id string, vector array<double>"))
    assert [r.id for r in v.search([0.0, 1.0], 2).collect()] == ["a", "b"] and v.search_many(v.df, 1).count() == 2
    i = api.SearchIndex(spark.createDataFrame([("1", "First document"), ("2", "Second document first")], "id string, title string"), "id", "title")
    assert [r.id for r in i.search("first second").collect()] == ["2", "1"] == [r.id for r in i.search_postings(i.postings(), "first second").collect()]
    s = api.Series(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double"), "x")
    assert (s.mean(), s.median(), s.modes()) == (2.5, 2.0, [2.0])


def test_event_store(spark):
    e = api.EventStore(spark.createDataFrame([], "stream string, version int, type string, data string, ts long"))
    assert e.append("o", "Placed", "42", 1) == 1 and e.append("o", "Paid", "8", 2, expected=1) == 2
    with pytest.raises(api.VersionConflict):
        e.append("o", "Paid", "8", 3, expected=1)
    assert [r.type for r in e.stream("o", since=1).collect()] == ["Paid"]
    assert e.replay(F.lit(0), lambda s, x: s + x["data"].cast("int")).first().state == 50 and e.latest().first().version == 2


def test_serial(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    text = '{"a":[1,-5,300,70000,-40000,1.5,null,true],"é":{"b":"' + "x" * 300 + '"}}'
    assert value(serial.msgpack_to_json(serial.json_to_msgpack(F.lit(text)))) == text
    assert bytes(value(serial.json_to_msgpack(F.lit('{"a":1}')))) == b"\x81\xa1a\x01"
    ops = '[{"op":"add","path":"/b/-","value":3},{"op":"move","from":"/a","path":"/c"},{"op":"test","path":"/c","value":1}]'
    assert value(serial.json_patch(F.lit('{"a":1,"b":[2]}'), F.lit(ops))) == '{"b":[2,3],"c":1}'
    assert value(serial.json_patch(F.lit("{}"), F.lit('[{"op":"remove","path":"/x"}]'))) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "t": {"items": {"type": "string"}}}, "additionalProperties": False}
    assert value(serial.json_schema_errors(F.lit('{"a":0,"t":["x",1],"z":1}'), schema)) == ["a: too small", "t.1: not string", "z: unknown"]
    assert value(serial.json_schema_errors(F.lit("{}"), schema)) == ["a: missing"] and value(serial.json_schema_errors(F.lit("{"), schema)) == ["no JSON"]
    assert value(serial.unlz77(serial.lz77(F.lit("abababab aab")))) == "abababab aab" and value(serial.lz77(F.lit(""))) == []
    b = encoding.bwt(F.lit("mississippi"))
    assert value(serial.inverse_bwt(b["transformed"], b["index"])) == "mississippi"
    abc = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert len(value(serial.permutations(abc))) == 6 and value(serial.combinations(abc, F.lit(2))) == [["a", "b"], ["a", "c"], ["b", "c"]] and len(value(serial.power_set(abc))) == 8
    assert value(serial.format_currency(F.lit(-1234.5))) == "-$1,234.50" and value(serial.format_percent(F.lit(0.256), 1)) == "25.6%"
    assert value(serial.parse_number(F.lit("$ 1,234.5"))) == 1234.5 and value(serial.parse_number(F.lit("1.234,5"), ".", ",")) == 1234.5 and value(serial.parse_number(F.lit("x"))) is None
