import pytest
from pyspark.sql import functions as F

from brindle.operators import joins, order, relational, sets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def employees(spark):
    return spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 20), (3, "Carol", 10), (4, "Dave", 30), (5, "Eve", 99)], "id int, name string, deptId int")


@pytest.fixture
def departments(spark):
    return spark.createDataFrame([(10, "Engineering"), (20, "Sales"), (30, "Marketing"), (40, "HR")], "deptId int, deptName string")


def test_key_joins(employees, departments):
    inner = joins.key_join(employees, departments, "deptId", "deptId")
    assert inner.columns == ["id", "name", "deptId", "deptName"] and inner.count() == 4
    left = {r.name: (r.deptId, r.deptName) for r in joins.key_join(employees, departments, "deptId", "deptId", "left").collect()}
    assert left["Eve"] == (None, None) and left["Bob"] == (20, "Sales")  # a shared column is the right side's
    right = joins.key_join(employees, departments, "deptId", "deptId", "right")
    assert (None, None, 40, "HR") in rows(right) and right.count() == 5
    assert joins.key_join(employees, departments, "deptId", "deptId", "full").count() == 6


def test_null_keys_and_duplicates(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, r string")
    assert rows(joins.key_join(a, b, "k", "k")) == [("a", 1, "x"), ("a", 1, "y"), ("n", None, "z")]
    assert rows(joins.semi_join(a, b.where("k is null"), "k", "k")) == [(None, "n")]
    assert rows(joins.anti_join(a, b.where("k is null"), "k", "k")) == [(1, "a")]


def test_empty_sides(employees, departments):
    none = departments.limit(0)
    assert joins.key_join(employees, none, "deptId", "deptId").count() == 0
    out = joins.key_join(employees, none, "deptId", "deptId", "left")
    assert out.count() == 5 and out.columns == ["id", "name", "deptId", "deptName"]


def test_text_keys(spark):
    a = spark.createDataFrame([(1, "L")], "k int, l string")
    b = spark.createDataFrame([("1", "R"), ("01", "S")], "k string, r string")
    assert rows(joins.sort_merge_join(a, b, "k", "k")) == [("L", "1", "R")]
    assert joins.cross_join(a, b).columns == ["l", "k", "r"]


def test_intervals(spark):
    iv = spark.createDataFrame([(1.0, 5.0), (0.0, 5.0), (2.0, 8.0)], "low double, high double")
    p = spark.createDataFrame([(0.0,), (5.0,), (8.0,), (9.0,)], "p double")
    for width in (0.7, 3.0, 100.0):
        assert rows(joins.stab_join(p, iv, "p", "low", "high", width)) == [(0.0, 0.0, 5.0), (5.0, 0.0, 5.0), (5.0, 1.0, 5.0), (5.0, 2.0, 8.0), (8.0, 2.0, 8.0)]
        q = spark.createDataFrame([(5.0, 6.0), (-3.0, -1.0)], "a double, b double")
        assert joins.overlap_join(q, iv, "a", "b", "low", "high", width).count() == 3


def test_asof_and_interpolation(spark):
    facts = spark.createDataFrame([("u", 100, 1.0, 1), ("u", 200, 2.0, 2), ("u", 200, 5.0, 3), ("v", 50, 9.0, 4)], "by string, ts long, value double, id long")
    probes = spark.createDataFrame([("u", 99), ("u", 100), ("u", 250), ("v", 60), ("w", 1)], "by string, ts long")
    got = {(r["by"], r.ts): r.asof_value for r in joins.asof_join(probes, facts, "ts", "value", ["by"], tie="id").collect()}
    assert got == {("u", 99): None, ("u", 100): 1.0, ("u", 250): 5.0, ("v", 60): 9.0, ("w", 1): None}
    line = spark.createDataFrame([("u", 0, 0.0), ("u", 10, 20.0)], "by string, ts long, value double")
    at = spark.createDataFrame([("u", 5), ("u", 10), ("u", 12), ("u", -1)], "by string, ts long")
    assert {r.ts: r.value for r in joins.interpolate_at(at, line, "ts", "value", ["by"]).collect()} == {5: 10.0, 10: 20.0, 12: 20.0, -1: None}


def test_filters(spark):
    df = spark.createDataFrame([("Alice", 30), ("Bob", None), (None, 25)], "name string, age int")
    names = lambda *s: sorted((r.name or "") for r in relational.filter_rows(df, list(s)).collect())
    assert names(("age", "gt", 26)) == ["Alice"]
    assert names(("age", "eq", None)) == ["Bob"] and names(("age", "ne", 30)) == ["", "Bob"]
    assert names(("name", "contains", "li"), ("age", "lte", 30)) == ["Alice"]
    assert names(("name", "gt", 1)) == [] and names(("age", "contains", "3")) == [] and names(("nothing", "gt", 1)) == []
    with pytest.raises(ValueError):
        relational.predicate(df, ("age", "like", 1))


def test_sorting_and_projection(spark):
    df = spark.createDataFrame([(1, 35), (2, None), (3, 28), (4, 28)], "ord int, age int")
    assert [r.ord for r in relational.sort_rows(df, "age", ord="ord").collect()] == [3, 4, 1, 2]
    assert [r.ord for r in relational.sort_rows(df, ("age", "desc"), ord="ord").collect()] == [2, 1, 3, 4]
    assert relational.project(df, ["ord", "x"]).first().asDict() == {"ord": 1, "x": None}
    assert relational.row_at(df, 2, "ord").first().ord == 3 and relational.row_at(df, 0, "ord").first().ord == 1 and relational.row_at(df, -1, "ord").count() == 0


def test_aggregates_on_nothing(spark):
    df = spark.createDataFrame([(None,), (4,), (8,)], "x int")
    got = df.agg(relational.sum_or_zero("x").alias("s"), relational.avg_all_rows("x").alias("a"), relational.min_or_zero("x").alias("m")).first()
    assert tuple(got) == (12, 4.0, 4)
    none = df.limit(0).agg(relational.sum_or_zero("x").alias("s"), relational.avg_all_rows("x").alias("a"), relational.max_or_zero("x").alias("m")).first()
    assert tuple(none) == (0, 0.0, 0)


def test_collections(spark):
    t = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string")
    with pytest.raises(relational.DuplicateKey):
        relational.insert(t, spark.createDataFrame([(1, "x")], "id int, name string"))
    with pytest.raises(relational.DuplicateKey):
        relational.insert(t, spark.createDataFrame([(3, "x"), (3, "y")], "id int, name string"))
    assert relational.insert(t, spark.createDataFrame([(3, "x")], "id int, name string")).count() == 3
    assert rows(relational.update(t, spark.createDataFrame([(2, "Rob")], "id int, name string"))) == [(1, "Alice"), (2, "Rob")]
    assert rows(relational.upsert(t, spark.createDataFrame([(2, "Rob"), (9, "New")], "id int, name string"))) == [(1, "Alice"), (2, "Rob"), (9, "New")]
    assert rows(relational.delete(t, F.col("name") == "Bob")) == [(1, "Alice")]
    assert relational.find(t, {"name": "Bob"}).first().id == 2


def test_statements(spark):
    s = relational.select("a", "b").from_("t").where("a > ?", 1).where("a > ?", 2).and_where("b = ?", "x'y").or_where("a IS NULL").order_by("a", "DESC").limit(3).offset(1)
    assert s.build()[0] == "SELECT a, b FROM t WHERE a > ? AND b = ? OR a IS NULL ORDER BY a DESC LIMIT 3 OFFSET 1"
    spark.createDataFrame([(1, "x'y"), (5, "x'y")], "a int, b string").createOrReplaceTempView("brindle_t")
    assert relational.select("a").from_("brindle_t").where("b = ?", "x'y").and_where("a > ?", 2).run(spark).first().a == 5
    with pytest.raises(ValueError):
        relational.select().build()


def test_order(spark):
    df = spark.createDataFrame([(i, i % 3 or None, f"v{i}") for i in range(20)], "ord int, k int, v string").repartition(4)
    assert sorted((r.ord, r["index"]) for r in order.global_index(df, "ord").collect()) == [(i, i) for i in range(20)]
    assert {r.k: r.v for r in order.distinct_first(df, "k", "ord").collect()} == {None: "v0", 1: "v1", 2: "v2"}
    assert [r.k for r in order.distinct_values(df, "k", "ord").collect()] == [None, 1, 2]
    assert [r.ord for r in order.take(df, 3, "ord").collect()] == [0, 1, 2] and [r.ord for r in order.skip(df, 18, "ord").collect()] == [18, 19]
    assert sorted(r.ord for r in order.take_while(df, F.col("ord") < 4, "ord").collect()) == [0, 1, 2, 3]
    assert order.take_while(df, F.col("k") > 0, "ord").count() == 0 and order.take_while(df, F.lit(True), "ord").count() == 20
    assert order.skip_while(df, F.lit(True), "ord").count() == 0
    chunks = {r.chunk: [x.v for x in r["items"]] for r in order.chunk(df, 8, "ord", columns=["v"]).collect()}
    assert [len(chunks[i]) for i in range(3)] == [8, 8, 4] and chunks[1][0] == "v8"
    with pytest.raises(ValueError):
        order.chunk(df, 0, "ord", columns=["v"])
    assert order.zip_rows(df.select("ord"), df.where("ord < 5").selectExpr("ord as other"), "ord", "other").count() == 5
    assert order.kth(df.select("ord"), "ord", 1).first().ord == 0 and order.kth(df.select("ord"), "ord", 7).first().ord == 6 and order.kth(df.select("ord"), "ord", 99).first() is None


def test_pages(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(1, 11)], "id string, ord int")
    assert [r.ord for r in order.page_after(df, "ord", None, 3).collect()] == [1, 2, 3]
    assert [r.ord for r in order.page_after(df, "ord", 3, 3).collect()] == [4, 5, 6]
    assert [r.ord for r in order.page_before(df, "ord", 4, 2).collect()] == [2, 3]
    assert [r.ord for r in order.page_of(df, 4, 3, "ord").collect()] == [10]
    assert order.page_info(9, 3, 10) == {"page": 4, "page_size": 3, "total": 10, "pages": 4, "start": 9, "end": 10, "has_next": False, "has_previous": True}
    c = df.select(order.cursor_of(F.col("id")).alias("c")).select(order.id_of_cursor(F.col("c")).alias("id"))
    assert c.first().id == "1"


def test_bags_and_ranges(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    b = spark.createDataFrame([("x",), ("z",), (None,), (None,)], "v string")
    as_map = lambda df: {r.v: r["count"] for r in df.collect()}
    assert as_map(sets.bag_union(a, b)) == {"x": 2, "y": 1, "z": 1, None: 2}
    assert as_map(sets.bag_intersect(a, b)) == {"x": 1, None: 1}
    assert as_map(sets.bag_difference(a, b)) == {"x": 1, "y": 1}
    assert as_map(sets.bag_sum(a, b)) == {"x": 3, "y": 1, "z": 1, None: 3}
    assert sets.expand(sets.bag(a)).count() == 4
    r = spark.createDataFrame([("k", 1, 3), ("k", 3, 5), ("k", 8, 9), ("k", 2, 4), ("k", 6, 6)], "k string, s int, e int")
    assert rows(sets.merge_ranges(r, "s", "e", "k")) == [("k", 1, 5), ("k", 8, 9)]
    assert rows(sets.invert_ranges(r, "s", "e", "k")) == [("k", 5, 8)]
