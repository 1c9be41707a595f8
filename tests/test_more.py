"""Text structures, keyed state, filters and page texts against plain programs and edge cases."""

import random

from pyspark.sql import functions as F

from brindle.functions import texts
from brindle.operators import filters, graph, stores, vectors, windows
from brindle.sources import pdf

EDIT = "struct<at:int,remove:int,insert:string>"


def plain(s, at, remove, insert):
    at = min(max(at, 0), len(s))
    return s[:at] + insert + s[at + max(remove, 0) :]


def test_edits_in_either_order_give_one_text(spark):
    rng = random.Random(1)
    edit = lambda n, sign: (rng.randint(0, n), rng.choice([0, 0, 1, 2, 5]), sign * rng.randint(0, 3))
    rows = []
    for i in range(400):
        s = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))
        a, b = edit(len(s), "A"), edit(len(s), "b")
        rows.append((i, s, (a[0], min(a[1], len(s) - a[0]), a[2]), (b[0], min(b[1], len(s) - b[0]), b[2])))
    df = spark.createDataFrame(rows, f"i int, s string, a {EDIT}, b {EDIT}")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", texts.applied(F.col("s"), F.array(a)).alias("x"), texts.applied(F.col("s"), F.array(a, texts.transformed(b, a, False))).alias("one"), texts.applied(F.col("s"), F.array(b, texts.transformed(a, b, True))).alias("two")).collect()
    for r in got:
        assert r.x == plain(rows[r.i][1], *rows[r.i][2]) and r.one == r.two, rows[r.i]


def test_suffixes_and_repeats(spark):
    rng = random.Random(2)
    words = ["", None, "a", "aaaa", *("".join(rng.choice("ab") for _ in range(rng.randint(2, 12))) for _ in range(40))]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    for r in df.select("i", texts.suffix_array(F.col("s")).alias("a"), texts.longest_repeat(F.col("s")).alias("l"), texts.distinct_substrings(F.col("s")).alias("d")).collect():
        w = words[r.i]
        if w is None:
            assert r.a is None and r.l is None
            continue
        assert r.a == sorted(range(len(w)), key=lambda i: w[i:])
        assert r.d == len({w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
        again = [w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w.find(w[i:j], i + 1) >= 0]
        assert r.l == (min(x for x in again if len(x) == max(map(len, again))) if again else "")


def test_range_blocks(spark):
    rng = random.Random(3)
    values = [rng.randint(-50, 50) for _ in range(77)]
    blocks = stores.range_blocks(spark.createDataFrame(list(enumerate(values)), "at long, v long"), "at", "v", 3)
    asked = [(i, *sorted((rng.randrange(77), rng.randrange(77)))) for i in range(120)]
    got = {r.id: (r.low, r.high, r.total) for r in stores.range_aggregates(spark.createDataFrame(asked, "id int, a int, z int"), blocks, "id", "a", "z", 3).collect()}
    assert got == {i: (min(values[a : z + 1]), max(values[a : z + 1]), sum(values[a : z + 1])) for i, a, z in asked}


def test_filters(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    made = filters.xor_filter(keys, "k", 3)
    got = filters.xor_has(keys.unionAll(keys.select(F.col("k") + 10**6)), made, "k", 3).collect()
    assert all(r.maybe for r in got if r.k < 10**6) and sum(r.maybe for r in got if r.k >= 10**6) < 60
    assert not filters.xor_has(keys.limit(5), made.limit(0), "k", 3).where("maybe").count()
    table = filters.cuckoo_table(keys.unionAll(keys.limit(1)), "k", 3000, 24)
    assert table.agg(F.sum("n")).first()[0] == 3001
    once = filters.cuckoo_without(table, filters.cuckoo_table(keys, "k", 3000, 24))
    assert filters.cuckoo_has(keys, once, "k", 3000, 24).where("maybe").count() == 1


def test_pdf_texts(spark):
    pages = ["one (a) \\ b\nzwei äöü", "", "drei €"]
    data = pdf._written(pages)
    assert pdf.pages_of(data) == pages
    plain_file = b"%PDF-1.3\n1 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] >> endobj\n2 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n3 0 obj << /Type /Page /Contents 5 0 R >> endobj\n4 0 obj << /Length 9 >> stream\nBT (b\\(x\\)\\101) Tj T* [(c) -300 (d) 20 (e)] TJ ET\nendstream endobj\n5 0 obj << >> stream\n<48 69> Tj\nendstream endobj"
    assert pdf.pages_of(plain_file) == ["Hi", "b(x)A\nc de"]
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no file")), (4, bytearray(b"%PDF-"))], "path int, content binary")
    assert [tuple(r) for r in pdf.read_pdf(df).orderBy("path", "page").collect()] == [(1, i + 1, p) for i, p in enumerate(pages)]


def test_triangles_of_a_hub(spark):
    rng = random.Random(4)
    edges = {(0, i) for i in range(1, 40)} | {tuple(rng.sample(range(1, 40), 2)) for _ in range(60)}
    e = {frozenset(x) for x in edges}
    want = {(a, b, c) for a in range(40) for b in range(a + 1, 40) for c in range(b + 1, 40) if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= e}
    got = [tuple(r) for r in graph.triangles(spark.createDataFrame(list(edges), "src int, dst int")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_spanning_tree_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(*rng.sample(range(30), 2), float(rng.randint(1, 9))) for _ in range(70)]
    root, want = list(range(30)), []
    for a, b, w in sorted(edges, key=lambda x: x[2]):
        if root[a] != root[b]:
            old, new = root[a], root[b]
            root = [new if x == old else x for x in root]
            want.append(w)
    tree = graph.minimum_spanning_tree(spark.createDataFrame(edges, "src int, dst int, weight double")).collect()
    assert len(tree) == len(want) and sum(r.weight for r in tree) == sum(want)


def test_dbscan_of_copies_and_dense_cells(spark, monkeypatch):
    """Against brute force; points of dense cells and copies are not paired with each other."""
    rng = random.Random(6)
    flat = [[rng.choice([0, 3, 6]) + rng.random() * s, rng.random() * s] for s in (0.5, 2.5) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(flat + [[9.0, 9.0]] * 150 + [[9.3 + rng.random() / 9, 9.3] for _ in range(50)] + [[20.0, 20.0]])]
    for eps, least in ((0.3, 5), (0.7, 4)):
        near = {i: [j for j, w in rows if ((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5 <= eps] for i, v in rows}
        core = {i for i, js in near.items() if len(js) >= least}
        label = {i: i for i in core}
        for _ in core:
            new = {i: min(label[j] for j in near[i] if j in core) for i in core}
            if new == label:
                break
            label = new
        want = {i: (label.get(i, min((label[j] for j in near[i] if j in core), default=None)), i in core) for i, _ in rows}
        frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
        assert {r.id: (r.cluster, r.core) for r in vectors.dbscan(frame, "id", "v", eps, least).collect()} == want
    made, real = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: made.append(edges.count()) or real(edges))
    many = spark.createDataFrame([(i, [float(i % 20) / 100, 0.0]) for i in range(400)], "id long, v array<double>")
    assert {(r.cluster, r.core) for r in vectors.dbscan(many, "id", "v", 0.3, 5).collect()} == {(0, True)}
    assert sum(made) < 400


def test_equal_scores_keep_the_smaller_ids(spark):
    rows = spark.createDataFrame([(9 - i, [1.0, 0.0]) for i in range(10)], "id int, v array<double>").repartition(3)
    got = vectors.search_many(rows.where("id = 5"), rows, "id", "v", 3).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2]


def test_folds_with_nulls_and_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 4.0), (None, 2, 8.0), ("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0)], "k string, o int, v double")
    got = {(r.k, r.o): r.ema for r in windows.ema(rows, "v", 0.5, ["k"], ["o"]).collect()}
    assert got == {(None, 1): 4.0, (None, 2): 6.0, ("a", 1): None, ("a", 2): 2.0, ("a", 3): None, ("a", 4): 3.0}


def test_parsers_and_constraints(spark):
    df = spark.createDataFrame([("2 * (3 + 4) - 6 / 3",), ("1 / 0",), ("",), (None,), ("2 +",), (" -3 ",)], "s string")
    assert [r[0] for r in df.select(texts.parsed(texts.arithmetic(), "double")(F.col("s"))).collect()] == [12.0, None, None, None, None, -3.0]
    f = spark.createDataFrame([(6, -4), (0, 5), (3, 0), (None, 2)], "a long, b long").select(texts.fraction(F.col("a"), F.col("b")).alias("f")).collect()
    assert [None if r.f is None else (r.f.num, r.f.den) for r in f] == [(-3, 2), (0, 1), None, (None, None)] or [None if r.f is None else tuple(r.f) for r in f][:3] == [(-3, 2), (0, 1), None]
