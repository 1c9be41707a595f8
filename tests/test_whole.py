"""Queries over whole tables against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from brindle import registry
from brindle.operators.search import STOP_WORDS


def test_postings_of_all_documents(spark, tmp_path):
    rng = random.Random(1)
    words = [w for w in ("alpha", "beta", "gamma", "delta") if w not in STOP_WORDS]
    texts = {i: " ".join(rng.choice(words) for _ in range(5)) for i in range(250)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.term, r.doc_id): r.tf for r in registry.QUERIES["search_postings"](spark, str(tmp_path)).collect()}
    assert got == Counter((w, i) for i, t in texts.items() for w in t.split())


def folds(values):
    """(ema, macd, signal, kalman) of each value of a series."""
    ema, a, b, s, x, p = values[0], values[0], values[0], 0.0, values[0], 2 / 3
    out = [(ema, 0.0, s, x)]
    for v in values[1:]:
        ema = 0.25 * v + 0.75 * ema
        a, b = a + (v - a) * 2 / 13, b + (v - b) * 2 / 27
        s = 0.2 * (a - b) + 0.8 * s
        gain = (p + 1) / (p + 2)
        x, p = x + gain * (v - x), (1 - gain) * (p + 1)
        out.append((ema, a - b, s, x))
    return out


def test_folds_of_all_users(spark, tmp_path):
    rng = random.Random(2)
    series = {u: [rng.uniform(0, 100) for _ in range(rng.randint(1, 30))] for u in range(1, 41)}
    start = datetime(2024, 1, 1)
    rows = [(u * 100 + i, u, start + timedelta(hours=i), v) for u, vs in series.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = {u * 100 + i: f for u, vs in series.items() for i, f in enumerate(folds(vs))}
    ema, macd, kalman = ({r.event_id: r for r in registry.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("series_ema", "series_macd", "series_kalman"))
    assert set(ema) == set(macd) == set(kalman) == set(want)
    for i, (e, m, s, k) in want.items():
        assert (ema[i].ema, macd[i].macd, macd[i].signal, kalman[i].estimate) == pytest.approx((e, m, s, k), abs=2e-4)
        assert macd[i].histogram == pytest.approx(m - s, abs=2e-4)


def test_graphs_of_all_line_items(spark, tmp_path):
    rng = random.Random(3)
    edges = [(rng.randint(1, 12), rng.choice([rng.randint(1, 40), rng.randint(41, 90)]), float(rng.randint(1, 50))) for _ in range(45)]
    spark.createDataFrame(edges, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda n: registry.QUERIES[n](spark, str(tmp_path)).collect()
    root = {x: x for a, b, _ in edges for x in (a, b)}
    for _ in root:
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in run("graph_components")} == root
    level = {min(root): 0}
    for _ in root:
        for a, b, _ in edges:
            for x, y in ((a, b), (b, a)):
                if x in level:
                    level[y] = min(level.get(y, 99), level[x] + 1)
    assert {r.node: r.level for r in run("graph_bfs")} == level
    tree, kept = {x: x for x in root}, []
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if tree[a] != tree[b]:
            old, new = tree[a], tree[b]
            tree = {x: new if t == old else t for x, t in tree.items()}
            kept.append(w)
    assert [tuple(r) for r in run("graph_spanning_tree")] == [(len(kept), sum(kept))]
    assert {r.node for r in run("graph_page_rank")} == set(root)


def test_outer_joins_keep_every_order_and_customer(spark, tmp_path):
    spark.createDataFrame([(i, i % 9) for i in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"c{i}") for i in range(11)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = registry.QUERIES["join_full"](spark, str(tmp_path)).collect()
    assert {r.o_orderkey for r in rows} == {*range(40), None} and {r.c_custkey for r in rows} == {*range(0, 22, 2), None}


def test_losses_of_probabilities_near_one(spark, tmp_path):
    """Against the query's SQL, which clips nothing."""
    import duckdb

    rows = [(i, "purchase" if i % 3 else "view", v) for i, v in enumerate([0.0, 12.5, 745.0, 750.0, 760.0, 741.5, -650.0, -700.0, 55.0])]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = registry.QUERIES["stat_losses"](spark, str(tmp_path)).first()
    assert tuple(got) == pytest.approx(con.execute(registry.SQL["stat_losses"]).fetchall()[0], abs=2e-6)
