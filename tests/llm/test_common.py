import os

import pytest
from pyspark.sql import functions as F

from brindle.llm import common


def test_keep_and_release(spark):
    df = common.keep(spark.range(10).withColumn("x", F.lit("a")), "t")
    assert df.count() == 10 and df._brindle_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.drop_kept(df)
    assert not os.path.exists(df._brindle_path.removeprefix("file://"))
    common.keep(spark.range(3), "u")
    folder = common.shared_folder(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    common.release(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 5), (7, 3), (3, 7), (9, 8), (8, 3)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    # the smallest node need not be listed, as it is its own root
    assert {n: r for n, r in root.items() if r != n} == {n: r for n, r in got.items() if r != n}


def test_scratch(spark):
    import pathlib

    paths = []
    with common.scratch() as outer:
        with common.scratch() as result:
            paths.append(common.keep(spark.range(3), "a")._brindle_path)
            out = result(spark.range(4), "b")
        assert not pathlib.Path(paths[0].removeprefix("file://")).exists() and out.count() == 4
        last = outer(out.where("id > 1"), "c")
    assert last.count() == 2 and not pathlib.Path(out._brindle_path.removeprefix("file://")).exists()
