"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from brindle import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    text = lambda v: "%.9g" % v if isinstance(v, float) else str(int(v)) if type(v).__name__ == "Decimal" and v == int(v) else str(v)
    return names, sorted(tuple(text(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toArrow()
    if name in registry.SQL:
        assert rows(got) == rows(duck.sql(registry.SQL[name]).to_arrow_table())
    else:
        assert got.num_rows > 0
