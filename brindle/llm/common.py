"""Helpers that the training-data operators share.

Texts cross into Python as UTF-8 bytes in Arrow batches; ``bytes.lower`` and
``bytes.split`` work on ASCII letters and on the six ASCII blanks only, which is
exactly the word rule of the operators here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark.sparkContext, "_brindle_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="brindle-")
            spark.sparkContext._brindle_shared = root
    return f"{root.rstrip('/')}/brindle-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own, like those wanted, that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever signs the names hold."""
    return [F.col(quoted(c)) for c in columns]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    if _scratches:
        _scratches[-1].append(out)
    return out


#: What is kept inside the scratches that are open.
_scratches: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables kept inside are deleted at its end, but for those kept by the function that it gives."""
    saved: list[DataFrame] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        saved.append(keep(df, name))
        return saved[-1]

    _scratches.append([])
    try:
        yield result
    finally:
        for df in _scratches.pop():
            if not any(df is s for s in saved):
                drop_kept(df)
        if _scratches:
            _scratches[-1].extend(saved)


def drop_kept(df: DataFrame) -> None:
    """Delete what keep() wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_brindle_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, once its results are read or written elsewhere."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory; the package goes to the executors with it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def out_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def connected(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is an
    aggregation and an equi-join, so no component is ever in one task, and the
    rounds grow with the logarithm of the longest path. Each round's edges are
    written to the shared folder; the one before is deleted.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        n = both(e)
        low = n.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        return n.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()

    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        nxt = keep(small(large(e)), name)
        drop_kept(e)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
