"""CSV: every field is text, short rows are filled with '', quotes double."""

from __future__ import annotations

import csv as _csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.vectorized import vectorized


def read(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", header: bool = True) -> DataFrame:
    """By an explicit list of columns: no pass over the data to infer anything. Missing cells become ''."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, sep=delimiter, header=header, multiLine=False, quote='"', escape='"', nullValue="\0", emptyValue="", mode="PERMISSIVE", enforceSchema=True)
    return df.na.fill("")


def write(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """Nulls are written as empty cells, quotes doubled, cells quoted only where they must be."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.csv(path, sep=delimiter, header=header, quote='"', escape='"', emptyValue="", mode="errorifexists")


def record(*columns: Column, delimiter: str = ",") -> Column:
    """One CSV line of the columns."""
    special = "[" + "".join("\\" + c if c in "\\]^-|" else c for c in delimiter) + "\"\r\n]"
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(delimiter, *[F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells])


@vectorized("array<array<string>>")
def parse(text: pd.Series) -> pd.Series:
    """Rows of cells of a whole CSV text in one value; '' has no rows."""
    return pd.Series([None if t is None else [list(r) for r in _csv.reader(io.StringIO(t, newline=""))] if t else [] for t in text])


def parse_lines(df: DataFrame, line: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """Records of single lines, blank ones left out."""
    parsed = F.from_csv(F.col(line), ", ".join(f"`{c}` string" for c in columns), {"sep": delimiter, "quote": '"', "escape": '"'})
    return df.where(F.trim(line) != "").select(parsed.alias("r")).select(*[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in columns])


def generator(df: DataFrame) -> Iterator[str]:
    """Lines of a bounded result, header first, streamed to the driver partition by partition."""
    yield ",".join(df.columns)
    for r in df.select(record(*[F.col(c) for c in df.columns])).toLocalIterator():
        yield r[0]
