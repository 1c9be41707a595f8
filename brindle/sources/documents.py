"""Documents: JSON lines, key-value texts, HTML pages and tables, archives, YAML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectorized import vectorized


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; bad lines give nulls."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def key_values(s: Column) -> Column:
    """A map from lines like key=value; later lines win."""
    pairs = F.filter(F.split(s, "\n"), lambda x: F.instr(x, "=") > 0)
    keyed = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    last = F.filter(keyed, lambda p, i: ~F.exists(F.slice(keyed, i + 2, 1 << 20), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def key_values_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), "\n")


_ZIP = "path string, name string, size long, content binary"


def unzip(files: DataFrame) -> DataFrame:
    """Members of archives (path, content), one row each; archives are opened where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pd.DataFrame([(path, i.filename, i.file_size, z.read(i))], columns=["path", "name", "size", "content"])

    return files.select("path", "content").mapInPandas(run, _ZIP)


class _Tables(HTMLParser):
    """Cells of all tables, in order."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


@vectorized("array<array<array<string>>>")
def html_tables(html: pd.Series) -> pd.Series:
    def one(h: str) -> list[list[list[str]]]:
        p = _Tables()
        p.feed(h)
        return p.tables

    return pd.Series([None if h is None else one(h) for h in html])


def html_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags, entities decoded, blanks folded."""
    from ..functions.strings import normalize_whitespace, unescape_html

    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return normalize_whitespace(unescape_html(F.regexp_replace(bare, r"<[^>]*>", " ")))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_headings(html: Column) -> Column:
    """Array of struct<level, text>."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, "<[^>]*>", "")).alias("text")))


def markdown_headings(md: Column) -> Column:
    lines = F.filter(F.split(md, "\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^#+\s+", ""), r"\s+#+\s*$", "")).alias("text")))


def markdown_links(md: Column) -> Column:
    found = F.regexp_extract_all(md, F.lit(r"(?<!!)\[[^\]]*\]\([^)\s]+[^)]*\)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]]*)\]", 1).alias("text"), F.regexp_extract(m, r"\(([^)\s]+)", 1).alias("url")))


def markdown_text(md: Column) -> Column:
    """Without fences, marks of headings, lists and emphasis; links leave their text."""
    for pattern, to in ((r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^>\s?", ""), (r"\*\*|__|\*|~~", "")):
        md = F.regexp_replace(md, pattern, to)
    return F.trim(md)


def _scalar(s: str):
    s = s.strip()
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",")] if s[1:-1].strip() else []
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def parse_yaml(text: str):
    """Maps, lists and scalars by indentation; comments after blanks are left out."""
    lines = [(len(x) - len(x.lstrip()), re.sub(r"(^|\s)#.*$", "", x).strip()) for x in text.split("\n")]
    lines = [x for x in lines if x[1] and x[1] != "---"]

    def block(at: int, indent: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if rest and not re.match(r"[^\"'\[{]*:(\s|$)", rest):
                    out.append(_scalar(rest))
                    at += 1
                else:
                    if rest:
                        lines[at] = (indent + 2, rest)
                    else:
                        at += 1
                    value, at = block(at, lines[at][0])
                    out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            at += 1
            if rest.strip():
                found[_scalar(key)] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                found[_scalar(key)], at = block(at, lines[at][0])
            else:
                found[_scalar(key)] = None
        return found, at

    if not lines:
        return None
    return _scalar(lines[0][1]) if len(lines) == 1 and ":" not in lines[0][1] and not lines[0][1].startswith("-") else block(0, lines[0][0])[0]


@vectorized("string")
def yaml_to_json(text: pd.Series) -> pd.Series:
    import json

    return pd.Series([None if t is None else json.dumps(parse_yaml(t), ensure_ascii=False, separators=(",", ":")) for t in text], dtype=object)
