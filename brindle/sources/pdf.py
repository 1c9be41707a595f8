"""Page texts of PDF files, a plain PDF writer, roles of page lines, and repair of recognised text."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_PIECE = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
# fixed values: escapes in literal strings
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _text(raw: bytes) -> str:
    """A literal or hexadecimal string: UTF-16 if it is marked so, else Latin."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] not in b"89" else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _shown(content: bytes) -> str:
    """What a content stream shows: a line for each move to another line, a blank for wide gaps within an array."""
    out: list[str] = []
    stack: list[bytes] = []
    for m in _PIECE.finditer(content):
        p = m[0]
        if p[:1] in b"(<[]/+-.0123456789":
            stack.append(p)
            continue
        strings = [x for x in stack if x[:1] in b"(<"]
        if p in (b"Tj", b"'", b'"') and strings:
            if p != b"Tj":
                out.append("\n")
            out.append(_text(strings[-1]))
        elif p == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_text(x))
                elif x[:1] in b"+-.0123456789" and float(x) < -200:
                    out.append(" ")
        elif p in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        stack.clear()
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def pages_of(data: bytes) -> list[str]:
    """Texts of the pages in the order of the page tree; streams are plain or deflated."""
    objects: dict[int, tuple[bytes, bytes | None]] = {}

    def add(number: int, body: bytes) -> None:
        s = _STREAM.match(body)
        stream = s[2] if s else None
        if s and b"/FlateDecode" in s[1]:
            try:
                stream = zlib.decompressobj().decompress(s[2])
            except zlib.error:
                stream = b""
        objects[number] = (s[1] if s else body, stream)

    for number, body in _OBJECT.findall(data):
        add(int(number), body)
    for head, stream in list(objects.values()):  # objects that stand within a stream
        if stream is not None and b"/ObjStm" in head:
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
            numbers = [int(x) for x in stream[:first].split()[: 2 * n]]
            bounds = [first + x for x in numbers[1::2]] + [len(stream)]
            for k, a, z in zip(numbers[::2], bounds, bounds[1:]):
                add(k, stream[a:z])
    kind = lambda head, name: re.search(rb"/Type\s*/" + name + rb"\b", head) is not None
    refs = lambda head, name: [int(x) for x in _REF.findall((re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head) or [b"", b""])[1])]
    order: list[int] = []
    inner = {k for head, _ in objects.values() if kind(head, b"Pages") for k in refs(head, b"Kids")}
    stack = [k for k, (head, _) in sorted(objects.items(), reverse=True) if kind(head, b"Pages") and k not in inner]
    seen: set[int] = set()
    while stack:
        k = stack.pop()
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if kind(objects[k][0], b"Pages"):
            stack += reversed(refs(objects[k][0], b"Kids"))
        elif kind(objects[k][0], b"Page"):
            order.append(k)
    order = order or [k for k, (head, _) in sorted(objects.items()) if kind(head, b"Page")]
    return [_shown(b"\n".join(objects[c][1] or b"" for c in refs(objects[k][0], b"Contents") if c in objects)) for k in order]


@vectorized("array<string>")
def pdf_pages(data: pd.Series) -> pd.Series:
    """The texts of a file's pages; null for what is no such file."""
    return data.map(lambda b: pages_of(bytes(b)) if b is not None and bytes(b[:1024]).find(b"%PDF-") >= 0 else None)


def read_pdf(files: DataFrame) -> DataFrame:
    """path, page (from 1) and text of files (path, content), as of ``documents.read_binary``."""
    return files.select("path", F.posexplode(pdf_pages(F.col("content"))).alias("page", "text")).select("path", (F.col("page") + 1).alias("page"), "text")


def _written(pages: list[str]) -> bytes:
    out, at = bytearray(b"%PDF-1.4\n"), {}

    def add(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)))
    add(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    for i, text in enumerate(pages):
        lines = [b"<feff" + line.encode("utf-16-be").hex().encode() + b"> Tj" for line in text.split("\n")]
        stream = zlib.compress(b"BT /F1 11 Tf 50 780 Td 14 TL\n" + b"\nT*\n".join(lines) + b"\nET")
        add(4 + 2 * i, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        add(5 + 2 * i, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    start, n = len(out), len(at) + 1
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % at[i] for i in range(1, n)))
    out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, start))
    return bytes(out)


@vectorized("binary")
def pdf_of(pages: pd.Series) -> pd.Series:
    """A file with a page for each text; lines are not wrapped."""
    return pages.map(lambda p: None if p is None else _written([x or "" for x in p]))


def line_roles(lines: DataFrame, page: str, size: str, text: str, y: str, height: float) -> DataFrame:
    """``lines`` with role: heading (a fifth larger than the page's middle size, or more), footnote (a tenth smaller, in the lowest fifth; y counts down), list, paragraph; and level, the place of a heading's size."""
    middle = lines.groupBy(page).agg(F.percentile(size, F.lit(0.5)).alias("_mid"))
    rows = lines.join(middle, page)
    item = F.col(text).rlike(r"^\s*([-*\u2022]|[0-9]+[.)]|[a-z][.)])\s")
    role = F.when(F.col(size) >= 1.2 * F.col("_mid"), "heading").when((F.col(size) <= 0.9 * F.col("_mid")) & (F.col(y) >= 0.8 * height), "footnote").when(item, "list").otherwise("paragraph")
    w = Window.partitionBy(page, "role").orderBy(F.desc(size))
    return rows.withColumn("role", role).withColumn("level", F.when(F.col("role") == "heading", F.dense_rank().over(w))).drop("_mid")


def repaired(text: Column) -> Column:
    """Recognised text with likely mistakes undone: letters for digits within numbers and digits for letters within words, words cut at line ends, runs of blanks."""
    # fixed values: signs that are taken for others
    for wrong, right in (("[OoQ]", "0"), ("[lI|]", "1"), ("S", "5"), ("B", "8")):
        text = F.regexp_replace(text, rf"(?<=[0-9]){wrong}(?=[0-9])", right)
    for wrong, right in (("0", "o"), ("1", "l"), ("5", "s")):
        text = F.regexp_replace(text, rf"(?<=[a-z]){wrong}(?=[a-z])", right)
    text = F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n"))
