"""Sinks of documents: HTML, XML, spreadsheets and books, written from results.

The text of each row is made in Spark; a file that holds a whole result is streamed through the driver row by row, so
it is for results that a person reads. Large results are written as tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import column_letters
from ..functions.strings import escape_html


def html_row(*columns: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def html_table(df: DataFrame) -> Iterable[str]:
    yield "<table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    for r in df.select(html_row(*[F.col(c) for c in df.columns])).toLocalIterator():
        yield r[0]
    yield "</table>"


def xml_record(tag: str, **columns: Column) -> Column:
    """<tag><name>value</name>...</tag>; nulls are left out."""
    fields = [F.when(c.isNotNull(), F.concat(F.lit(f"<{n}>"), escape_html(c.cast("string")), F.lit(f"</{n}>"))).otherwise("") for n, c in columns.items()]
    return F.concat(F.lit(f"<{tag}>"), *fields, F.lit(f"</{tag}>"))


def form_fields(df: DataFrame, name: str, value: str) -> Iterable[str]:
    """Form data as XFDF."""
    yield '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'
    row = F.concat(F.lit('<field name="'), escape_html(F.col(name).cast("string")), F.lit('"><value>'), escape_html(F.coalesce(F.col(value).cast("string"), F.lit(""))), F.lit("</value></field>"))
    for r in df.select(row).toLocalIterator():
        yield r[0]
    yield "</fields></xfdf>"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _escaped(s: object) -> str:
    return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def xlsx(df: DataFrame, limit: int = 100_000) -> bytes:
    """A workbook of one sheet with a header, of at most ``limit`` rows; more raise."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{column_letters(c)}{r}"
        if isinstance(v, bool) or v is None or not isinstance(v, (int, float)):
            return "" if v is None else f'<c r="{ref}" t="inlineStr"><is><t>{_escaped(v)}</t></is></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    rows = [df.columns]
    for row in df.limit(limit + 1).toLocalIterator():
        rows.append(list(row))
    if len(rows) > limit + 1:
        raise ValueError("more rows than a sheet is meant for")
    sheet = "".join(f'<row r="{i}">' + "".join(cell(i, j, v) for j, v in enumerate(row, 1)) + "</row>" for i, row in enumerate(rows, 1))
    return _zip({
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet xmlns="{_SHEET}"><sheetData>{sheet}</sheetData></worksheet>',
    })


def docx(paragraphs: DataFrame, text: str, *ord: str) -> bytes:
    """A document of a result's paragraphs in order."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escaped(r[0] or "")}</w:t></w:r></w:p>' for r in paragraphs.orderBy(*ord).select(text).toLocalIterator())
    return _zip({
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>',
    })


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook, as text."""
    import re
    from html import unescape

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        sheet = z.read(next(n for n in names if n.startswith("xl/worksheets/"))).decode()
        shared = re.findall(r"<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode(), re.S) if "xl/sharedStrings.xml" in names else []
    rows = []
    for row in re.findall(r"<row\b[^>]*?(?:/>|>(.*?)</row>)", sheet, re.S):
        cells = []
        for attrs, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
            value = "".join(re.findall(r"<(?:t|v)\b[^>]*>(.*?)</(?:t|v)>", body, re.S))
            cells.append(unescape(re.sub("<[^>]*>", "", shared[int(value)])) if 't="s"' in attrs else unescape(value))
        rows.append(cells)
    return rows
