"""Readers of zipped documents (EPUB, CBZ, XPS, DOCX) as rows of pages, and sinks for RTF and EPUB; framed byte streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized

_PAGES = "path string, page int, name string, text string"


def _plain(markup: str) -> str:
    """Text of markup: paragraphs and breaks become line ends, blanks are folded."""
    markup = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", markup)
    markup = re.sub(r"(?i)</(p|div|h[1-6]|li|tr|w:p)\s*>|<(br|w:br)\b[^>]*>", "\n", markup)
    lines = (" ".join(x.split()) for x in unescape(re.sub(r"<[^>]*>", "", markup)).split("\n"))
    return "\n".join(x for x in lines if x)


def _epub(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Chapters in the order of the spine."""
    box = z.read("META-INF/container.xml").decode()
    opf = re.search(r'full-path="([^"]+)"', box)[1]
    base = opf.rpartition("/")[0]
    package = z.read(opf).decode()
    items = {}
    for tag in re.findall(r"<item\b[^>]*>", package):
        a = dict(re.findall(r'([\w-]+)="([^"]*)"', tag))
        items[a.get("id")] = a.get("href")
    for ref in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', package):
        if items.get(ref):
            name = f"{base}/{items[ref]}" if base else items[ref]
            yield name, _plain(z.read(name).decode("utf-8", "replace"))


def _cbz(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Images in the natural order of their names; they have no text."""
    natural = lambda s: [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", s)]
    for name in sorted((n for n in z.namelist() if re.search(r"(?i)\.(png|jpe?g|gif|webp|bmp)$", n)), key=natural):
        yield name, ""


def _xps(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Fixed pages in order, the text of their glyphs."""
    number = lambda s: int((re.findall(r"(\d+)\.fpage$", s) or ["0"])[0])
    for name in sorted((n for n in z.namelist() if n.endswith(".fpage")), key=number):
        yield name, "\n".join(unescape(x) for x in re.findall(r'UnicodeString="([^"]*)"', z.read(name).decode("utf-8", "replace")))


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    yield "word/document.xml", _plain(re.sub(r"<w:tab\b[^>]*>", " ", z.read("word/document.xml").decode("utf-8", "replace")))


READERS = {"epub": _epub, "cbz": _cbz, "xps": _xps, "docx": _docx}


def read_pages(files: DataFrame, kind: str | None = None) -> DataFrame:
    """path, page (from 1), name and text of the pages of documents (path, content); the kind is the path's ending where not given. A document that can't be read has one page 0 with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = []
                try:
                    reader = READERS[kind or path.rpartition(".")[2].lower()]
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i, n, t) for i, (n, t) in enumerate(reader(z), 1)]
                except (KeyError, TypeError, zipfile.BadZipFile) as e:
                    rows = [(path, 0, type(e).__name__, None)]
                yield pd.DataFrame(rows, columns=["path", "page", "name", "text"])

    return files.select("path", "content").mapInPandas(run, _PAGES)


def rtf_escape(s: Column) -> Column:
    """Text for an RTF file: braces and backslashes escaped, line ends as paragraphs, other characters by number."""

    @vectorized("string")
    def run(x: pd.Series) -> pd.Series:
        one = lambda t: "".join("\\" + c if c in "\\{}" else "\\par\n" if c == "\n" else c if ord(c) < 128 else f"\\u{ord(c) if ord(c) < 32768 else ord(c) - 65536}?" for c in t)
        return pd.Series([None if t is None else one(t) for t in x], dtype=object)

    return run(s)


def rtf(pages: DataFrame, text: str, *ord: str) -> Iterable[str]:
    """An RTF file of pages in order, streamed."""
    yield "{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Times New Roman;}}\n"
    for i, r in enumerate(pages.orderBy(*ord).select(rtf_escape(F.col(text))).toLocalIterator()):
        yield ("\\page\n" if i else "") + (r[0] or "") + "\\par\n"
    yield "}"


def epub(title: str, chapters: DataFrame, name: str, text: str, *ord: str) -> bytes:
    """A book of chapters in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        n = 0
        for n, r in enumerate(chapters.orderBy(*ord).select(name, text).toLocalIterator(), 1):
            body = "".join(f"<p>{esc(x)}</p>" for x in (r[1] or "").split("\n"))
            z.writestr(f"c{n}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(r[0] or "")}</title></head><body><h1>{esc(r[0] or "")}</h1>{body}</body></html>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(1, n + 1))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, n + 1))
        z.writestr("book.opf", f'<?xml version="1.0"?><package version="3.0" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{esc(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
    return out.getvalue()


def frame(payload: Column) -> Column:
    """Four bytes of length, big-endian, and the payload."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0")), payload.cast("binary"))


@vectorized("array<binary>")
def unframe(data: pd.Series) -> pd.Series:
    """Payloads of a stream of frames; an unfinished one at the end is left out."""

    def one(d: bytes) -> list[bytes]:
        out, at = [], 0
        while at + 4 <= len(d):
            n = int.from_bytes(d[at : at + 4], "big")
            if at + 4 + n > len(d):
                break
            out.append(d[at + 4 : at + 4 + n])
            at += 4 + n
        return out

    return pd.Series([None if d is None else one(bytes(d)) for d in data])
