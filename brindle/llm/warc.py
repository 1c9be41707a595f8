"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts archives into byte ranges. A
task looks for the gzip magic in its range, validates a candidate by decoding the head
of the member up to the end of the record's headers, and owns the records that start
inside its range, reading past its end for the last of them. After a valid member it
goes on where that ends, so magic bytes inside a member are not looked at; at the start
of a range they are, and fail to decode as a record.

Archives are written by the tasks through an Arrow file system to the shared folder,
each attempt under a name of its own; the list of archives comes from the tasks that
succeeded, so leftovers of lost tasks are never read.

Defined results: page_id is a whole number; others raise. A null html is an empty payload. Among equal payloads the largest
page_id is the response; of rows that repeat that page_id, those of the largest url
are. A row with a null page_id revisits any other of its payload. Empty tables give no
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once.
BLOCK = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


def clean(value: str | None) -> str:
    """A header's value: line ends and other controls are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    own = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", clean(url)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is None:
        return member([("WARC-Type", "response"), *own, ("Content-Type", "text/html")], payload)
    return member([("WARC-Type", "revisit"), *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], b"")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to, the page_id of the response that a revisit repeats.

    Payloads are compared by their SHA-256. Groups of one row, mostly all, are not joined back.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("sha"))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("top")).where("n > 1").select("sha", "top")
    joined = rows.join(groups, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("top").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("top")), F.col("top.page_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder`` from ``pages`` (page_id, url, html, refers_to); path, size and records of each, as a kept table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = size = 0
        for b in batches:
            if b.num_rows and out is None:
                store, where = fs.FileSystem.from_uri(folder)
                store.create_dir(where, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{where}/{name}", compression=None)
            for row in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))):
                data = record(*row)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

    return keep(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long, records long"), "warc-list")


class Source:
    """A file that is read forward in blocks from an offset."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, bytearray()

    def more(self) -> bool:
        """Another block behind the data held; false at the end of the file."""
        start = self.at + len(self.data)
        got = self.file.read_at(min(BLOCK, self.size - start), start) if start < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def decoded(src: Source) -> tuple[dict[str, str], bytes] | None:
    """The record of the member at the source's offset, which then moves past it; None, and no move, if there is no valid one."""
    z, out, at, step = zlib.decompressobj(31), bytearray(), 0, 1 << 14
    head: dict[str, str] | None = None
    size = looked = 0
    while not z.eof:
        while at >= len(src.data):
            if not src.more():
                return None
        piece = bytes(src.data[at : at + step])
        try:
            out += z.decompress(piece)
        except zlib.error:
            return None
        at += len(piece)
        if head is None and out:  # judged by the first bytes that come out
            if not bytes(out[:7]).startswith(b"WARC/1."[: len(out)]):
                return None
            end = out.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(out)
            if end >= 0:
                head, size = _headers(bytes(out[:end])), end + 4
                if not head.get("content-length", "").isdigit():
                    return None
                step = BLOCK
    if head is None or len(out) < size + int(head["content-length"]):
        return None
    src.skip(at - len(z.unused_data))
    return head, bytes(out[size : size + int(head["content-length"])])


def records_in(file, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and body of each record that starts in [start, stop)."""
    src = Source(file, start, size)
    while src.at < stop:
        i = src.data.find(MAGIC)
        if i < 0:
            keep_last = max(0, len(src.data) - len(MAGIC) + 1)
            src.skip(keep_last)
            if not src.more():
                return
            continue
        src.skip(i)
        if src.at >= stop:
            return
        at = src.at
        got = decoded(src)
        if got is None:
            src.skip(1)
        else:
            yield at, *got


def splits(archives: DataFrame, split_bytes: int) -> DataFrame:
    """path, size, start, stop: the byte ranges of ``archives`` (path, size), dealt out."""
    cut = archives.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split_bytes}L)")).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + split_bytes, "size"))


def read(archives: DataFrame, *, split_bytes: int = 16 << 20, tasks: int | None = None) -> DataFrame:
    """The records of ``archives`` (path, size): path, offset, headers and body."""
    schema = "path string, offset long, headers map<string, string>, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["path", "offset", "headers", "body"])

        held, weight = [], 0
        for b in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as f:
                    for at, head, body in records_in(f, size, start, stop):
                        held.append((path, at, list(head.items()), body))
                        weight += len(body) + 500
                        if weight > 8 << 20:
                            yield flush()
                            held, weight = [], 0
        if held:
            yield flush()

    ranges = splits(archives.select("path", "size"), split_bytes)
    spark: SparkSession = archives.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, F.col("path"), F.col("start")).mapInArrow(run, schema)


def round_trip(pages: DataFrame, *, least_bytes: int = 0, split_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write(revisits(pages, least_bytes), folder)
    found = read(archives, split_bytes=split_bytes)
    head = lambda name: F.col("headers")[name]
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    records = keep(found.select(
        number(head("warc-record-id")).alias("page_id"), head("x-payload-length").cast("long").alias("payload_bytes"), F.regexp_replace(head("warc-payload-digest"), "^sha1:", "").alias("payload_digest"),
        head("warc-type").alias("record_type"), number(head("warc-refers-to")).alias("refers_to"),
    ), "warc-records")
    written, got = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if written != got:
        raise RuntimeError(f"{written} records were written, {got} read")
    return records
