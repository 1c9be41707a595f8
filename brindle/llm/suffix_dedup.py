"""Removal of repeated byte strings by merged shard Burrows-Wheeler transforms.

Every byte in a ``length``-byte string that also starts earlier (smaller doc_id, or
earlier in the document) is removed. The texts are written once, as shard files; they
are never shuffled.

1. Contexts. Each window of ``length`` bytes is assigned to its anchor, the leftmost
   position with the least hash of ``gram`` bytes in it; equal windows have anchors at
   equal places. All windows of one anchor together cover its context, some 130 bytes.
   Contexts are shuffled by the anchor's gram. Of equal ones all but the first are
   repeated whole; those that stand earlier in the same part of a shard are known before the
   shuffle and go along under keys of their own, so a line that stands in every
   document sends one row for each part. A context whose gram stands in no other context is unique.
2. Families. What is left is cut into two halves of windows, each with a core of
   62 bytes that all its windows share, and shuffled by the core. Only the halves with
   equal cores can share windows: a family.
3. Transforms. In each batch of families the strings of each group of shard files get their
   Burrows-Wheeler transform, with the core, equal in a family, as one symbol. The transforms are
   merged by interleave refinement (module bwt); intervals with a common prefix of a
   whole window are repeated windows, and all but the first start are removed.
   A family past ``family_rows`` strings is not held in a task: its windows are handed
   on by their hashes and the first of each is found by an aggregation.
4. The removed intervals go back to the shard files by a shuffle of their bounds.

Why not the transforms of whole shards: see the README (a pass of the refinement costs
some 30 ns a byte, and texts need ``length`` passes).

Hashes decide steps 1 and 3 only beside other equal bits: contexts are equal by two
64-bit hashes, of gram and of context; handed-on windows by two of the window.

Defined results: doc_id is a whole number, since texts are ordered by it; others raise. A null text is empty. Of rows that repeat a doc_id the earlier one is
that of the smaller shard and position. A null doc_id is earlier than any other. Texts
under ``length`` bytes lose nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bwt
from .common import keep, new_path

SHARD_BYTES = 64 << 20
#: Symbols of a batch of families, and the codes past the byte values: the sentinel, and the first core.
BATCH, SENTINEL, CORE = 1 << 16, 256, 257
_MASK = np.uint64(0xFFFFFFFF)


class Hashes:
    """Hashes of all substrings of a text from one running sum, modulo 2**64: byte values are drawn at random."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((sums[stop] - sums[start]) * self.inverses[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Contexts:
    """Anchors and contexts of texts."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.hashes = length, gram, Hashes(1)
        #: windows that start this many bytes before the anchor or more are the second half
        self.middle = (length - gram) // 2 + 1
        #: bytes that all windows of a half share: from the anchor, or from ``middle`` before it
        self.core = min(length - self.middle + 1, self.middle + gram)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each anchor, its place, its gram's hash, and the text's sums."""
        n, k = len(data), self.gram
        sums = self.hashes.sums(data)
        at = np.arange(n - k + 1)
        grams = self.hashes.of(sums, at, at + k)
        least, width, w = (grams & ~_MASK) | at.astype(np.uint64), 1, self.length - k + 1
        while 2 * width <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
        place = (least & _MASK).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(place) - 1]])
        place = place[first]
        return first, last, place, grams[place], sums

    def contexts(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """gram, context, first, last of each anchor; equal contexts have equal places in them."""
        first, last, place, grams, sums = self.anchors(data)
        whole = self.hashes.of(sums, first, last + self.length)
        shape = ((last - first) << 8 | (place - first)).astype(np.uint64)
        return grams.view(np.int64), _mixed(whole + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), first, last


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def write_shards(docs: DataFrame) -> DataFrame:
    """Shard files of ``docs`` (doc_id, text): path, and the shard's number."""
    folder = new_path(docs.sparkSession, "shards")
    schema = _schema(("doc_id", pa.int64()), ("text", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        writer, size, paths = None, 0, []
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                if writer is None:
                    store.create_dir(where, recursive=True)
                    paths.append(f"{uuid.uuid4().hex}.parquet")
                    writer, size = pq.ParquetWriter(f"{where}/{paths[-1]}", schema, filesystem=store, compression="zstd", use_dictionary=False, write_statistics=False), 0
                writer.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text").cast(pa.binary())], schema=schema))
                size += part.nbytes
                if size > SHARD_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in paths], pa.string())], names=["path"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = keep(rows.mapInArrow(run, "path string"), "shard-paths")
    # one row for each shard of 64 MB: few enough to number in one window
    return keep(listed.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("shard")), "shard-list")


def _texts(path: str) -> Iterator[tuple[int | None, bytes]]:
    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=500):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                yield d, t or b""


def _batch(columns: list[list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)


FOUND = "row long, at long"  # row: shard << 32 | place in it; at: first window << 8 | windows after it


def _window_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the windows first to last joined where they follow each other in a row, as values of ``at``."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)])
    starts, stops = first[new], last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(last) - 1]])]
    parts = (stops - starts) // 256 + 1
    begin = np.repeat(starts, parts) + 256 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return np.repeat(row[new], parts), begin << 8 | np.minimum(np.repeat(stops, parts) - begin, 255)


def _combined(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[list[np.ndarray]]:
    """The first of each context under its gram, and the others, which are repeated for certain, as runs under keys of their own."""
    order = np.lexsort((first, row, doc, context, gram))
    gram, context, doc, row, first, last = (x[order] for x in (gram, context, doc, row, first, last))
    own = np.ones(len(order), bool)
    own[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    again = np.flatnonzero(~own)
    again = again[np.lexsort((first[again], row[again]))]
    rows, runs = _window_runs(row[again], first[again], last[again])
    spread = _mixed((runs + (rows << 20)).astype(np.uint64)).view(np.int64)
    both = lambda x, y: [np.concatenate([x[own], y])]
    return [both(gram, spread), both(context, spread), both(doc, np.zeros(len(rows), np.int64)), both(row, -rows - 1), both(first << 8 | (last - first), runs)]


#: Contexts of a shard that are combined at once.
PART = 400_000


def _context_rows(shards: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    schema = _schema(*((n, pa.int64()) for n in ("gram", "context", "doc", "row", "at")))
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Contexts(length, gram)

        def combined(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            whole = _batch(_combined(*(np.concatenate(x) for x in held)), schema)
            yield from (whole.slice(i, 50_000) for i in range(0, whole.num_rows, 50_000))

        for b in batches:
            for path, shard in zip(b.column("path").to_pylist(), b.column("shard").to_pylist()):
                held: list[list[np.ndarray]] = [[], [], [], [], [], []]
                size = 0
                for i, (doc, text) in enumerate(_texts(path)):
                    if len(text) < length:
                        continue
                    grams, contexts, first, last = c.contexts(np.frombuffer(text, np.uint8))
                    n = len(first)
                    for column, x in zip(held, (grams, contexts, np.full(n, least if doc is None else doc), np.full(n, shard << 32 | i), first, last)):
                        column.append(x)
                    size += n
                    if size > PART:
                        yield from combined(held)
                        held, size = [[], [], [], [], [], []], 0
                if size:
                    yield from combined(held)

    dealt = shards.repartition(parts)
    return dealt.mapInArrow(run, "gram long, context long, doc long, row long, at long")


def _sieve(contexts: DataFrame) -> DataFrame:
    """row, at and kind (0: repeated whole; 1: its gram stands in another context) from the contexts, by one sorted pass."""
    schema = _schema(("row", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # gram and context of the last row
        held = None  # the last first row of a context: gram, row, at; and whether it is out
        for b in batches:
            g, x, row, at = (b.column(n).to_numpy() for n in ("gram", "context", "row", "at"))
            within = row < 0
            if within.any():  # not the first in its part of a shard
                yield _batch([[-row[within] - 1], [at[within]], [np.zeros(within.sum(), np.int32)]], schema)
                g, x, row, at = (v[~within] for v in (g, x, row, at))
            if not len(g):
                continue
            fresh = np.concatenate([[before != (g[0], x[0])], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
            before = (g[-1], x[-1])
            rows, ats, kinds = [row[~fresh]], [at[~fresh]], [np.zeros((~fresh).sum(), np.int32)]
            fg, fr, fa = g[fresh], row[fresh], at[fresh]
            if len(fg):
                if held is not None:
                    fg, fr, fa = (np.concatenate([[h], v]) for h, v in zip(held[:3], (fg, fr, fa)))
                same = np.concatenate([[False], fg[1:] == fg[:-1], [False]])
                cand = same[:-1] | same[1:]
                out = bool(cand[-1]) or (len(fg) == 1 and held is not None and held[3])
                if held is not None and held[3]:
                    cand[0] = False
                held = (fg[-1], fr[-1], fa[-1], out)
                rows.append(fr[cand]), ats.append(fa[cand]), kinds.append(np.ones(cand.sum(), np.int32))
            yield _batch([rows, ats, kinds], schema)

    return contexts.mapInArrow(run, "row long, at long, kind int")


def _piece_rows(found: DataFrame, length: int, gram: int) -> DataFrame:
    """The halves of the contexts ``found`` (path, row, at): core (a hash), doc, row, start, left and right of the core."""
    schema = _schema(("core", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("left", pa.binary()), ("right", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Contexts(length, gram)
        held: list[tuple] = []

        def pieces(doc: int | None, text: bytes, row: int, firsts: list[int]) -> None:
            data = np.frombuffer(text, np.uint8)
            first, last, place, _, sums = c.anchors(data)
            which = np.searchsorted(first, np.array(firsts))
            for s, e, a in zip(first[which].tolist(), last[which].tolist(), place[which].tolist()):
                for half, x, y, core in ((0, max(s, a - c.middle + 1), e, a), (1, s, min(e, a - c.middle), a - c.middle)):
                    if x <= y:  # windows x to y share the bytes from core on
                        width = c.core
                        h = c.hashes.of(sums, np.array([core]), np.array([core + width]))[0] ^ np.uint64(half)
                        held.append((int(h.view(np.int64)), -(1 << 63) if doc is None else doc, row, x, text[x:core], text[core + width : y + length]))

        for path, rows in _by_shard(batches):
            texts = enumerate(_texts(path))
            for row, firsts in rows:
                for i, (doc, text) in texts:
                    if i == row & 0xFFFFFFFF:
                        pieces(doc, text, row, firsts)
                        break
                if len(held) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    return found.mapInArrow(run, "core long, doc long, row long, start long, left binary, right binary")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[int, list[int]]]]]:
    """path, and an iterator of (row, its values of at, first windows only) from rows sorted by row; each inner one is used up before the next."""
    flat = (x for b in batches for x in zip(b.column("path").to_pylist(), b.column("row").to_pylist(), b.column("at").to_pylist()))
    head = next(flat, None)

    def rows(path: str) -> Iterator[tuple[int, list[int]]]:
        nonlocal head
        while head is not None and head[0] == path:
            row, values = head[1], []
            while head is not None and head[1] == row:
                values.append(head[2] >> 8)
                head = next(flat, None)
            yield row, values

    while head is not None:
        yield head[0], rows(head[0])


def repeated(families: list[list[tuple[int, int, int, bytes, bytes]]], depth: int, groups: int = 4) -> list[tuple[int, int]]:
    """(row, window) of each window that is not the first of its kind in its family, by merged transforms.

    families: strings as (doc, row, start, left, right) around the core, which counts as one symbol; a window is ``depth`` symbols.
    """
    parts: list[list[tuple]] = [[] for _ in range(groups)]
    for f, strings in enumerate(families):
        for s in strings:
            parts[(s[1] >> 32) % groups].append((f, *s))
    parts = [p for p in parts if p]
    shards, where = [], []
    for p in parts:
        pieces, ends, size = [], [], 0
        for f, _, _, _, left, right in p:
            pieces += [np.frombuffer(left, np.uint8).astype(np.uint16), np.array([CORE + f], np.uint16), np.frombuffer(right, np.uint8).astype(np.uint16), np.array([SENTINEL], np.uint16)]
            size += len(left) + len(right) + 2
            ends.append(size)
        stops = np.array(ends)
        lengths = np.diff(stops, prepend=0)
        shards.append(bwt.transform(np.concatenate(pieces), stops, int(lengths.max())))
        owner = np.repeat(np.arange(len(p)), lengths)
        where.append((owner, np.arange(size) - np.repeat(stops - lengths, lengths), np.repeat(lengths, lengths)))
    weave, block, _ = bwt.merge(shards, depth)
    at = bwt.positions(shards, weave)
    out = []
    for i, p in enumerate(parts):
        mine = weave == i
        owner, offset, size = (x[at[mine]] for x in where[i])
        whole = offset + depth < size  # the sentinel is no part of a window
        owner, offset = owner[whole], offset[whole]
        docs, rows, starts = (np.array(x) for x in zip(*((s[1], s[2], s[3]) for s in p)))
        out.append(np.stack([block[mine][whole].astype(np.int64), docs[owner], rows[owner], starts[owner] + offset]))
    table = np.concatenate(out, axis=1)
    table = table[:, np.lexsort(table[::-1])]
    again = np.concatenate([[False], table[0, 1:] == table[0, :-1]])[: table.shape[1]]
    return list(zip(table[2][again].tolist(), table[3][again].tolist()))


def _family_rows(pieces: DataFrame, length: int, gram: int, family_rows: int) -> DataFrame:
    """Repeated windows (row, at; kind 0), and the windows of families too large for a task (kind 2, with two hashes and doc)."""
    schema = _schema(("row", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()))
    depth = length - Contexts(length, gram).core + 1

    def rows_out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(2), Hashes(3)
        families: list[list[tuple]] = []
        size = 0

        def handed(core: int, strings: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            mark = np.uint64(core & 0xFFFFFFFFFFFFFFFF)
            for doc, row, start, left, right in strings:
                data = np.frombuffer(left + b"\xff" + right, np.uint8)  # the core as one byte that no text has
                at = np.arange(len(data) - depth + 1)
                h1, h2 = (_mixed(x.of(x.sums(data), at, at + depth) + mark).view(np.int64).tolist() for x in hashes)
                rows += [(row, (start + i) << 8, 2, a, b, doc) for i, (a, b) in enumerate(zip(h1, h2))]
            yield from rows_out(rows)

        def ended(core: int, strings: list[tuple], large: bool) -> Iterator[pa.RecordBatch]:
            """A family, or the next part of a large one."""
            nonlocal families, size
            if large:
                yield from handed(core, strings)
            elif len(strings) > 1:
                families.append(strings)
                size += sum(len(s[3]) + len(s[4]) + 2 for s in strings)
                if size > BATCH or len(families) > 60_000:
                    yield from rows_out([(row, at, 0, 0, 0, 0) for row, at in _runs(repeated(families, depth))])
                    families, size = [], 0

        key, strings, large = None, [], False
        for b in batches:
            for core, *string in zip(*(b.column(n).to_pylist() for n in ("core", "doc", "row", "start", "left", "right"))):
                if core != key:
                    yield from ended(key, strings, large)
                    key, strings, large = core, [], False
                elif len(strings) >= family_rows:
                    large = True
                    yield from ended(key, strings, large)
                    strings = []
                strings.append(tuple(string))
        yield from ended(key, strings, large)
        if families:
            yield from rows_out([(row, at, 0, 0, 0, 0) for row, at in _runs(repeated(families, depth))])

    return pieces.mapInArrow(run, "row long, at long, kind int, h1 long, h2 long, doc long")


def _runs(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(row, at) of the runs of neighbouring windows, of 256 at most."""
    out: list[list[int]] = []
    for row, s in sorted(windows):
        if out and out[-1][0] == row and out[-1][2] == s - 1 and s - out[-1][1] < 256:
            out[-1][2] = s
        else:
            out.append([row, s, s])
    return [(r, a << 8 | (b - a)) for r, a, b in out]


def _by_shards(found: DataFrame, shards: DataFrame, parts: int) -> DataFrame:
    """path, row, at of ``found``, a shard's rows together and in order. The list of shards is one row for each, sent to all tasks only if its size allows it."""
    rows = found.withColumn("shard", F.shiftright("row", 32)).join(shards, "shard")
    return rows.select("path", "row", "at").repartition(parts, "path").sortWithinPartitions("path", "row", "at")


def _removed(intervals: DataFrame, length: int, texts: bool) -> DataFrame:
    """The result rows: every shard file is read once more beside its intervals, sorted by row and start; a row -1 marks a shard."""
    schema = _schema(("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (x for b in batches for x in zip(b.column("path").to_pylist(), b.column("row").to_pylist(), b.column("at").to_pylist()))
        head = next(flat, None)
        while head is not None:
            path, out, weight = head[0], [], 0
            for i, (doc, text) in enumerate(_texts(path)):
                spans: list[list[int]] = []
                while head is not None and head[0] == path and (head[1] < 0 or head[1] & 0xFFFFFFFF == i):
                    if head[1] >= 0:
                        a = head[2] >> 8
                        z = a + (head[2] & 255) + length
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(z, spans[-1][1])
                        else:
                            spans.append([a, z])
                    head = next(flat, None)
                kept, last = [], 0
                for a, z in spans:
                    kept.append(text[last:a])
                    last = z
                rest = b"".join([*kept, text[last:]])
                out.append((doc, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if texts else None))
                weight += len(rest) if texts else 200
                if weight > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            while head is not None and head[0] == path:  # a marker of a shard without texts
                head = next(flat, None)

    return intervals.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, *, length: int = 100, gram: int = 24, family_rows: int = 20_000, parts: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null without ``texts``) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = write_shards(docs)
    n_shards = min(max(1, shards.count()), 100_000)  # tasks that read shards; a task may read several
    contexts = _context_rows(shards, length, gram, n_shards).repartition(parts, "gram").sortWithinPartitions("gram", "context", "doc", "row", "at")
    found = keep(_sieve(contexts), "suffix-sieve")
    pieces = _piece_rows(_by_shards(found.where("kind = 1"), shards, n_shards), length, gram).repartition(parts, "core").sortWithinPartitions("core", "doc", "row", "start")
    solved = keep(_family_rows(pieces, length, gram, family_rows), "suffix-families")
    large = solved.where("kind = 2")
    order = F.struct("doc", "row", "at")
    first = large.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    late = large.join(first, ["h1", "h2"]).where(order != F.col("first")).select("row", "at")
    intervals = found.where("kind = 0").select("row", "at").unionAll(solved.where("kind = 0").select("row", "at")).unionAll(late)
    marks = shards.select("path", F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("at"))
    placed = intervals.withColumn("shard", F.shiftright("row", 32)).join(shards, "shard").select("path", "row", "at").unionAll(marks)
    return _removed(placed.repartition(n_shards, "path").sortWithinPartitions("path", "row", "at"), length, texts)
