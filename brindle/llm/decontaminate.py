"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all word sequences of the test items, each state with the items
it occurs in. Training words are streamed through it; at each word it knows the length
of the longest suffix that is a sequence of some item. A window is ``window``
consecutive item words, or a whole item of fewer; where the length reaches a window,
its words are hit. Words are first mapped to the automaton's vocabulary, and runs
without a pair of neighbours known to the items are passed over by array operations,
since no window of two words or more can lie across them.

The items are split into chunks of at most ``chunk_words`` words, one automaton and
one pass for each, so that what is sent to the tasks is bounded whatever the size of
the benchmark; the passes are joined by document.

Defined results: null or empty texts have no words and are clean. Items without words
are left out; items that share an item_id count as one. Repeated documents are judged
row by row; rows are told apart by position, not by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import as_bytes, fresh, keep

#: Bytes that are no part of a word become blanks, A-Z lower case; bytes of non-ASCII characters belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers; number 0 is any word that no item has.

    Built and read in time linear in the words, whatever their repeats: each state knows the state of
    its last window and the next one with a whole item, and items stand on window states only.
    """

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        coded = [(number[n], [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for n, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: state -> length and item of the whole items under the window that are its longest sequences
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for item, codes in coded:
            if len(codes) < window:
                s = 0
                for c in codes:
                    s = self.next[s][c]
                if (len(codes), item) not in self.whole.setdefault(s, []):
                    self.whole[s].append((len(codes), item))
        # of each state: the one on its way to the root that holds its last window (0: none), and the next one with a whole item
        size = len(self.length)
        self.at_window, self.at_whole = [0] * size, [0] * size
        for s in sorted(range(1, size), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.at_whole[s] = s if s in self.whole else self.at_whole[up]
        #: the items of each window state
        self.items: dict[int, set[int]] = {}
        for item, codes in coded:
            s = 0
            for c in codes:
                s = self.next[s][c]
                if self.at_window[s]:
                    self.items.setdefault(self.at_window[s], set()).add(item)
        self.least = min([window, *(n for x in self.whole.values() for n, _ in x)], default=window)
        v = len(self.vocabulary) + 1
        self.base = v
        self.pairs = np.unique(np.array([a * v + b for _, codes in coded for a, b in zip(codes, codes[1:])], dtype=np.int64))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            k = len(length) - 1
            link[q] = k
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = k
                p = link[p]
            return k

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else clone(last, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(length) - 1, last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            k = q if length[q] == length[p] + 1 else clone(p, q)
            link[new] = k
        return new

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are hit (None: none), and the items whose windows occur."""
        n, found = len(words), set()
        if n < self.least:
            return None, found
        codes = np.fromiter(map(self.vocabulary.get, words, [0] * n), np.int64, n)
        if not codes.any():
            return None, found
        # runs of words in which each neighbouring pair is a pair of some item
        key = codes[:-1] * self.base + codes[1:]
        if len(self.pairs):
            at = np.searchsorted(self.pairs, key)
            joined = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
        else:
            joined = np.zeros(max(0, n - 1), bool)
        edge = np.flatnonzero(~joined) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
        long = (ends - starts >= self.least) & (codes[starts] > 0)
        if not long.any():
            return None, found
        change = np.zeros(n + 1, np.int64)
        window, nxt, link, length, whole = self.window, self.next, self.link, self.length, self.whole
        at_window, at_whole = self.at_window, self.at_whole
        windows: set[int] = set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            s = size = 0
            for i, c in enumerate(codes[start:end].tolist(), start):
                while s and c not in nxt[s]:
                    s = link[s]
                    size = length[s]
                s = nxt[s].get(c, 0)
                size = size + 1 if s else 0
                if size >= window:
                    windows.add(at_window[s])
                    change[i - window + 1] += 1
                    change[i + 1] -= 1
                up = at_whole[s]
                while up:  # under ``window`` steps, as the whole items on the way differ in length
                    for k, item in whole[up]:
                        if k <= size:
                            found.add(item)
                            change[i - k + 1] += 1
                            change[i + 1] -= 1
                    up = at_whole[link[up]]
        for s in windows:
            found |= self.items[s]
        hit = np.cumsum(change[:-1]) > 0
        return (hit if hit.any() else None), found


def chunks(benchmark: DataFrame, window: int, chunk_words: int) -> Iterator[Automaton]:
    """Automata over the items, read item by item through a local iterator and never held together."""
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.where("text is not null and item_id is not null").selectExpr("cast(item_id as string) as item_id", "cast(text as binary) as text").orderBy("item_id", "text").toLocalIterator():
        words = words_of(bytes(r["text"]))
        if words:
            if part and size + len(words) > chunk_words and part[-1][0] != r["item_id"]:
                yield Automaton(part, window)
                part, size = [], 0
            part.append((r["item_id"], words))
            size += len(words)
    if part:
        yield Automaton(part, window)


def _intervals(hit: np.ndarray | None) -> list[int]:
    """Start and end (exclusive) of each run, one after the other."""
    return [] if hit is None else np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


Names = tuple[str, str, str]  # of the columns for the number of words, the runs of hit words, the items


def _scanned(docs: DataFrame, sent, own: Names, known: bool) -> DataFrame:
    """``docs`` with the columns ``own``; known: those of an earlier pass are there and are added to."""
    types = (LongType(), ArrayType(LongType()), ArrayType(StringType()))
    schema = docs.schema if known else StructType([*docs.schema.fields, *map(StructField, own, types)])
    width = len(docs.columns) - 3 * known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for b in batches:
            count, hits, items = [], [], []
            before = zip(b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist()) if known else None
            for t in as_bytes(b.column("text")):
                words = words_of(t or b"")
                hit, found = a.scan(words) if a else (None, set())
                names = {a.names[i] for i in found}
                if known:
                    runs, more = next(before)
                    names |= set(more)
                    if runs:
                        hit = np.zeros(len(words), bool) if hit is None else hit
                        for x, y in zip(runs[::2], runs[1::2]):
                            hit[x:y] = True
                count.append(len(words))
                hits.append(_intervals(hit))
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, chunk_words: int) -> tuple[DataFrame, Names, list]:
    """All passes, the names of the columns that they add, and the automata as they were sent; where there are more than one, each result is written to the shared folder."""
    own, sent = tuple(fresh(docs, "_n", "_hits", "_items")), []
    for automaton in chunks(benchmark, window, chunk_words):
        sent.append(docs.sparkSession.sparkContext.broadcast(automaton))
        docs = _scanned(keep(docs, "decontaminate") if len(sent) > 1 else docs, sent[-1], own, len(sent) > 1)
    return docs if sent else _scanned(docs, docs.sparkSession.sparkContext.broadcast(None), own, False), own, sent


def _hit_words(hits: str) -> Column:
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda x, y: x + y)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, chunk_words: int = 200_000) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs`` (doc_id, text).

    contaminated: some word is hit, and the hit words are a twentieth of all or more.
    """
    seen, (n, hits, items), _ = scanned(docs.select("doc_id", "text"), benchmark, window, chunk_words)
    return seen.select(
        "doc_id", F.col(n).alias("n_words"), _hit_words(hits).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, drop_from: float = 0.5, chunk_words: int = 200_000) -> DataFrame:
    """``docs`` without benchmark passages; all columns stay, whatever their names, and only text changes.

    A document with a share ``drop_from`` of its words hit, or more, is dropped. Of others the
    hit runs are cut out, and again where what is left around a cut makes a window, so
    that no window is left. Null texts stay null.
    """
    seen, (n, hits, items), sent = scanned(docs, benchmark, window, chunk_words)
    (cut,) = fresh(seen, "_cut")
    stays = (_hit_words(hits) == 0) | (_hit_words(hits) < F.lit(drop_from) * F.col(n))
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = sent[0].value if len(sent) == 1 else None

        def rest(text: bytes, runs: list[int]) -> bytes:
            while runs:
                text = _cut(text, runs)
                runs = _intervals(alone.scan(words_of(text))[0]) if alone else []
            return text

        for b in batches:
            found = b.column(hits).to_pylist()
            texts = [rest(t, runs) if runs else t for t, runs in zip(as_bytes(b.column("text")), found)]
            columns = b.columns[: len(schema)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in found], pa.bool_())], names=[*schema.names, cut])

    out = seen.where(stays).mapInArrow(run, StructType([*schema.fields, StructField(cut, BooleanType())]))
    if len(sent) < 2:
        return out.drop(cut)
    # several automata: the few texts that were cut go through all passes again, until none is
    out = keep(out, "decontaminate-cut")
    more = out.where(F.col(cut)).drop(cut)
    done = out.where(~F.col(cut)).drop(cut)
    return done.unionAll(remove_spans(more, benchmark, window=window, drop_from=1.1, chunk_words=chunk_words)) if more.limit(1).count() else done


def _cut(raw: bytes, runs: list[int]) -> bytes:
    """The text without its hit runs of words; blanks and marks between the others stay."""
    spans, at = [], 0
    plain = raw.translate(_WORDS)
    for w in words_of(raw):
        at = plain.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for x, y in zip(runs[::2], runs[1::2]):
        out.append(raw[last : spans[x][0]])
        last = spans[y - 1][1]
    return b"".join([*out, raw[last:]])
