"""Brown class-based bigram model by exchange clustering.

1. Words are counted over all training texts, and each text is written once as the
   numbers of its tokens: a word of the lookup table has its own, any other that of a
   bucket by its form (length, last letters, character kinds). What follows reads these numbers.
2. Core. The most frequent words, and all others by the bucket of their form, are clustered
   on the driver: each is moved to the class that most raises the likelihood of the class
   bigrams, again and again, over counts gathered from the whole corpus.
3. Sweeps. Then every word of the table that is not in the core, and every bucket, is moved too: Spark
   counts the classes before and after it in all texts, and tasks that hold a part of the
   vocabulary put each of its words where the likelihood is greatest, by the table of
   class bigrams without the word itself.

A text's probability is the product of class transitions, smoothed by the class
unigram, and of emissions from the class, smoothed by one within a bucket:

    P(w | v) = P(class w | class v) * P(unit w | class w) * P(w | unit w)

where the unit of a word in the table is the word itself, and of another word its bucket.

Bounds: ``lookup`` words at most are sent to the tasks with their counts and come back with their
classes, and a table of ``core`` + ``buckets`` squared cells at most is clustered on the driver; neither
grows with the corpus, while the counts behind them do. The counts of words past the
lookup table reach their texts by an equi-join on the word.

Defined results: a null text is an empty one and has only its end token. Repeated
rows are scored each; they are told apart by position. A null doc_id is not held out. Without
training texts N and V are 0, and every token has probability 1 by the base formula.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, keep

#: The end token and the state before a text; no word holds a blank, so this is none.
END = b" "


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words, without the end token."""
    return raw.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def bucket_of(word: bytes, buckets: int) -> int:
    """The bucket of a word by its form: kinds of characters, length and last three bytes."""
    if word.isalpha() or max(word) >= 128:
        form = word[-3:] + bytes([min(len(word), 12) // 4, max(word) >= 128])
    else:
        form = b"#" + bytes([any(48 <= c <= 57 for c in word), word[-1]])
    return xxhash.xxh32_intdigest(form) % buckets


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all words of ``docs`` (text); ends are not counted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in as_bytes(b.column("text")):
                seen.update(words_of(t or b""))
                if len(seen) > 400_000:  # bounded memory; the parts are added up
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Words by number, most frequent first; past them the buckets of all other words, and last END."""

    table: dict[bytes, int]
    c: np.ndarray  # training tokens of each word of the table
    bucket_tokens: np.ndarray
    bucket_types: np.ndarray
    tokens: int
    types: int
    ends: int

    @property
    def buckets(self) -> int:
        return len(self.bucket_tokens)

    @property
    def end(self) -> int:
        return len(self.table) + self.buckets


def vocabulary(train: DataFrame, *, lookup: int = 65_000, buckets: int = 256) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the kept table of all word counts."""
    if lookup + buckets >= 1 << 16:
        raise ValueError("numbers of tokens are held in two bytes")
    counts = keep(word_counts(train), "word-counts")
    ends = train.count()
    sums = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(lookup).collect()  # lookup rows at most
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    sent = train.sparkSession.sparkContext.broadcast(known)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            ws, cs = as_bytes(b.column("word")), b.column("c").to_numpy()
            rest = [i for i, w in enumerate(ws) if w not in sent.value]
            at = np.array([bucket_of(ws[i], buckets) for i in rest], np.int64)
            n += np.bincount(at, cs[rest], buckets).astype(np.int64)
            v += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], names=["bucket", "n", "v"])

    bn, bv = np.zeros(buckets), np.zeros(buckets)
    for r in counts.mapInArrow(totals, "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # buckets rows
        bn[r["bucket"]], bv[r["bucket"]] = r["n"], r["v"]
    c = np.array([r["c"] for r in top], dtype=float)
    return Vocabulary(known, c, bn, bv, int((sums["n"] or 0) + ends), int(sums["v"] + (ends > 0)), int(ends)), counts


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, codes (numbers of the tokens, two bytes each, without the end), rare and times (the distinct words past the table, and how often), and row, as a kept table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((words.table, words.buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, buckets = sent.value
        first = len(table)
        memo: dict[bytes, int] = {}
        types = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for b in batches:
            cols: list[list] = [[], [], []]
            for t in as_bytes(b.column("text")):
                w = words_of(t or b"")
                codes = np.fromiter(map(table.get, w, repeat(-1)), np.int32, len(w))
                past = np.flatnonzero(codes < 0).tolist()
                rare = Counter([w[i] for i in past])
                if len(memo) > 200_000:
                    memo.clear()
                for x in rare:
                    if x not in memo:
                        memo[x] = first + bucket_of(x, buckets)
                codes[past] = [memo[w[i]] for i in past]
                for col, x in zip(cols, (codes.astype(np.uint16).tobytes(), list(rare), list(rare.values()))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "codes", "rare", "times"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, codes binary, rare array<binary>, times array<long>")
    return keep(out.withColumn("row", F.monotonically_increasing_id()), "brown-codes")


def _sequences(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Numbers of many texts in one array, END before the first text, between them and after the last."""
    for b in batches:
        column = b.column("codes")
        for at in range(0, len(column), 2000):
            parts = [np.array([end], np.uint16)]
            for raw in column.slice(at, 2000).to_pylist():
                parts += [np.frombuffer(raw, np.uint16), parts[0]]
            yield np.concatenate(parts)


def pair_counts(codes: DataFrame, end: int, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of the pairs of neighbours by their groups ``of``: size squared cells."""
    sent = codes.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * size, np.int64)
        for s in _sequences(batches, end):
            g = sent.value[s]
            np.add.at(sums, g[:-1] * size + g[1:], 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["pair", "n"])

    out = np.zeros(size * size, np.int64)
    got = codes.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size squared rows at most
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def by_class(pairs: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of class pairs."""
    out = np.zeros((size, size))
    a, b = np.nonzero(pairs)
    np.add.at(out, (of[a], of[b]), pairs[a, b])
    return out


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each unit but the last, which is END and keeps class ``classes`` to itself.

    The likelihood of the class bigrams is sum h(N(c, d)) - sum h(N(c, .)) - sum h(N(., d)), h(x) = x log x.
    Each unit in turn, by frequency, is taken out and put where that is greatest.
    """
    n = len(pairs)
    freq = pairs.sum(1)
    order = np.argsort(-freq[: n - 1], kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n - 1) % classes
    of[n - 1] = classes
    size = classes + 1
    rows = [np.flatnonzero(pairs[u]) for u in range(n)]
    cols_of = pairs.T.copy()
    cols = [np.flatnonzero(cols_of[u]) for u in range(n)]
    table = by_class(pairs, of, size)
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            if not freq[u]:
                continue
            c = of[u]
            r, k = rows[u][rows[u] != u], cols[u][cols[u] != u]
            out = np.bincount(of[r], pairs[u, r], size)
            into = np.bincount(of[k], cols_of[u, k], size)
            own = float(pairs[u, u])
            table[c] -= out
            table[:, c] -= into
            table[c, c] -= own
            left, top = table.sum(1) + into, table.sum(0) + out  # what goes to and comes from the unit counts wherever it is put
            gain = (_h(table + out) - _h(table)).sum(1) + (_h(table + into[:, None]) - _h(table)).sum(0)
            d = np.arange(size)
            diag = table[d, d]
            gain += _h(diag + out + into + own) - _h(diag + out) - _h(diag + into) + _h(diag)
            gain -= _h(left + out.sum() + own) - _h(left) + _h(top + into.sum() + own) - _h(top)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            moved += best != c
            of[u] = best
        if not moved:
            break
    return of

def swept(codes: DataFrame, end: int, of: np.ndarray, classes: int, core: int, parts: int) -> np.ndarray:
    """The classes ``of`` after each number from ``core`` on was put where the likelihood of the class bigrams is greatest.

    All are judged by the classes before the sweep, each without its own counts. The tasks
    add the counts of their texts before the shuffle, by number and neighbour's class; a task of the second
    stage holds these for its part of the numbers.
    """
    size = classes + 1
    table = pair_counts(codes, end, of, size)
    sent = codes.sparkSession.sparkContext.broadcast((of, table.astype(float)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys // (2 * size), pa.int32()), pa.array(keys % (2 * size), pa.int32()), pa.array(n, pa.int32())], names=["code", "side", "n"])

        for s in _sequences(batches, end):
            g, s = sent.value[0][s], s.astype(np.int64)
            here = (s[1:] >= core) & (s[1:] < end)
            held.append(s[1:][here] * (2 * size) + g[:-1][here])
            here = (s[:-1] >= core) & (s[:-1] < end)
            held.append(s[:-1][here] * (2 * size) + size + g[1:][here])
            weight += len(held[-1]) * 2
            if weight > 4_000_000:
                yield flush()
                held.clear()
                weight = 0
        yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_before, pairs = sent.value
        found: dict[int, int] = {}
        counts = np.zeros((0, 2 * size))
        for b in batches:
            code, side, n = (b.column(c).to_numpy() for c in ("code", "side", "n"))
            for c in np.unique(code).tolist():
                found.setdefault(c, len(found))
            if len(found) > len(counts):
                counts = np.concatenate([counts, np.zeros((max(len(found), 2 * len(counts)) - len(counts), 2 * size))])
            np.add.at(counts, (np.array([found[c] for c in code.tolist()], np.int64), side), n)
        numbers = np.array(list(found), np.int64)
        for at in range(0, len(numbers), 1024):
            part = numbers[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(best_class(counts[at : at + len(part)], classes_before[part], pairs), pa.int32())], names=["code", "class"])

    dealt = codes.select("codes").mapInArrow(count, "code int, side int, n int").repartition(parts, "code")
    got = dealt.mapInArrow(choose, "code int, class int").toArrow()  # a row for each number
    out = of.copy()
    out[got.column("code").to_numpy()] = got.column("class").to_numpy()
    return out


def best_class(counts: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For words with ``counts`` (of each class before, then of each class after) and the class ``own`` the class that the class bigrams ``pairs`` make most likely, own counts left out. END's class, the last, takes no words."""
    size = len(pairs)
    before, after = counts[:, :size], counts[:, size:]
    to, frm, total = pairs.sum(0), pairs.sum(1), counts[:, size:].sum(1)
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    fit = before @ (log(pairs) - log(to)[None, :]) + after @ (log(pairs) - log(frm)[:, None]).T
    rows = np.arange(len(own))
    less_to, less_from = to[own] - before.sum(1), frm[own] - total
    fit[rows, own] = (before * (log(pairs[:, own].T - before) - log(less_to)[:, None])).sum(1) + (after * (log(pairs[own] - after) - log(less_from)[:, None])).sum(1)
    return np.argmax(fit[:, : size - 1], axis=1)


@dataclass
class Model:
    words: Vocabulary
    of: np.ndarray  # class of each number
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(number | class)
    plus: np.ndarray  # log10 (c + 1) of the words of the table
    bucket_rest: np.ndarray  # - log10 of a bucket's smoothed total

    @property
    def tokens(self) -> int:
        return self.words.tokens

    @property
    def types(self) -> int:
        return self.words.types


def clustered(codes: DataFrame, words: Vocabulary, *, core: int = 1_024, classes: int = 128, rounds: int = 3, sweeps: int = 1, smooth: float = 4.0) -> Model:
    """The model of the training texts ``codes`` (as of ``coded``)."""
    end, buckets = words.end, words.buckets
    names, known = list(words.table), len(words.table)
    core = min(core, known)
    group = np.array([i if i < core else core + bucket_of(w, buckets) for i, w in enumerate(names)] + [core + b for b in range(buckets)] + [core + buckets], np.int64)
    pairs = pair_counts(codes, end, group, core + buckets + 1)
    of = exchange(pairs, classes, rounds)[group]
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(sweeps):
        of = swept(codes, end, of, classes, core, parts)
    by = pair_counts(codes, end, of, classes + 1).astype(float)
    into = by.sum(0) + 0.5
    step = np.log10((by + smooth * into / into.sum()) / (by.sum(1, keepdims=True) + smooth))
    freq = np.concatenate([words.c, words.bucket_tokens, [words.ends]]) + 0.5
    emit = np.log10(freq / np.bincount(of, freq, classes + 1)[of])
    return Model(words, of, step, emit, np.log10(words.c + 1), -np.log10(words.bucket_tokens + words.bucket_types + 1))


def fit(train: DataFrame, *, lookup: int = 65_000, buckets: int = 256, **how) -> tuple[Model, DataFrame]:
    """The model of ``train`` (doc_id, text), and the kept table of all word counts."""
    words, counts = vocabulary(train, lookup=lookup, buckets=buckets)
    return clustered(coded(train, words), words, **how), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both log10 of the text's probability) of each row of ``docs`` (doc_id, text)."""
    return score_coded(coded(docs, model.words), model, counts)


def score_coded(codes: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The same of texts as numbers (as of ``coded``).

    Words past the lookup table meet their counts by a join on the word and come back as one sum for each row.
    """
    kind = codes.schema["doc_id"].dataType.simpleString()
    small = Model(Vocabulary({}, model.words.c, model.words.bucket_tokens, model.words.bucket_types, model.tokens, model.types, model.words.ends), model.of, model.step, model.emit, model.plus, model.bucket_rest)
    sent = codes.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        known, end = len(m.plus), len(m.of) - 1
        norm, end_plus = math.log10(m.tokens + m.types + 1), math.log10(m.words.ends + 1)
        base = np.concatenate([m.plus, np.zeros(len(m.bucket_rest))])
        own = m.emit + np.concatenate([np.zeros(known), m.bucket_rest, [0.0]])
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for raw in b.column("codes").to_pylist():
                s = np.frombuffer(raw, np.uint16)
                n = len(s)
                g = m.of[np.concatenate([[end], s, [end]])]
                total = m.step[g[:-1], g[1:]].sum() + own[s].sum() + own[end]
                for col, x in zip(cols, (n + 1, int((s < known).sum()) + (m.words.ends > 0), float(base[s].sum() + end_plus - (n + 1) * norm), float(total))):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score"])

    main = codes.select("doc_id", "row", "codes").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, n_known long, base_score double, score double")
    if model.types <= len(model.plus) + 1:
        return main.drop("row")
    rare = codes.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("plus"))
    plus = F.coalesce("plus", F.lit(0.0))
    return main.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base_score") + plus).alias("base_score"), (F.col("score") + plus).alias("score"),
    )
