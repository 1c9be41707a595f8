"""I-Match fingerprints with randomised lexicons.

Document frequencies are counted over all texts. The lexicon is the terms whose
inverse document frequency lies in a band: between ``rare`` and ``common`` as shares
of the documents. A text's distinct lexicon terms are sorted and hashed once for each
of several random subsets of the lexicon, which keep a quarter, a sixteenth, ... of it; the
fingerprint is those hashes in a row, and its likeness to another is the share of
equal ones among the subsets of one rate in which either text has terms, at the rate
where the two agree most.

The lexicon's size is bounded whatever the corpus: a term needs ``rare`` x N documents,
and the documents have N x (mean distinct terms) terms to give, so it has at most
(mean distinct terms) / rare. That bound is measured, checked against
``max_lexicon`` and the band narrowed from below until it holds, so what is sent to
the tasks is bounded.

Defined results: doc_id is a whole number, as the next document goes by it; others raise. A null text is an empty text. Texts without lexicon terms get a hash of
the whole text in place of the subsets, so equal texts have equal fingerprints, and
texts of that kind are alike only if equal. The next document goes by descending
doc_id, ties by a hash of the text; after the last comes the first; a single document is its own
next. Rows with a null doc_id come last.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import as_bytes, keep

#: Subsets for each rate; the subset j of a rate keeps a term if its hash says so.
RATES = (4, 16, 64, 128, 256, 512)
EACH = 5
WIDTH = 8
SEED = 7
_SUBSETS = np.arange(len(RATES) * EACH, dtype=np.uint32)


def terms_of(raw: bytes) -> set[bytes]:
    return set(raw.lower().split())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

    seen: Counter[bytes] = Counter()
    for b in batches:
        for t in as_bytes(b.column("text")):
            seen.update(terms_of(t or b""))
            if len(seen) > 400_000:  # bounded memory; Spark adds the parts up
                yield flush()
                seen.clear()
    yield flush()


class Lexicon:
    """Terms of the band, and for each the subsets that keep it, as bits."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: i for i, t in enumerate(sorted(terms))}
        self.hash = np.array([xxhash.xxh64_intdigest(t, SEED) for t in sorted(terms)], dtype=np.uint64)
        bits = np.zeros(len(terms), np.uint32)
        for i, rate in enumerate(RATES):
            for j in range(EACH):
                own = np.array([xxhash.xxh64_intdigest(t, SEED + 1 + i * EACH + j) for t in sorted(terms)], dtype=np.uint64)
                bits |= ((own % np.uint64(rate)) == 0).astype(np.uint32) << np.uint32(i * EACH + j)
        self.bits = bits

    def fingerprint(self, raw: bytes) -> tuple[str, int]:
        """The hashes as text, and the subsets in which the text has terms."""
        get = self.number.get
        at = [i for i in map(get, terms_of(raw)) if i is not None]
        if not at:
            return hashlib.sha256(raw).hexdigest(), 0
        idx = np.sort(np.array(at))
        subset, term = np.nonzero((self.bits[idx] >> _SUBSETS[:, None]) & np.uint32(1))
        hashes = self.hash[idx][term].tobytes()  # term hashes in term order, subset after subset
        ends = np.cumsum(np.bincount(subset, minlength=len(_SUBSETS))).tolist()
        out, have, start = [], 0, 0
        for j, end in enumerate(ends):
            if end > start:
                have |= 1 << j
                out.append("%08x" % xxhash.xxh32_intdigest(hashes[8 * start : 8 * end], SEED))
            else:
                out.append("0" * WIDTH)
            start = end
        return "".join(out), have


def likeness(a: tuple[str, int], b: tuple[str, int]) -> float:
    """Share of equal hashes among the subsets of a rate in which either text has terms, at the rate where it is greatest.

    Rates with under two such subsets only count if no rate has more.
    """
    if not a[1] or not b[1]:
        return float(a[0] == b[0])
    shares: dict[bool, float] = {}
    for i in range(len(RATES)):
        at = [j for j in range(i * EACH, i * EACH + EACH) if (a[1] | b[1]) >> j & 1]
        if at:
            same = sum(a[0][WIDTH * j : WIDTH * j + WIDTH] == b[0][WIDTH * j : WIDTH * j + WIDTH] for j in at) / len(at)
            shares[len(at) > 1] = max(same, shares.get(len(at) > 1, 0.0))
    return shares.get(True, shares.get(False, 0.0))


def lexicon(docs: DataFrame, *, rare: float = 0.001, common: float = 0.1, max_lexicon: int = 400_000) -> Lexicon:
    """From the document frequencies of all texts. The band's lower end moves up where the size bound calls for it."""
    df = docs.select("text").mapInArrow(_counts, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    n = docs.count()
    band = keep(df.where((F.col("df") >= max(2, rare * n)) & (F.col("df") <= max(2, common * n))), "lexicon")
    least = band.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df"))
    size, bound = 0, 0
    for r in least.toLocalIterator():  # one row for each frequency
        if size + r["n"] > max_lexicon:
            bound = r["df"] + 1
            break
        size += r["n"]
    return Lexicon([bytes(r["term"]) for r in band.where(F.col("df") >= bound).select("term").collect()])  # at most max_lexicon


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Values of doc_id that cut the rows into about equal ranges; as many as partitions, so few."""
    found = docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(x) for x in found})


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _slots(docs: DataFrame, parts: int) -> list[int]:
    """For each partition a number that Spark's hash partitioning deals to it, so that ranges do not share partitions."""
    found: dict[int, int] = {}
    for r in docs.sparkSession.range(40 * parts + 200).select("id", F.expr(f"pmod(hash(id), {parts})").alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():  # parts rows
        found[r["p"]] = r["id"]
    return [found.get(p, p) for p in range(parts)]


def with_next(docs: DataFrame, parts: int, prepare, job, schema: str) -> DataFrame:
    """``job(held, following)`` for each row in descending doc_id, both (doc_id, text, prepare(text)), in one shuffle of the compressed texts.

    The rows are dealt into ranges of doc_id and sorted within each. The first row
    of each range is also sent to the range before it, where it only serves as next
    text; the first of all is sent to the last range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _bounds(rows, parts)
    least = F.lit(-(1 << 63))
    # range r holds doc_id from cuts[r - 1] up to below cuts[r]; nulls stand below all
    area = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.coalesce("doc_id", least)))
    rows = rows.withColumn("area", area)
    # of each range the row that comes first: largest doc_id; few rows
    first = rows.groupBy("area").agg(F.max(F.coalesce("doc_id", least)).alias("top"))
    tops = sorted((r["area"], r["top"]) for r in first.collect())  # one row for each range
    if not tops:
        return rows.sparkSession.createDataFrame([], schema)
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}  # its text serves the range above
    head = rows.where(F.coalesce("doc_id", least).isin(*to)).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    goal = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])[F.coalesce("doc_id", least)]
    tails = head.select("doc_id", "text", goal.alias("area"), F.lit(1).alias("tail"))
    slots = F.array(*[F.lit(s).cast("long") for s in _slots(docs, parts)])
    dealt = _packed(rows.withColumn("tail", F.lit(0)).unionByName(tails).withColumn("mark", F.xxhash64("text"))).withColumn("slot", F.get(slots, F.col("area") % parts))
    dealt = dealt.repartition(parts, "slot").sortWithinPartitions("area", "tail", F.desc_nulls_last("doc_id"), "mark").select("doc_id", "area", "tail", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, inside = None, None
        out: list[tuple] = []
        for b in batches:
            for d, a, tail, z in zip(*(b.column(n).to_pylist() for n in ("doc_id", "area", "tail", "packed"))):
                text = unpack(z).decode()
                now = (d, text, prepare(text))
                if held is not None and inside == a:
                    out.append(job(held, now))
                held, inside = (None if tail else now), a
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "area", "tail", "mark")), pa.array([pack(t) for t in as_bytes(b.column("text"))], pa.binary())], names=["doc_id", "area", "tail", "mark", "packed"])

    return rows.select("doc_id", "area", "tail", "mark", "text").mapInArrow(run, "doc_id long, area int, tail int, mark long, packed binary")


def fingerprints(docs: DataFrame, *, rare: float = 0.001, common: float = 0.1, parts: int | None = None) -> DataFrame:
    """The row of each document: its fingerprint, that of its edited text, and likenesses."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, rare=rare, common=common))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prepare(text):
        return sent.value.fingerprint(text.encode())

    def job(own, following):
        new = edited(own[1], following[1]).encode()
        other = sent.value.fingerprint(new)
        return own[0], len(own[1]), hashlib.sha256(new).hexdigest(), own[2][0], other[0], likeness(own[2], other), likeness(own[2], following[2])

    return with_next(docs, parts, prepare, job, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
