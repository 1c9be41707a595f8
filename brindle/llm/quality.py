"""Regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed statistics (lengths, character
classes, repetition). Class means and covariances come from sums over the labelled
rows; each covariance is shrunk towards the pooled one and then towards its
diagonal, and its Cholesky factor is computed once. The score is the posterior of
label 1, from the difference of the Mahalanobis log densities. Statistics of a few words
say little: the difference counts by words / (words + ``doubt``), so very short texts
lean on the share of the classes.

Defined results: a null text is an empty one; an empty text has all-zero counts and a
score like any other. Repeated rows are scored each. Labels that are null, contradict each other for one document,
or name unknown documents are left out. If a class has under two rows, the score is
the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes

FEATURES = ("words", "word_length", "upper", "digits", "marks", "blanks", "other", "pipes", "bangs", "distinct", "lines", "line_repeats", "word_repeats", "top_byte", "entropy", "letters")

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 0 if _b >= 128 else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t\n\r\x0b\x0c" else 4 if _c in ".,;:'()-" else 5 if _c == "|" else 6 if _c == "!" else 7 if not _c.isalnum() else 0] = 1


def features(raw: bytes) -> np.ndarray:
    """The transformed statistics of one text, all of them bounded or logarithmic."""
    out = np.zeros(len(FEATURES))
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits, blanks, marks, pipes, bangs, other = counts @ _CLASS
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    p = counts[counts > 0] / n
    log_odds = lambda x, of: np.log((x + 0.5) / (of - x + 0.5))
    repeats = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    out[:] = (
        np.log1p(len(words)), np.log1p(n / w), log_odds(upper, n), log_odds(digits, n), log_odds(marks, n), log_odds(blanks, n), log_odds(other, n), log_odds(pipes, n), log_odds(bangs, n),
        np.log(len(set(words)) + 1.0) - 0.75 * np.log(w + 1.0), np.log1p(len(lines)), log_odds(len(lines) - len(set(lines)), max(1, len(lines))), log_odds(repeats, w), np.log(p.max()), float(-(p * np.log(p)).sum()), log_odds(letters, n),
    )
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, np.stack([features(x or b"") for x in as_bytes(b.column("text"))])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of each class in this partition: two rows at most."""
    d = len(FEATURES)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for b, x in _vectors(batches):
        y = np.array(b.column("y").to_pylist())
        for c in (0, 1):
            z = x[y == c]
            sums[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    rows = [(c, s.tolist()) for c, s in sums.items() if s[0]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "s"])


class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float, ridge: float, doubt: float = 10.0):
        self.doubt = doubt
        d = len(FEATURES)
        n = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
        self.prior = (n[1] / sum(n)) if sum(n) else 0.5
        self.ok = min(n) >= 2
        if not self.ok:
            return
        self.means, cov = [], []
        for c in (0, 1):
            mean = sums[c][1 : 1 + d] / n[c]
            self.means.append(mean)
            cov.append(sums[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean, mean))
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
        self.factors, self.log_dets = [], []
        for c in (0, 1):
            a = shrink + (1 - shrink) * d / (d + n[c])  # a small class leans on the pooled covariance
            s = (1 - a) * cov[c] + a * pooled
            s = (1 - ridge) * s + ridge * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(chol))
            self.log_dets.append(2 * np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), self.prior)
        density = [-0.5 * ((((x - m) @ f.T) ** 2).sum(1) + ld) for m, f, ld in zip(self.means, self.factors, self.log_dets)]
        words = np.expm1(x[:, 0])
        odds = np.clip((density[1] - density[0]) * words / (words + self.doubt) + np.log(self.prior / (1 - self.prior)), -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, shrink: float = 0.1, ridge: float = 0.05, doubt: float = 10.0) -> Discriminant:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, y).

    max_rows: the bound of the sample of labelled documents that it learns from,
    taken by a hash of doc_id; being bounded, the sample may be broadcast.
    """
    clean = labels.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    sample = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.col("y").cast("int").alias("y"))
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    sums: dict[int, np.ndarray] = {}
    size = 1 + len(FEATURES) * (1 + len(FEATURES))
    for r in seen.mapInArrow(_moments, "y int, s array<double>").select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 x size numbers
        sums.setdefault(r["y"], np.zeros(size))[r["i"]] = r["v"]
    return Discriminant(sums, shrink, ridge, doubt)


def score(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, which replaces one of that name; all other columns stay."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t or b"") for t in as_bytes(b.column("text"))]) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of doc_id as text leaves no remainder by five. A null doc_id has none, and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
