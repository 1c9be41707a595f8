"""Personal data: base patterns, and contextual extraction bootstrapped from them.

The base patterns find e-mail addresses, IP addresses, card and telephone numbers.
They are the seeds, and so are secrets: long tokens that mix letters and digits, which are spans
only where a pattern extracts them. The signs and words around seeds make lexical patterns (the last one,
two or three before; the one before and the one after; the one before and the form of the token). Every token
with a digit or an at sign is an instance that patterns may extract. Over the graph of
patterns and instances Spark iterates: a pattern's confidence is the mean confidence of
the distinct instances that it extracts, an instance's the best of its patterns; seeds
stay at 1, and instances that are seeds of something else at 0. What
confident patterns extract beyond the base spans is added under the pattern's kind.

The graph is held as counts by pattern and by token, never by occurrence, and
both are found by aggregation and equi-joins; nothing of it comes to the driver.

Defined results: null and empty texts have no spans. A span added never overlaps a base
span. Repeated rows are searched each. Offsets are code points, ends exclusive. An instance
has five characters or more. A word of a context that reaches past ``REACH`` characters counts as one sign, whatever it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, named, scratch

# fixed values: the kinds in order, and the base patterns
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Instances: runs without blanks, quotes, brackets, bars, commas and semicolons that hold a digit or an at sign.
_MARK, _RUN, _STOP = re.compile(r"[0-9@]"), re.compile(r"[^\s\"'<>()\[\]{}|,;]+"), frozenset("\"'<>()[]{}|,;")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping: each tail from an at sign takes the run of local characters before it that no earlier match holds."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            out.append(("email", start, end := tail.end()))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind in order, then by start."""
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def written(spans: list[Span]) -> str:
    """By kind as listed, then by start; secrets last."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: ((*KINDS, SECRET).index(s[0]), s[1], s[2])))


def form(token: str) -> str:
    """Digits as 9, letters as a, runs of equal ones as one."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))


def is_secret(token: str) -> bool:
    """A seed of a secret: 24 letters, digits, dashes or low lines, or more, with four letters and four digits at least."""
    if len(token) < 24 or not _SECRET.fullmatch(token):
        return False
    digits = sum(c in "0123456789" for c in token)
    return digits >= 4 and sum(c.isalpha() for c in token) >= 4


#: Characters before or after a token that its context is taken from.
REACH = 48
_SECRET, _SIGNS = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\w+|[^\w\s]")


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the sign before and after; the last one with the token's form; the last two, and three, before."""
    at = max(0, start - REACH)
    before = _SIGNS.findall(text[at:start].lower())
    if before and at and _in_word(text[at]) and _in_word(text[at - 1]):
        before[0] = "\u2026"  # the rest of a long word
    after = _SIGNS.search(text, end, min(len(text), end + REACH))
    then = "$" if after is None else "\u2026" if after.end() == end + REACH and after.end() < len(text) and _in_word(text[after.end()]) else after[0].lower()
    one, two, three = (["^", "^", "^", *before])[:-4:-1]
    return [f"w {one} _ {then}", f"f {one} {form(text[start:end])[:24]}", f"l {two} {one}", f"t {three} {two} {one}"]


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def instances(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Bounds of the tokens of five characters or more that no base span meets, without marks at their ends."""
    taken = sorted((x, y) for _, x, y in spans)
    out, i, end = [], 0, 0
    mark = _MARK.search(text)
    while mark:  # from a digit to both ends of its run, so no run is gone over twice
        x, before = mark.start(), end
        while x > before and not (text[x - 1].isspace() or text[x - 1] in _STOP):
            x -= 1
        end = _RUN.match(text, mark.start()).end()
        y = x + len(text[x:end].rstrip(".:!?*#$%&-"))
        mark = _MARK.search(text, end)
        while i < len(taken) and taken[i][1] <= x:
            i += 1
        if y - x >= 5 and not any(p < y and x < q for p, q in taken[i : i + 3]):
            out.append((x, y))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each row, and its instances: token, bounds, base kind or null, patterns."""
    inst = pa.struct([("token", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))])
    for b in batches:
        spans_out, found_out = [], []
        for t in b.column("text").to_pylist():
            spans = base_spans(t) if t else []
            found = [*spans, *((None, x, y) for x, y in (instances(t, spans) if t else ()))]
            spans_out.append([{"kind": k, "start": x, "stop": y} for k, x, y in spans])
            found_out.append([{"token": t[x:y].lower(), "start": x, "stop": y, "kind": k or (SECRET if is_secret(t[x:y]) else None), "patterns": contexts(t, x, y)} for k, x, y in found])
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans_out, pa.list_(span)), pa.array(found_out, pa.list_(inst))], names=["doc_id", "base", "found"])


def confident(found: DataFrame, *, rounds: int, least: float, support: int) -> DataFrame:
    """(pattern, kind): the patterns that end with a confidence of ``least`` or more from ``support`` distinct instances or more.

    found: (token, kind, patterns), one row for each occurrence.
    """
    edges = found.select("token", "kind", F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("pattern", "token", "kind").count()
    # patterns that extract no seed, or too few instances, never count
    useful = edges.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.countDistinct("token").alias("tokens")).where(f"seeds > 0 and tokens >= {support}").select("pattern")
    edges = keep(edges.join(useful, "pattern").select("pattern", "token", "kind"), "pii-edges")
    kinds = edges.where("kind is not null").select("kind", "pattern").distinct()
    tokens = edges.groupBy("token").agg(F.collect_set("kind").alias("is"))  # five kinds at most
    graph = edges.select("pattern", "token").distinct().join(kinds, "pattern").join(tokens, "token")
    graph = keep(graph.select("pattern", "kind", "token", F.when(F.array_contains("is", F.col("kind")), 1.0).when(F.size("is") > 0, 0.0).alias("fixed")), "pii-graph")
    score = graph.select("kind", "token", F.coalesce("fixed", F.lit(0.0)).alias("s")).distinct()
    patterns = None
    for i in range(rounds):
        patterns = graph.join(score, ["kind", "token"]).groupBy("pattern", "kind").agg(F.avg("s").alias("conf"), F.count(F.lit(1)).alias("n")).where(f"n >= {support}")
        if i < rounds - 1:
            best = graph.join(patterns, ["pattern", "kind"], "left").groupBy("kind", "token").agg(F.max("fixed").alias("fixed"), F.max("conf").alias("conf"))
            score = keep(best.select("kind", "token", F.coalesce("fixed", "conf", F.lit(0.0)).alias("s")), "pii-scores")
    return patterns.where(F.col("conf") >= least).groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))


_SPANS = "array<struct<kind: string, start: bigint, stop: bigint>>"
_INSTANCES = "array<struct<token: string, start: bigint, stop: bigint, kind: string, patterns: array<string>>>"


def _learned(docs: DataFrame, rounds: int, least: float, support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows (row, doc_id, base, found), their occurrences, and the confident patterns, all but the second kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = keep(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, base {_SPANS}, found {_INSTANCES}").withColumn("row", F.monotonically_increasing_id()), "pii")
    found = seen.select("row", F.explode("found").alias("x")).select("row", "x.*")
    return seen, found, keep(confident(found.select("token", "kind", "patterns"), rounds=rounds, least=least, support=support), "pii-patterns")


def spans(docs: DataFrame, *, rounds: int = 3, least: float = 0.8, support: int = 4) -> DataFrame:
    """``doc_id``, ``base`` and ``more`` (arrays of kind, start, stop) for each row of ``docs`` (doc_id, text), and row, its number."""
    seen, found, good = _learned(docs, rounds, least, support)
    new = found.where(f"kind is null or kind = '{SECRET}'").select("row", "start", "stop", F.explode(F.array_distinct("patterns")).alias("pattern")).join(good, "pattern")
    more = new.groupBy("row", "start", "stop").agg(F.min("kind").alias("kind")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("more"))
    return seen.select("row", "doc_id", "base").join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast(_SPANS)))


def found_table(docs: DataFrame, **how) -> DataFrame:
    """The digest of each row: numbers of base spans by kind, base_sha256, all spans, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for base, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist()):
                base, more = ([(s["kind"], s["start"], s["stop"]) for s in x] for x in (base, more))
                values = (*(sum(k == x for x, _, _ in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(base) + len(more))
                for col, v in zip(cols, values):
                    col.append(v)
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spans(docs, **how).select("doc_id", "base", "more").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, *, rounds: int = 3, least: float = 0.8, support: int = 4, sent_patterns: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, text and others) with each span of text replaced by its kind in brackets; overlapping spans become one.

    Up to ``sent_patterns`` confident patterns are sent to the tasks, which apply them in one pass over the
    texts; more than that are joined to the spans, and these to a numbered copy of the rows.
    """
    names, schema = docs.columns, docs.schema

    def texts_in(b: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, b.columns)], names=names)

    with scratch():
        _, _, good = _learned(docs, rounds, least, support)
        few = good.count() <= sent_patterns
        patterns = {r["pattern"]: r["kind"] for r in good.toLocalIterator()} if few else {}
    if few:
        sent = docs.sparkSession.sparkContext.broadcast(patterns)

        def one(t: str | None) -> str | None:
            if not t:
                return t
            spans = base_spans(t)
            if sent.value:
                for x, y in instances(t, spans):
                    kinds = [k for k in map(sent.value.get, contexts(t, x, y)) if k]
                    if kinds:
                        spans.append((min(kinds), x, y))
            return replaced(t, spans) if spans else t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                    yield texts_in(part, [one(t) for t in part.column("text").to_pylist()])

        return docs.mapInArrow(run, schema)

    row, at = fresh(docs, "_row", "_spans")
    held = keep(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    both = spans(held.select(F.col(row).alias("doc_id"), "text"), rounds=rounds, least=least, support=support)
    found = both.select(F.col("doc_id").alias(row), F.concat("base", "more").alias(at)).where(F.size(at) > 0)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                rows = zip(part.column("text").to_pylist(), part.column(at).to_pylist())
                yield texts_in(part, [replaced(t, [(s["kind"], s["start"], s["stop"]) for s in f]) if f else t for t, f in rows])

    return held.join(found, row, "left").select(*named(names), at).mapInArrow(joined, schema)


def replaced(text: str, found: list[Span]) -> str:
    out, last = [], 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, stop)
    return "".join([*out, text[last:]])
