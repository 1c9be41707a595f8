"""Text structures as functions of columns: edits and their transformation, suffix arrays, url patterns, fractions, small parsers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def applied(text: Column, edits: Column) -> Column:
    """``text`` after ``edits`` (structs of at, remove, insert; code points, one after another), bounds cut to the text."""

    def step(s: Column, e: Column) -> Column:
        at = F.least(F.greatest(e["at"], F.lit(0)), F.length(s))
        return F.concat(F.substring(s, F.lit(1), at), e["insert"], F.substring(s, at + F.greatest(e["remove"], F.lit(0)) + 1, F.length(s)))

    return F.aggregate(edits, text, step)


def transformed(edit: Column, against: Column, first: bool = False) -> Column:
    """``edit`` as it is after ``against`` (both made on one text) was applied, so that either order of the two gives one text.

    What both remove is removed once, and what one puts strictly within a stretch that the other removes goes with it. Of
    edits at one place that which removes less stays in front, of those alike that of the ``first`` side.
    """
    at, end, gone = edit["at"], edit["at"] + edit["remove"], against["remove"]
    start, stop, come = against["at"], against["at"] + against["remove"], F.length(against["insert"])
    rest = edit["remove"] - F.greatest(F.lit(0), F.least(end, stop) - F.greatest(at, start))
    within, around = (start < at) & (at < stop), (at < start) & (start < end)
    behind = (edit["remove"] > gone) | ((edit["remove"] == gone) & F.lit(not first))
    place = F.when(within, start + come).when(at == start, at + F.when(behind, come).otherwise(0)).when(at > start, at - gone + come).otherwise(at)
    return F.struct(place.cast("int").alias("at"), (rest + F.when(around, come).otherwise(0)).cast("int").alias("remove"), F.when(within, "").otherwise(edit["insert"]).alias("insert"))


@vectorized("array<int>")
def suffix_array(text: pd.Series) -> pd.Series:
    """Starts of the suffixes in order of code points, by doubled prefixes."""

    def one(s: str | None):
        if s is None:
            return None
        n, rank, k = len(s), [ord(c) for c in s], 1
        order = list(range(n))
        while n:
            key = [(rank[i], rank[i + k] if i + k < n else -1) for i in range(n)]
            order.sort(key=key.__getitem__)
            new = [0] * n
            for x, y in zip(order, order[1:]):
                new[y] = new[x] + (key[x] != key[y])
            rank, k = new, 2 * k
            if rank[order[-1]] == n - 1:
                break
        return order

    return text.map(one)


@vectorized("string")
def longest_repeat(text: pd.Series) -> pd.Series:
    """The longest text that stands at two places (which may overlap); the first in order of those as long."""

    def one(s: str | None):
        if s is None:
            return None
        low, high, best = 1, len(s) - 1, ""
        while low <= high:  # a repeat of a length has one of each smaller length
            n, seen, found = (low + high) // 2, set(), None
            for i in range(len(s) - n + 1):
                part = s[i : i + n]
                if part in seen:
                    found = part if found is None else min(found, part)
                seen.add(part)
            low, high, best = (n + 1, high, found) if found is not None else (low, n - 1, best)
        return best

    return text.map(one)


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, overlaps counted."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(part)) == part)).cast("long")


def distinct_substrings(text: Column) -> Column:
    """The number of distinct non-empty substrings; quadratic, for short texts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substring(text, i, n))))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(parts))).cast("long")


def path_match(path: Column, pattern: str) -> Column:
    """The named parts of a path that fits ``pattern`` (``/users/:id/files/*``: names take one segment, a star the rest), else null."""
    names, regex = [], "^"
    for part in re.split(r"(:[A-Za-z_]\w*|\*)", pattern):
        if part.startswith(":"):
            names.append(part[1:])
            regex += "([^/]+)"
        elif part == "*":
            names.append("*")
            regex += "(.*)"
        else:
            regex += re.escape(part)
    regex += "$"
    found = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(path, regex, i + 1))]) if names else F.create_map().cast("map<string,string>")
    return F.when(path.rlike(regex), found)


def path_build(pattern: str, values: dict[str, Column]) -> Column:
    parts = [values[p[1:]].cast("string") if p.startswith(":") else F.lit(p) for p in re.split(r"(:[A-Za-z_]\w*)", pattern) if p]
    return F.concat(*parts)


_GCD = "aggregate(sequence(1, 100), named_struct('a', abs({a}), 'b', abs({b})), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b))).a"


def fraction(num: Column, den: Column) -> Column:
    """num / den in lowest terms, the sign above; null where den is 0."""
    big = F.struct(num.cast("long").alias("n"), den.cast("long").alias("d"))
    made = F.transform(F.array(big), lambda s: F.struct(s["n"].alias("n"), s["d"].alias("d"), F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.abs(s["n"]).alias("a"), F.abs(s["d"]).alias("b")), lambda g, _: F.when(g["b"] == 0, g).otherwise(F.struct(g["b"].alias("a"), (g["a"] % F.when(g["b"] == 0, 1).otherwise(g["b"])).alias("b"))))["a"].alias("g")))[0]
    sign = F.when(made["d"] < 0, F.lit(-1)).otherwise(F.lit(1))
    whole = lambda x: F.when(made["g"] == 0, x).otherwise((x - x % made["g"]) / made["g"]).cast("long")
    return F.when(den != 0, F.struct((sign * whole(made["n"])).cast("long").alias("num"), (sign * whole(made["d"])).cast("long").alias("den")))


def fraction_add(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def fraction_multiply(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["num"], a["den"] * b["den"])


def fraction_less(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] < b["num"] * a["den"]


@vectorized("boolean")
def deep_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two JSON texts hold equal values: objects whatever the order of their names, 1 and 1.0 alike, true and 1 not."""

    def same(x, y) -> bool:
        if isinstance(x, bool) or isinstance(y, bool):
            return x is y
        if isinstance(x, dict) and isinstance(y, dict):
            return x.keys() == y.keys() and all(same(v, y[k]) for k, v in x.items())
        if isinstance(x, list) and isinstance(y, list):
            return len(x) == len(y) and all(map(same, x, y))
        return x == y

    def one(x, y):
        try:
            return None if x is None or y is None else same(json.loads(x), json.loads(y))
        except ValueError:
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


def kind_of(text: Column) -> Column:
    """The kind of a JSON text's value: object, array, string, number, boolean, null; null where it is none."""
    t = F.trim(text)
    ok = F.try_parse_json(t).isNotNull()
    return F.when(ok, F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), "string").when(t == "null", "null").when(t.isin("true", "false"), "boolean").otherwise("number"))


def result(value: Column, problem: Column) -> Column:
    """A struct of ok, value and error: the value where there is no problem (a null text)."""
    return F.struct(problem.isNull().alias("ok"), F.when(problem.isNull(), value).alias("value"), problem.alias("error"))


def result_map(r: Column, fn: Callable[[Column], Column]) -> Column:
    return F.struct(r["ok"].alias("ok"), F.when(r["ok"], fn(r["value"])).alias("value"), r["error"].alias("error"))


def result_or(r: Column, other: Column) -> Column:
    return F.when(r["ok"], r["value"]).otherwise(other)


def short_id(seed: Column, size: int = 21, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") -> Column:
    """An identifier of ``size`` signs from a hash of ``seed``: alike for equal seeds, so a task that is run again gives the same."""
    signs = F.array(*[F.lit(c) for c in alphabet])
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.get(signs, F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))).cast("int"))), "")


def varint(n: Column) -> Column:
    """A number from 0 on as base-128 bytes, low ones first, in hex; the high bit says that more follow."""
    steps = F.sequence(F.lit(0), F.lit(8))
    groups = F.transform(steps, lambda i: F.call_function("shiftrightunsigned", n.cast("long"), (i * 7).cast("int")).bitwiseAND(F.lit(127)))
    last = F.aggregate(steps, F.lit(0), lambda a, i: F.when(F.get(groups, i) > 0, i).otherwise(a))
    return F.array_join(F.transform(F.slice(groups, F.lit(1), last + 1), lambda g, i: F.lpad(F.hex(F.when(i < last, g.bitwiseOR(F.lit(128))).otherwise(g)), 2, "0")), "")


# small parsers: a parser takes a text and a place, and gives (value, place behind it) or None

Parser = Callable[[str, int], "tuple[object, int] | None"]


def token(pattern: str) -> Parser:
    regex = re.compile(r"\s*(" + pattern + ")")

    def run(s: str, i: int):
        m = regex.match(s, i)
        return (m[1], m.end()) if m else None

    return run


def sequence(*parsers: Parser) -> Parser:
    def run(s: str, i: int):
        out = []
        for p in parsers:
            got = p(s, i)
            if got is None:
                return None
            out.append(got[0])
            i = got[1]
        return out, i

    return run


def either(*parsers: Parser) -> Parser:
    return lambda s, i: next((got for got in (p(s, i) for p in parsers) if got is not None), None)


def many(parser: Parser) -> Parser:
    def run(s: str, i: int):
        out = []
        while (got := parser(s, i)) is not None and got[1] > i:
            out.append(got[0])
            i = got[1]
        return out, i

    return run


def mapped(parser: Parser, fn: Callable) -> Parser:
    def run(s: str, i: int):
        got = parser(s, i)
        return None if got is None else (fn(got[0]), got[1])

    return run


def separated(item: Parser, between: Parser) -> Parser:
    """One item or more, as (first, [(separator, item), ...])."""
    return sequence(item, many(sequence(between, item)))


def parsed(parser: Parser, kind: str) -> Callable[[Column], Column]:
    """A function of a text column: the value of what the parser reads, null where it does not read all of the text."""

    def run(text: pd.Series) -> pd.Series:
        def one(s):
            got = None if s is None else parser(s, 0)
            return got[0] if got is not None and not s[got[1] :].strip() else None

        return text.map(one)

    return vectorized(kind)(run)


def arithmetic() -> Parser:
    """Numbers, + - * / and brackets, as a value; a division by zero gives none."""

    def folded(x):
        value = x[0]
        for op, y in x[1]:
            if value is None or y is None or (op == "/" and y == 0):
                return None
            value = value + y if op == "+" else value - y if op == "-" else value * y if op == "*" else value / y
        return value

    number = mapped(token(r"-?[0-9]+(?:\.[0-9]+)?"), float)
    inner: list[Parser] = []
    bracket = mapped(sequence(token(r"\("), lambda s, i: inner[0](s, i), token(r"\)")), lambda x: x[1])
    factor = either(number, bracket)
    term = mapped(separated(factor, token(r"[*/]")), folded)
    inner.append(mapped(separated(term, token(r"[+-]")), folded))
    return inner[0]


@vectorized("array<int>")
def assignment(domains: pd.Series, different: pd.Series) -> pd.Series:
    """The first assignment, in order, of values to variables (a list of values each) in which the pairs ``different`` differ, by backtracking; null where none is."""

    def one(domain, pairs):
        if domain is None:
            return None
        domain, n = [list(d) for d in domain], len(domain)
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in () if pairs is None else pairs:
            near[a].append(b)
            near[b].append(a)
        chosen: list[int] = []
        at = [0] * (n + 1)
        while len(chosen) < n:
            v = len(chosen)
            while at[v] < len(domain[v]) and any(u < v and chosen[u] == domain[v][at[v]] for u in near[v]):
                at[v] += 1
            if at[v] < len(domain[v]):
                chosen.append(int(domain[v][at[v]]))
                at[v + 1] = 0
            elif not chosen:
                return None
            else:
                chosen.pop()
                at[v - 1] += 1
        return chosen

    return pd.Series([one(d, p) for d, p in zip(domains, different)])
