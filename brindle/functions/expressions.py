"""Arithmetic expressions and spreadsheet formulas, compiled from text to Column expressions.

So a formula is planned and run by Spark like any other expression, and never evaluated row by row in Python.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text is no expression, or names something unknown."""


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|\"([^\"]*)\"|([A-Za-z_$][A-Za-z0-9_$.]*)|(<=|>=|<>|[-+*/%^(),:&<>=]))")


def _split(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        kind = ("number", "text", "name", "mark")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def _numbers(fold):
    return lambda *xs: reduce(fold, [x.cast("double") for x in xs])


def _rounded(x: Column, digits: Column | None = None) -> Column:
    k = F.pow(F.lit(10.0), digits) if digits is not None else F.lit(1.0)
    return F.floor(x * k + 0.5) / k


#: Functions of expressions, by lower-case name.
FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "pow": F.pow, "round": _rounded,
    "min": _numbers(F.least), "max": _numbers(F.greatest), "sum": _numbers(lambda a, b: a + b), "average": lambda *xs: _numbers(lambda a, b: a + b)(*xs) / len(xs),
    "count": lambda *xs: reduce(lambda a, b: a + b, [F.when(x.try_cast("double").isNotNull(), 1).otherwise(0) for x in xs]),
    "if": lambda test, yes, no=None: F.when(test.cast("boolean"), yes).otherwise(F.lit(None) if no is None else no),
    "concat": lambda *xs: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs]), "len": lambda s: F.length(s.cast("string")), "upper": F.upper, "lower": F.lower,
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


class _Parser:
    def __init__(self, text: str, names: Mapping[str, Column]):
        self.tokens, self.at, self.names = _split(text), 0, {k.lower(): v for k, v in names.items()}

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else None

    def accept(self, *marks: str) -> str | None:
        mark = self.peek()
        if mark in marks:
            self.at += 1
            return mark
        return None

    def expect(self, mark: str) -> None:
        if not self.accept(mark):
            raise ExpressionError(f"expected {mark!r}")

    def comparison(self) -> Column:
        left = self.joined()
        while op := self.accept("<=", ">=", "<>", "<", ">", "="):
            right = self.joined()
            left = {"<=": left <= right, ">=": left >= right, "<>": left != right, "<": left < right, ">": left > right, "=": left == right}[op]
        return left

    def joined(self) -> Column:
        left = self.sums()
        while self.accept("&"):
            left = FUNCTIONS["concat"](left, self.sums())
        return left

    def sums(self) -> Column:
        left = self.products()
        while op := self.accept("+", "-"):
            right = self.products()
            left = left + right if op == "+" else left - right
        return left

    def products(self) -> Column:
        left = self.signed()
        while op := self.accept("*", "/", "%"):
            right = self.signed()
            left = left * right if op == "*" else F.try_divide(left, right) if op == "/" else F.try_mod(left, right)
        return left

    def signed(self) -> Column:
        if self.accept("-"):
            return -self.signed()
        if self.accept("+"):
            return self.signed()
        return self.powers()

    def powers(self) -> Column:
        base = self.atom()
        return F.pow(base, self.signed()) if self.accept("^") else base  # groups to the right

    def atom(self) -> Column:
        if self.accept("("):
            inner = self.comparison()
            self.expect(")")
            return inner
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if kind == "text":
            return F.lit(text)
        if kind == "mark":
            raise ExpressionError(f"unexpected {text!r}")
        name = text.lower().replace("$", "")
        if self.accept("("):
            args: list[Column] = []
            while not self.accept(")"):
                args += self.cells(self.comparison_or_range())
                if self.peek() != ")":
                    self.expect(",")
            if name not in FUNCTIONS:
                raise ExpressionError(f"unknown function {text!r}")
            return FUNCTIONS[name](*args)
        if name in self.names:
            return self.names[name]
        if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        raise ExpressionError(f"unknown name {text!r}")

    def comparison_or_range(self) -> Column | list[str]:
        """A1:B3 among a function's arguments, or an expression."""
        t = self.tokens
        if self.at + 2 < len(t) and t[self.at][0] == t[self.at + 2][0] == "name" and t[self.at + 1] == ("mark", ":"):
            a, b = t[self.at][1], t[self.at + 2][1]
            self.at += 3
            return range_cells(a, b)
        return self.comparison()

    def cells(self, found: Column | list[str]) -> list[Column]:
        if isinstance(found, Column):
            return [found]
        return [self.names[c.lower()] for c in found if c.lower() in self.names]


def compile_expression(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """Operators + - * / % ^ & and comparisons, calls, names; division by zero gives null."""
    p = _Parser(text, names or {})
    out = p.comparison()
    if p.at != len(p.tokens):
        raise ExpressionError(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def compile_formula(text: str, cells: Mapping[str, Column]) -> Column:
    """A text that starts with = is a formula over cells named like A1; any other is itself."""
    return compile_expression(text[1:], cells) if text.startswith("=") else F.lit(text)


def column_letters(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(letters: str) -> int:
    return reduce(lambda n, c: n * 26 + ord(c) - 64, letters.upper(), 0)


def cell(ref: str) -> tuple[int, int]:
    """(row, column) from 1."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?([1-9]\d*)", ref)
    if not m:
        raise ExpressionError(f"no cell: {ref!r}")
    return int(m[2]), column_number(m[1])


def range_cells(a: str, b: str) -> list[str]:
    (r1, c1), (r2, c2) = cell(a), cell(b)
    return [f"{column_letters(c)}{r}" for r in range(min(r1, r2), max(r1, r2) + 1) for c in range(min(c1, c2), max(c1, c2) + 1)]
