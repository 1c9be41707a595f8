"""String measures that need a program, as vectorised UDFs over Arrow batches."""

from __future__ import annotations

import pandas as pd

from .vectorized import vectorized


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _damerau(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no substring edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def _subsequence(a: str, b: str) -> str:
    table = [[0] * (len(b) + 1)]
    for x in a:
        last = table[-1]
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def _substring(a: str, b: str) -> str:
    best, end, last = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else 0)
            if row[-1] > best:
                best, end = row[-1], i
        last = row
    return a[end - best : end]


def _pairs(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)])


@vectorized("double")
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_jaro, a, b)


@vectorized("double")
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro, raised by a tenth of the rest for each of up to four equal first characters."""

    def one(x: str, y: str) -> float:
        j = _jaro(x, y)
        k = 0
        while k < min(4, len(x), len(y)) and x[k] == y[k]:
            k += 1
        return j + k * 0.1 * (1 - j)

    return _pairs(one, a, b)


@vectorized("int")
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_damerau, a, b)


@vectorized("string")
def longest_common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_subsequence, a, b)


@vectorized("string")
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_substring, a, b)


@vectorized("double")
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edits over the reference's words; 0 for two empty texts, 1 for an empty reference beside words."""

    def one(r: str, h: str) -> float:
        x, y = r.split(), h.split()
        if not x:
            return float(bool(y))
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row = row, [i]
            for j, b in enumerate(y, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
        return row[-1] / len(x)

    return _pairs(one, reference, hypothesis)


@vectorized("double")
def cosine_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the counts of character pairs."""
    from collections import Counter

    def one(x: str, y: str) -> float:
        p, q = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (x, y))
        n = (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
        return sum(v * q[k] for k, v in p.items()) / n if n else float(x == y)

    return _pairs(one, a, b)
