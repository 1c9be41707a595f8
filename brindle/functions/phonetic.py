"""Phonetic codes, as vectorised UDFs, and matching by them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import soundex
from .vectorized import vectorized

# fixed values: the published rules of NYSIIS for the starts and ends of names
NYSIIS_STARTS = (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
NYSIIS_ENDS = (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D"))


def _nysiis(word: str) -> str:
    s = re.sub("[^A-Z]", "", word.upper())
    if not s:
        return ""
    first = s[0]
    for a, b in NYSIIS_STARTS:
        if s.startswith(a):
            s = b + s[len(a) :]
            break
    for a, b in NYSIIS_ENDS:
        if s.endswith(a):
            s = s[: -len(a)] + b
            break
    rest = s[1:]
    for a, b in (("EV", "AF"), ("[AEIOU]", "A"), ("Q", "G"), ("Z", "S"), ("M", "N"), ("KN", "N"), ("K", "C"), ("SCH", "SSS"), ("PH", "FF")):
        rest = re.sub(a, b, rest)
    code = [s[0]]
    for i, c in enumerate(rest):
        before, after = (rest[i - 1] if i else s[0]), rest[i + 1 : i + 2]
        if c == "H" and (before not in "AEIOU" or (after and after != "A")):
            c = code[-1]
        elif c == "W" and before in "AEIOU":
            c = code[-1]
        if c != code[-1]:
            code.append(c)
    out = "".join(code)[:6]
    out = out[:-1] if len(out) > 1 and out.endswith("S") else out
    out = out[:-2] + "Y" if out.endswith("AY") else out
    out = out.rstrip("A") if len(out) > 1 and out.rstrip("A") else out
    return (first if first not in "KP" or out[0] == first else out[0]) + out[1:]


# fixed values: the published rules of Metaphone, tried in order at each place: what stands there, and its sound
METAPHONE = (
    (r"(?<=M)B$", ""), ("CIA", "X"), ("(?<!S)CH", "X"), ("SCH", "SK"), ("(?<!S)C(?=[IEY])", "S"), ("SC(?=[IEY])", "S"), ("CK", "K"), ("C", "K"), ("DG(?=[EIY])", "J"), ("D", "T"),
    ("GH(?=[^AEIOU]|$)", ""), ("GN(ED)?$", "N"), ("G(?=[IEY])", "J"), ("G", "K"), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("(?<=[CSPTG])H", ""), ("PH", "F"), ("Q", "K"),
    ("S(?=I[OA])", "X"), ("SH", "X"), ("T(?=I[OA])", "X"), ("TH", "0"), ("T(?=CH)", ""), ("V", "F"), ("WH", "W"), ("W(?![AEIOU])", ""), ("X", "KS"), ("Y(?![AEIOU])", ""), ("Z", "S"), ("([BFHJKLMNPRSTWY])", None),
)
METAPHONE_STARTS = (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("X", "S"), ("WH", "W"))
_SOUNDS = [(re.compile(p), sound) for p, sound in METAPHONE]


def _metaphone(word: str) -> str:
    s = re.sub("[^A-Z]", "", word.upper())
    for a, b in METAPHONE_STARTS:
        if s.startswith(a):
            s = b + s[len(a) :]
            break
    s = re.sub(r"([^C])\1", r"\1", s)
    out, at = [], 0
    while at < len(s):
        if s[at] in "AEIOU":
            out.append(s[at] if at == 0 else "")
            at += 1
            continue
        for pattern, sound in _SOUNDS:
            m = pattern.match(s, at)
            if m and m.end() > at:
                out.append(m[0] if sound is None else sound)
                at = m.end()
                break
        else:
            at += 1
    return "".join(out)


def _coded(fn):
    @vectorized("string")
    def run(word: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else fn(w) for w in word], dtype=object)

    return run


nysiis = _coded(_nysiis)
metaphone = _coded(_metaphone)
CODES = {"soundex": soundex, "nysiis": nysiis, "metaphone": metaphone}


def phonetic_match(a: Column, b: Column, code: str = "soundex") -> Column:
    return CODES[code](a) == CODES[code](b)


def phonetic_groups(words: DataFrame, word: str, code: str = "soundex") -> DataFrame:
    """code and its distinct words, sorted."""
    return words.select(CODES[code](F.col(word)).alias("code"), word).groupBy("code").agg(F.array_sort(F.collect_set(word)).alias("words"))
