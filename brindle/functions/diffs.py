"""Text differences, patches, templates and lexers, as vectorised UDFs."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def _chunks(a: list[str], b: list[str]) -> list[dict]:
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op in ("replace", "delete"):
            out.append({"kind": "removed", "items": a[i:j]})
        if op in ("replace", "insert"):
            out.append({"kind": "added", "items": b[k:m]})
        if op == "equal":
            out.append({"kind": "same", "items": a[i:j]})
    return out


def _differ(split):
    @vectorized("array<struct<kind: string, items: array<string>>>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _chunks(split(a), split(b)) for a, b in zip(old, new)])

    return run


#: Chunks of kind same, removed or added, by lines, words or characters.
diff_lines = _differ(lambda s: s.split("\n"))
diff_words = _differ(str.split)
diff_chars = _differ(list)


def _patch(old: str, new: str, context: int) -> str:
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), "old", "new", n=context, lineterm=""))


@vectorized("string")
def create_patch(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified, with three lines of context; empty for equal texts."""
    return pd.Series([None if a is None or b is None else _patch(a, b, 3) for a, b in zip(old, new)], dtype=object)


def _applied(text: str, patch: str) -> str | None:
    lines, out, at = text.split("\n"), [], 0
    for line in patch.split("\n")[2:]:
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+", line)
        if m:
            start = int(m[1]) - (m[2] != "0")
            out += lines[at:start]
            at = start
        elif line.startswith("+"):
            out.append(line[1:])
        elif line[:1] in (" ", "-"):
            if at >= len(lines) or lines[at] != line[1:]:
                return None
            if line[0] == " ":
                out.append(line[1:])
            at += 1
    return "\n".join(out + lines[at:])


@vectorized("string")
def apply_patch(text: pd.Series, patch: pd.Series) -> pd.Series:
    """Null where the patch does not fit."""
    return pd.Series([None if t is None or p is None else t if not p else _applied(t, p) for t, p in zip(text, patch)], dtype=object)


@vectorized("double")
def similarity(old: pd.Series, new: pd.Series) -> pd.Series:
    """Share of words in common, by matching runs."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio() for a, b in zip(old, new)])


_TAG = re.compile(r"\{\{\s*([#/^]?)\s*([\w.@]+)\s*\}\}")


def _value(data, path: str):
    if path in (".", "this"):
        return data
    for part in path.split("."):
        data = data.get(part) if isinstance(data, dict) else None
    return data


def _rendered(template: str, data) -> str:
    """{{name}}, {{#name}}...{{/name}} for lists and truths, {{^name}}...{{/name}} for falsehoods."""

    def block(at: int, scope, end: str | None):
        out = []
        while True:
            m = _TAG.search(template, at)
            if not m:
                out.append(template[at:])
                return "".join(out), len(template)
            out.append(template[at : m.start()])
            at = m.end()
            kind, name = m[1], m[2]
            if kind == "/":
                if name == end:
                    return "".join(out), at
            elif kind:
                value = _value(scope, name)
                items = value if isinstance(value, list) else [value if isinstance(value, dict) else scope] if value else []
                if kind == "^":
                    items = [] if value else [scope]
                after = None
                for item in items:
                    text, after = block(at, item, name)
                    out.append(text)
                at = after if after is not None else block(at, {}, name)[1]
            else:
                value = _value(scope, name)
                out.append("" if value is None else json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value))

    return block(0, data, None)[0]


@vectorized("string")
def render(template: pd.Series, data: pd.Series) -> pd.Series:
    """A template with the values of a JSON object."""
    return pd.Series([None if t is None or d is None else _rendered(t, json.loads(d)) for t, d in zip(template, data)], dtype=object)


def lexer(rules: list[tuple[str, str]]):
    """A tokenizer of ordered (name, pattern) rules: array of struct<type, value, at>; rules named '' are passed over, other characters are of type error."""
    pattern = re.compile("|".join(f"(?P<g{i}>{p})" for i, (_, p) in enumerate(rules)))

    def tokens(s: str) -> list[dict]:
        out, at = [], 0
        while at < len(s):
            m = pattern.match(s, at)
            if m and m.end() > at:
                name = rules[int(m.lastgroup[1:])][0]
                if name:
                    out.append({"type": name, "value": m[0], "at": at})
                at = m.end()
            else:
                out.append({"type": "error", "value": s[at], "at": at})
                at += 1
        return out

    @vectorized("array<struct<type: string, value: string, at: int>>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tokens(t) for t in text])

    return run


def find_patterns(s: Column, words: list[str]) -> Column:
    """All occurrences of many words, overlapping ones too: array of struct<word, at>; one scan for each word inside the expression."""
    n = F.length(s)

    def hits(w: str) -> Column:
        spots = F.when(n >= len(w), F.sequence(F.lit(0), F.greatest(n - len(w), F.lit(0)))).otherwise(F.array().cast("array<int>"))
        found = F.filter(spots, lambda i: F.substring(s, i + 1, F.lit(len(w))) == w)
        return F.when(F.contains(s, F.lit(w)), F.transform(found, lambda i: F.struct(F.lit(w).alias("word"), i.alias("at")))).otherwise(F.array().cast("array<struct<word: string, at: int>>"))

    return F.array_sort(F.flatten(F.array(*[hits(w) for w in words])), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0))


def run_automaton(s: Column, start: str, transitions: dict[tuple[str, str], str]) -> Column:
    """The state after a deterministic automaton has read the text; null where a step is missing."""
    table = F.create_map(*[F.lit(x) for (state, symbol), to in transitions.items() for x in (f"{state}\0{symbol}", to)])
    step = lambda state, c: F.when(c == "", state).otherwise(F.try_element_at(table, F.concat(state, F.lit("\0"), c)))
    return F.aggregate(F.split(s, ""), F.lit(start), step)
