"""Serial formats and enumerations as vectorised UDFs: MessagePack, JSON Patch, JSON Schema, LZ codes, combinations, formats of numbers."""

from __future__ import annotations

import itertools
import json
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def _pack(v) -> bytes:
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        for low, high, head, kind in ((0, 0x7F, None, "B"), (-32, -1, None, "b"), (0, 0xFF, 0xCC, "B"), (0, 0xFFFF, 0xCD, "H"), (0, 0xFFFFFFFF, 0xCE, "I"), (0, (1 << 64) - 1, 0xCF, "Q"), (-(1 << 7), -1, 0xD0, "b"), (-(1 << 15), -1, 0xD1, "h"), (-(1 << 31), -1, 0xD2, "i"), (-(1 << 63), -1, 0xD3, "q")):
            if low <= v <= high:
                return (b"" if head is None else bytes([head])) + struct.pack(">" + kind, v)
        raise OverflowError(v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)

    def head(n: int, fix: int, room: int, codes: tuple) -> bytes:
        if n < room:
            return bytes([fix | n])
        for code, kind, most in codes:
            if n <= most:
                return bytes([code]) + struct.pack(">" + kind, n)
        raise OverflowError(n)

    if isinstance(v, str):
        raw = v.encode()
        return head(len(raw), 0xA0, 32, ((0xD9, "B", 0xFF), (0xDA, "H", 0xFFFF), (0xDB, "I", 0xFFFFFFFF))) + raw
    if isinstance(v, list):
        return head(len(v), 0x90, 16, ((0xDC, "H", 0xFFFF), (0xDD, "I", 0xFFFFFFFF))) + b"".join(map(_pack, v))
    return head(len(v), 0x80, 16, ((0xDE, "H", 0xFFFF), (0xDF, "I", 0xFFFFFFFF))) + b"".join(_pack(k) + _pack(x) for k, x in v.items())


def _unpack(b: bytes):
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(b):
            raise ValueError("the data ends early")
        return b[at - n : at]

    def number(kind: str):
        return struct.unpack(">" + kind, take(struct.calcsize(kind)))[0]

    plain = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
    sized = {0xD9: ("B", "s"), 0xDA: ("H", "s"), 0xDB: ("I", "s"), 0xDC: ("H", "a"), 0xDD: ("I", "a"), 0xDE: ("H", "m"), 0xDF: ("I", "m")}

    def value():
        c = take(1)[0]
        if c <= 0x7F or c >= 0xE0:
            return c if c <= 0x7F else c - 256
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        if c in plain:
            return number(plain[c])
        n, kind = (number(sized[c][0]), sized[c][1]) if c in sized else (c & 0x1F, "s") if c >> 5 == 5 else (c & 0xF, "a" if c >> 4 == 9 else "m")
        if kind == "s":
            return take(n).decode()
        if kind == "a":
            return [value() for _ in range(n)]
        return {value(): value() for _ in range(n)}

    return value()


@vectorized("binary")
def json_to_msgpack(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _pack(json.loads(t)) for t in text], dtype=object)


@vectorized("string")
def msgpack_to_json(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else json.dumps(_unpack(bytes(d)), ensure_ascii=False, separators=(",", ":")) for d in data], dtype=object)


def _patched(doc, ops: list[dict]):
    """RFC 6902: add, remove, replace, move, copy, test."""
    parts = lambda p: [x.replace("~1", "/").replace("~0", "~") for x in p.split("/")[1:]]

    def get(path: list[str]):
        at = doc
        for p in path:
            at = at[int(p)] if isinstance(at, list) else at[p]
        return at

    def put(path: list[str], v, replace: bool) -> None:
        nonlocal doc
        if not path:
            doc = v
            return
        at, last = get(path[:-1]), path[-1]
        if isinstance(at, list):
            i = len(at) if last == "-" else int(last)
            if i > len(at) or (replace and i == len(at)):
                raise KeyError(last)
            at[i : i + replace] = [v]
        elif replace and last not in at:
            raise KeyError(last)
        else:
            at[last] = v

    def drop(path: list[str]):
        at, last = get(path[:-1]), path[-1]
        return at.pop(int(last)) if isinstance(at, list) else at.pop(last)

    copy = lambda v: json.loads(json.dumps(v))
    for op in ops:
        kind, path = op["op"], parts(op["path"])
        if kind in ("add", "replace"):
            put(path, copy(op["value"]), kind == "replace")
        elif kind == "remove":
            drop(path)
        elif kind == "move":
            put(path, drop(parts(op["from"])), False)
        elif kind == "copy":
            put(path, copy(get(parts(op["from"]))), False)
        elif kind == "test" and get(path) != op["value"]:
            raise KeyError("test")
    return doc


@vectorized("string")
def json_patch(document: pd.Series, operations: pd.Series) -> pd.Series:
    """Null where an operation does not fit."""

    def one(d, ops):
        try:
            return json.dumps(_patched(json.loads(d), json.loads(ops)), ensure_ascii=False, separators=(",", ":"))
        except (KeyError, IndexError, ValueError, TypeError):
            return None

    return pd.Series([None if d is None or o is None else one(d, o) for d, o in zip(document, operations)], dtype=object)


_KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _errors(v, schema: dict, path: str) -> list[str]:
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds
        ok = any(isinstance(v, _KINDS[k]) and not (isinstance(v, bool) and k in ("number", "integer")) for k in names)
        if not ok:
            return [f"{path or '.'}: not {' or '.join(names)}"]
    if "enum" in schema and v not in schema["enum"]:
        out.append(f"{path or '.'}: not allowed")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        out += [f"{path or '.'}: too {w}" for w, bad in (("small", v < schema.get("minimum", v)), ("large", v > schema.get("maximum", v))) if bad]
    if isinstance(v, str):
        out += [f"{path or '.'}: too {w}" for w, bad in (("short", len(v) < schema.get("minLength", 0)), ("long", len(v) > schema.get("maxLength", len(v)))) if bad]
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.append(f"{path or '.'}: does not match")
    if isinstance(v, dict):
        out += [f"{path}.{k}".lstrip(".") + ": missing" for k in schema.get("required", []) if k not in v]
        for k, s in schema.get("properties", {}).items():
            if k in v:
                out += _errors(v[k], s, f"{path}.{k}".lstrip("."))
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}".lstrip(".") + ": unknown" for k in v if k not in schema.get("properties", {})]
    if isinstance(v, list):
        out += [f"{path or '.'}: too {w}" for w, bad in (("short", len(v) < schema.get("minItems", 0)), ("long", len(v) > schema.get("maxItems", len(v)))) if bad]
        for i, x in enumerate(v if "items" in schema else []):
            out += _errors(x, schema["items"], f"{path}.{i}".lstrip("."))
    return out


def json_schema_errors(text: Column, schema: dict) -> Column:
    """Messages of what a JSON text breaks; one for a text that is no JSON."""

    @vectorized("array<string>")
    def run(t: pd.Series) -> pd.Series:
        def one(s):
            try:
                return _errors(json.loads(s), schema, "")
            except ValueError:
                return ["no JSON"]

        return pd.Series([None if s is None else one(s) for s in t])

    return run(text)


def _lz77(s: str, window: int = 255) -> list[dict]:
    out, at = [], 0
    while at < len(s):
        best, back = 0, 0
        for start in range(max(0, at - window), at):
            n = 0
            while at + n < len(s) - 1 and s[start + n] == s[at + n] and n < window:
                n += 1
            if n > best:
                best, back = n, at - start
        out.append({"offset": back, "length": best, "next": s[at + best]})
        at += best + 1
    return out


def _unlz77(tokens) -> str:
    out: list[str] = []
    for t in tokens:
        for _ in range(t["length"]):
            out.append(out[-t["offset"]])
        out.append(t["next"])
    return "".join(out)


@vectorized("array<struct<offset: int, length: int, next: string>>")
def lz77(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _lz77(t) for t in text])


@vectorized("string")
def unlz77(tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _unlz77(t) for t in tokens], dtype=object)


@vectorized("string")
def inverse_bwt(transformed: pd.Series, index: pd.Series) -> pd.Series:
    def one(s: str, i: int) -> str:
        order = sorted(range(len(s)), key=lambda j: s[j])
        out = []
        for _ in s:
            i = order[i]
            out.append(s[i])
        return "".join(out)

    return pd.Series([None if s is None else one(s, int(i)) for s, i in zip(transformed, index)], dtype=object)


@vectorized("array<array<string>>")
def combinations(items: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [list(c) for c in itertools.combinations(x, int(n))] for x, n in zip(items, size)])


@vectorized("array<array<string>>")
def permutations(items: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [list(c) for c in itertools.permutations(x)] for x in items])


def power_set(a: Column) -> Column:
    """All subsets, in plain expressions: bit i of a counter takes item i."""
    n = F.pow(F.lit(2), F.size(a)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(a, lambda _, i: F.floor(k / F.pow(F.lit(2), i)) % 2 == 1))


def format_number(x: Column, digits: int = 2, group: str = ",", point: str = ".") -> Column:
    s = F.format_number(x, digits)
    return F.translate(s, ",.", group + point) if (group, point) != (",", ".") else s


def format_currency(x: Column, symbol: str = "$", digits: int = 2) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(x), digits))


def format_percent(x: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def parse_number(s: Column, group: str = ",", point: str = ".") -> Column:
    """Null for texts that are no number; grouping marks, blanks and currency signs are passed over."""
    bare = F.regexp_replace(F.replace(s, F.lit(group), F.lit("")), r"[\s$€£¥%]", "")
    return (bare if point == "." else F.replace(bare, F.lit(point), F.lit("."))).try_cast("double")
