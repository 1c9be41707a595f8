"""Hashes, codecs and compression of single values. Builtins where Spark has them; the rest are vectorised UDFs."""

from __future__ import annotations

import base64 as b64
import hmac as _hmac
import zlib
from collections import Counter
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized


def md5(s: Column) -> Column:
    return F.md5(s.cast("binary"))


def sha1(s: Column) -> Column:
    return F.sha1(s.cast("binary"))


def sha256(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def crc32(s: Column) -> Column:
    return F.crc32(s.cast("binary"))


def to_hex(s: Column) -> Column:
    return F.lower(F.hex(s.cast("binary")))


def from_hex(s: Column) -> Column:
    return F.unhex(s).cast("string")


def to_base64(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def from_base64(s: Column) -> Column:
    return F.unbase64(s).cast("string")


def to_base64url(s: Column) -> Column:
    """Without padding."""
    return F.rtrim(F.translate(F.base64(s.cast("binary")), "+/", "-_"), F.lit("="))


def _text(fn, kind: str):
    @vectorized(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s], dtype=object)

    return run


def _record(fn, kind: str):
    """For results of several fields."""

    @vectorized(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(x or "") for x in s])

    return run


def _fold(seed: int, step):
    def run(s: str) -> int:
        h = seed
        for b in s.encode():
            h = step(h, b) & 0xFFFFFFFF
        return h

    return run


def _adler(s: str) -> int:
    return zlib.adler32(s.encode())


def _fletcher16(s: str) -> int:
    a = b = 0
    for x in s.encode():
        a = (a + x) % 255
        b = (b + a) % 255
    return b << 8 | a


def _crc(width: int, polynomial: int, start: int):
    def run(s: str) -> int:
        h, top, mask = start, 1 << (width - 1), (1 << width) - 1
        for x in s.encode():
            h ^= x << (width - 8)
            for _ in range(8):
                h = (h << 1 ^ polynomial if h & top else h << 1) & mask
        return h

    return run


# fixed values: starts, multipliers and polynomials of published 32-bit, 16-bit and 8-bit hashes
djb2 = _text(_fold(5381, lambda h, b: h * 33 + b), "long")
sdbm = _text(_fold(0, lambda h, b: b + (h << 6) + (h << 16) - h), "long")
fnv1a32 = _text(_fold(0x811C9DC5, lambda h, b: (h ^ b) * 0x01000193), "long")
adler32 = _text(_adler, "long")
fletcher16 = _text(_fletcher16, "int")
crc8 = _text(_crc(8, 0x07, 0x00), "int")
crc16 = _text(_crc(16, 0x1021, 0xFFFF), "int")

base32 = _text(lambda s: b64.b32encode(s.encode()).decode(), "string")
from_base32 = _text(lambda s: b64.b32decode(s).decode(), "string")
base85 = _text(lambda s: b64.a85encode(s.encode()).decode(), "string")

# fixed values: the digits of base 58, without those that look alike
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _base58(s: str) -> str:
    raw = s.encode()
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return BASE58[0] * (len(raw) - len(raw.lstrip(b"\0"))) + out


def _from_base58(s: str) -> str:
    n = 0
    for c in s:
        n = n * 58 + BASE58.index(c)
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return (b"\0" * (len(s) - len(s.lstrip(BASE58[0]))) + body).decode()


base58 = _text(_base58, "string")
from_base58 = _text(_from_base58, "string")


@vectorized("string")
def hmac_sha256(message: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or k is None else _hmac.new(k.encode(), m.encode(), "sha256").hexdigest() for m, k in zip(message, key)], dtype=object)


def uuid_from_name(namespace: str, name: Column) -> Column:
    """Version 5, from a namespace's hexadecimal digits: the SHA-1's first 16 bytes with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long") % 4 + 8))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def is_uuid(s: Column) -> Column:
    return F.coalesce(F.lower(s).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def _runs(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        out.append(f"{j - i}{s[i]}")
        i = j
    return "".join(out)


def _unruns(s: str) -> str:
    out, n = [], ""
    for c in s:
        if c.isdigit():
            n += c
        else:
            out.append(c * int(n or 1))
            n = ""
    return "".join(out)


#: Count and character for each run; for texts without digits.
rle_encode = _text(_runs, "string")
rle_decode = _text(_unruns, "string")


def _bwt(s: str) -> dict:
    turns = sorted(range(len(s)), key=lambda i: s[i:] + s[:i])
    return {"transformed": "".join(s[i - 1] for i in turns), "index": turns.index(0) if s else 0}


def _move_to_front(s: str) -> list[int]:
    order, out = sorted(set(s)), []
    for c in s:
        i = order.index(c)
        out.append(i)
        order.insert(0, order.pop(i))
    return out


bwt = _record(_bwt, "struct<transformed: string, index: int>")
move_to_front = _text(_move_to_front, "array<int>")


def _lzw(s: str) -> list[int]:
    known = {bytes([i]): i for i in range(256)}
    out, run = [], b""
    for b in s.encode():
        nxt = run + bytes([b])
        if nxt in known:
            run = nxt
        else:
            out.append(known[run])
            known[nxt] = len(known)
            run = bytes([b])
    return out + ([known[run]] if run else [])


def _unlzw(codes) -> str:
    known = {i: bytes([i]) for i in range(256)}
    out, last = [], b""
    for c in codes:
        piece = known[c] if c in known else last + last[:1]
        if last:
            known[len(known)] = last + piece[:1]
        out.append(piece)
        last = piece
    return b"".join(out).decode()


lzw_encode = _text(_lzw, "array<int>")
lzw_decode = _text(_unlzw, "string")


def _huffman(s: str) -> dict:
    heap = [(n, i, c) for i, (c, n) in enumerate(sorted(Counter(s).items()))]
    heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
        serial += 1
    codes: dict[str, str] = {}

    def name(node, code: str) -> None:
        if isinstance(node, tuple):
            name(node[0], code + "0")
            name(node[1], code + "1")
        else:
            codes[node] = code or "0"

    if heap:
        name(heap[0][2], "")
    return {"bits": "".join(codes[c] for c in s), "codes": codes}


#: The bits as text, and the code of each character.
huffman_encode = _record(_huffman, "struct<bits: string, codes: map<string, string>>")


@vectorized("string")
def huffman_decode(bits: pd.Series, codes: pd.Series) -> pd.Series:
    def one(b: str, table) -> str:
        back = {v: k for k, v in dict(table).items()}
        out, run = [], ""
        for x in b:
            run += x
            if run in back:
                out.append(back[run])
                run = ""
        return "".join(out)

    return pd.Series([None if b is None else one(b, c) for b, c in zip(bits, codes)], dtype=object)


deflate = _text(lambda s: zlib.compress(s.encode(), 6), "binary")
