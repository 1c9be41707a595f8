"""Scalar predicates and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def is_ipv4(s: Column) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return _is(s, rf"^{part}(\.{part}){{3}}$")


def is_ipv6(s: Column) -> Column:
    """Groups of up to four hexadecimal digits, at most one run of them left out."""
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
    short = F.instr(s, "::") > 0
    shape = _is(s, r"^[0-9A-Fa-f:]+$") & _is(s, r"^(:?[0-9A-Fa-f]{0,4})+:?$") & ~_is(s, ":::") & ~_is(s, "::.*::")
    edges = ~_is(s, "^:[^:]") & ~_is(s, "[^:]:$")
    return F.coalesce(shape & edges & F.when(short, groups < 8).otherwise(groups == 8), F.lit(False))


def luhn(s: Column) -> Column:
    """The check digit of a card number; blanks and hyphens are passed over."""
    digits = F.reverse(F.split(F.regexp_replace(s, r"[\s-]", ""), ""))
    value = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.when(_is(F.regexp_replace(s, r"[\s-]", ""), "^[0-9]{12,19}$"), F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(False)


def is_hex_color(s: Column) -> Column:
    return _is(s, "^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")


def is_alphanumeric(s: Column) -> Column:
    return _is(s, "^[A-Za-z0-9]+$")


def is_integer_text(s: Column) -> Column:
    return _is(s, r"^[+-]?\d+$")


def rgb(hex_color: Column) -> Column:
    """struct<r, g, b> of #rgb or #rrggbb."""
    h = F.substring(hex_color, 2, 8)
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(_is(hex_color, "^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    two = lambda x: F.lpad(F.lower(F.hex(F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def hsl(r: Column, g: Column, b: Column) -> Column:
    """struct<h (degrees), s, l (per cent)>."""
    x = [c / 255.0 for c in (r, g, b)]
    hi, lo = F.greatest(*x), F.least(*x)
    d, light = hi - lo, (hi + lo) / 2
    s = F.when(d == 0, 0.0).otherwise(d / F.nullif(1 - F.abs(2 * light - 1), F.lit(0.0)))
    safe = F.nullif(d, F.lit(0.0))
    h = F.when(d == 0, 0.0).when(hi == x[0], F.pmod((x[1] - x[2]) / safe, F.lit(6.0))).when(hi == x[1], (x[2] - x[0]) / safe + 2).otherwise((x[0] - x[1]) / safe + 4) * 60
    return F.struct(h.alias("h"), (s * 100).alias("s"), (light * 100).alias("l"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB."""
    part = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast(a: Column, b: Column) -> Column:
    """Ratio of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def mime_type(name: Column) -> Column:
    """By a file name's ending."""
    # fixed values: endings and their media types
    known = {
        "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "js": "text/javascript", "json": "application/json", "xml": "application/xml", "zip": "application/zip", "gz": "application/gzip",
        "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "epub": "application/epub+zip", "djvu": "image/vnd.djvu",
    }
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def mime_of_bytes(data: Column) -> Column:
    """By the first bytes."""
    # fixed values: magic numbers of file formats, as hexadecimal
    magic = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383961", "image/gif"), ("474946383761", "image/gif"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("41542654464F524D", "image/vnd.djvu"))
    head = F.hex(F.substring(data, 1, 16))
    out = None
    for digits, kind in magic:
        out = F.when(head.startswith(digits), kind) if out is None else out.when(head.startswith(digits), kind)
    return out
