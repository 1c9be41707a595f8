"""URL and query-string scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str) -> Column:
    """PROTOCOL, HOST, PATH, QUERY, REF, AUTHORITY, FILE or USERINFO; null for what is no URL."""
    return F.try_parse_url(url, F.lit(name))


def parsed(url: Column) -> Column:
    return F.struct(*[part(url, n).alias(a) for n, a in (("PROTOCOL", "protocol"), ("HOST", "host"), ("PATH", "path"), ("QUERY", "query"), ("REF", "hash"))], port(url).alias("port"))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1), F.lit("")).cast("int")


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False))


def domain(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), "^www\\.", "")


def query_pairs(query: Column) -> Column:
    """Array of (key, value), decoded, in order; a leading ? is passed over."""
    parts = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    decode = lambda s: F.try_url_decode(s)
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("value")))


def query_get(query: Column, key: str) -> Column:
    """The first value of a key, or null."""
    return F.get(F.filter(query_pairs(query), lambda p: p["key"] == key), F.lit(0))["value"]


def query_map(query: Column) -> Column:
    """key -> array of its values."""
    pairs = query_pairs(query)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])))


def query_string(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def query_set(query: Column, key: str, value: Column) -> Column:
    """The query with the key's values replaced by one, at the end."""
    rest = F.filter(query_pairs(query), lambda p: p["key"] != key)
    return query_string(F.concat(rest, F.array(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))))


def query_remove(query: Column, key: str) -> Column:
    return query_string(F.filter(query_pairs(query), lambda p: p["key"] != key))


def links(html: Column) -> Column:
    """The href values of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))


def without_tracking(url: Column) -> Column:
    """Without the fragment and utm parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"([?&])(?:utm_[^&]*&?)+", "$1"), r"[?&]$", "")
