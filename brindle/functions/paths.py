"""Path strings, easing curves, rollouts and attribute rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Without empty and . parts, .. taken back where it can be; a leading slash stays."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda out, p: F.when((p == "..") & (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when((p == "..") & absolute, out).otherwise(F.concat(out, F.array(p)))
    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def join(*parts: Column) -> Column:
    return normalize(F.concat_ws("/", *[F.when(p != "", p) for p in parts]))


def base_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def directory(path: Column) -> Column:
    """Up to the last part; . without one."""
    d = F.regexp_extract(F.rtrim(path, F.lit("/")), "^(.*)/[^/]*$", 1)
    return F.when(path.rlike("^/+[^/]*/*$"), "/").when(d == "", ".").otherwise(d)


def extension(path: Column) -> Column:
    """With its dot; empty for names that only start with one."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def text_fragment(url: Column, text: Column) -> Column:
    """The URL with a fragment that points at a text."""
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#:~:text="), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")))


def ease(kind: str, t: Column) -> Column:
    """Curves from 0 to 1: linear, quad, cubic, quart, sine, expo, circ, with _in, _out or _in_out."""
    name, _, way = kind.partition("_")
    powers = {"quad": 2, "cubic": 3, "quart": 4, "quint": 5}
    if name == "linear":
        return t
    if name in powers:
        f = lambda x: F.pow(x, F.lit(powers[name]))
    elif name == "sine":
        f = lambda x: 1 - F.cos(x * F.lit(3.141592653589793) / 2)
    elif name == "expo":
        f = lambda x: F.when(x == 0, 0.0).otherwise(F.pow(F.lit(2.0), 10 * x - 10))
    elif name == "circ":
        f = lambda x: 1 - F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))
    else:
        raise ValueError(kind)
    if way == "in":
        return f(t)
    if way == "out":
        return 1 - f(1 - t)
    if way == "in_out":
        return F.when(t < 0.5, f(2 * t) / 2).otherwise(1 - f(2 - 2 * t) / 2)
    raise ValueError(kind)


def in_rollout(flag: str, user: Column, percent: float, only: Sequence[str] = ()) -> Column:
    """Whether a flag is on for a user: named users always, others by a hash against the share in per cent."""
    at = F.pmod(F.crc32(F.concat(F.lit(flag + ":"), user.cast("string")).cast("binary")), F.lit(10_000))
    return user.cast("string").isin(*only) | (at < percent * 100) if only else at < percent * 100


def rule_effect(rules: Sequence[tuple[str, Mapping[str, object]]], default: str = "deny") -> Column:
    """allow or deny by attribute rules (effect, column -> value or list of values); a deny that fits wins over allows."""

    def fits(conditions: Mapping[str, object]) -> Column:
        tests = [F.coalesce(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v), F.lit(False)) for c, v in conditions.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    any_of = lambda effect: reduce(lambda a, b: a | b, [fits(c) for e, c in rules if e == effect], F.lit(False))
    return F.when(any_of("deny"), "deny").when(any_of("allow"), "allow").otherwise(default)
