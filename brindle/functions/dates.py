"""Date and time scalars; months end as each name says, differences are elapsed time unless called calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000

# fixed values: tokens of the format patterns and their Spark letters
TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("D", "d"))


def pattern(p: str) -> str:
    """A pattern of tokens YYYY MM DD HH mm ss SSS as Spark writes it."""
    for token, letters in TOKENS:
        p = p.replace(token, letters)
    return p


def format_date(ts: Column, p: str) -> Column:
    return F.date_format(ts, pattern(p))


def parse_date(s: Column, p: str) -> Column:
    """Null where the text does not fit."""
    return F.try_to_timestamp(s, F.lit(pattern(p)))


def add_days(ts: Column, n: Column | int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(n) if isinstance(n, int) else n)


def add_hours(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(n))


def add_minutes(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(n))


def add_months_clamped(ts: Column, n: int) -> Column:
    """The last day of a shorter month, time of day kept."""
    return ts + F.make_ym_interval(months=F.lit(n))


def add_months_rolled(ts: Column, n: int) -> Column:
    """Days past a shorter month go over into the next: January 31 and a month is March 2 or 3."""
    first = F.date_trunc("month", ts) + F.make_ym_interval(months=F.lit(n))
    return first + (ts - F.date_trunc("month", ts))


def add_years_clamped(ts: Column, n: int) -> Column:
    return ts + F.make_ym_interval(years=F.lit(n))


def _millis(a: Column, b: Column) -> Column:
    return F.abs(F.unix_millis(a) - F.unix_millis(b))


def diff_in_days(a: Column, b: Column) -> Column:
    """Whole days of elapsed time, without sign."""
    return F.floor(_millis(a, b) / DAY)


def diff_in_hours(a: Column, b: Column) -> Column:
    return F.floor(_millis(a, b) / HOUR)


def diff_in_minutes(a: Column, b: Column) -> Column:
    return F.floor(_millis(a, b) / MINUTE)


def calendar_days(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def start_of(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def end_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def end_of_month(ts: Column) -> Column:
    return F.date_trunc("month", ts) + F.make_ym_interval(months=F.lit(1)) - F.expr("INTERVAL '0.001' SECOND")


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def is_same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def clamp(ts: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(ts, low), high)


def date_range(start: Column, end: Column, step: str = "day") -> Column:
    """Inclusive array of days, months or years; empty where the end is before the start."""
    one = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[step]
    return F.when(start <= end, F.sequence(start, end, F.expr(one))).otherwise(F.array().cast("array<timestamp>"))


def format_duration(ms: Column) -> Column:
    """'1d 2h 3m 4s', units of zero left out; '0s' for under a second."""
    s = F.floor(F.abs(ms) / 1000)
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(u))) for n, u in parts])
    return F.when(text == "", "0s").otherwise(text)


def parse_duration(s: Column) -> Column:
    """Milliseconds of a text like '1h 2m 3s' or '5ms'."""
    units = (("d", DAY), ("h", HOUR), ("m", MINUTE), ("s", 1000), ("ms", 1))
    one = lambda u: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, rf"(\d+)\s*{u}(?![a-z])", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0))
    return reduce(lambda a, b: a + b, (one(u) * n for u, n in units))


def relative(ts: Column, now: Column) -> Column:
    """'just now', 'n minutes ago' and so on up to years; 'in ...' for times ahead."""
    s = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 1000)
    n = F.abs(s)
    steps = ((60, 1, "second"), (3600, 60, "minute"), (86400, 3600, "hour"), (2592000, 86400, "day"), (31536000, 2592000, "month"), (None, 31536000, "year"))
    out = None
    for below, unit, name in steps:
        k = F.floor(n / unit).cast("long")
        text = F.concat(k.cast("string"), F.lit(f" {name}"), F.when(k == 1, "").otherwise("s"))
        phrase = F.when(s >= 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))
        if unit == 1:
            phrase = F.lit("just now")
        out = F.when(n < below, phrase) if out is None else out.when(n < below, phrase) if below else out.otherwise(phrase)
    return out


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron_fields(expression: str) -> tuple[set[int], ...]:
    """minute, hour, day of month, month, day of week (0 is Sunday, 7 too)."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    fields = [_field(p, lo, hi) for p, (lo, hi) in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)))]
    fields[4] = {d % 7 for d in fields[4]}
    return tuple(fields)


def matches_cron(expression: str, ts: Column) -> Column:
    """Where both day fields are given, either may match."""
    minute, hour, day, month, weekday = cron_fields(expression)
    dom, dow = (expression.split()[i] for i in (2, 4))
    on_day, on_weekday = F.dayofmonth(ts).isin(*day), (F.dayofweek(ts) - 1).isin(*weekday)
    days = on_day | on_weekday if dom != "*" and dow != "*" else on_day & on_weekday
    return F.minute(ts).isin(*minute) & F.hour(ts).isin(*hour) & F.month(ts).isin(*month) & days


def next_matches(expression: str, start, count: int = 1) -> list:
    """The next ``count`` minutes after ``start`` (a datetime) within four years."""
    from datetime import timedelta

    minute, hour, day, month, weekday = cron_fields(expression)
    dom, dow = (expression.split()[i] for i in (2, 4))
    out, d = [], start.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = start + timedelta(days=4 * 366)
    while d < end and len(out) < count:
        a, b = d.day in day, d.isoweekday() % 7 in weekday
        if d.month not in month or not (a or b if dom != "*" and dow != "*" else a and b):
            d = d.replace(hour=0, minute=0) + timedelta(days=1)
        elif d.hour not in hour:
            d = d.replace(minute=0) + timedelta(hours=1)
        else:
            if d.minute in minute:
                out.append(d)
            d += timedelta(minutes=1)
    return out
