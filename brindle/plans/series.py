"""Queries of windows over series, streams' windows, limiters and event folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..streaming import limiters
from ..streaming import windows as stream
from .base import Tables, query

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_BY, _ORD = ["user_id"], ["ts", "event_id"]


@query(f"SELECT event_id, round(v, 4) AS sma FROM (SELECT event_id, avg(value) OVER ({_W} ROWS 4 PRECEDING) AS v, row_number() OVER ({_W}) AS n FROM events) WHERE n >= 5")
def series_sma(t: Tables):
    return windows.sma(t.events, "value", 5, _BY, _ORD).select("event_id", F.round("sma", 4).alias("sma"))


@query(f"SELECT event_id, round((4 * value + 3 * lag(value, 1) OVER w + 2 * lag(value, 2) OVER w + lag(value, 3) OVER w) / 10, 4) AS wma FROM events WINDOW w AS ({_W}) QUALIFY row_number() OVER w >= 4")
def series_wma(t):
    return windows.wma(t.events, "value", 4, _BY, _ORD).select("event_id", F.round("wma", 4).alias("wma"))


@query(f"SELECT event_id, floor(avg(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) * 1000 + 0.0001)::BIGINT AS cma, round(sum(value) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def series_cumulative(t):
    return t.events.select("event_id", F.floor(windows.cma("value", _BY, _ORD) * 1000 + 0.0001).alias("cma"), F.round(windows.cumsum("value", _BY, _ORD), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events")
def series_running_total(t):
    """Over one series without a key, in parallel ranges."""
    return windows.cumulative(t.events.select("event_id", "value"), "value", "event_id").select("event_id", F.round("running", 3).alias("running"))


@query(f"SELECT event_id, round(stddev_pop(value) OVER ({_W} ROWS 5 PRECEDING), 4) AS std FROM events QUALIFY row_number() OVER ({_W}) >= 6")
def series_rolling_std(t):
    return windows.rolling_std(t.events, "value", 6, _BY, _ORD).select("event_id", F.round("std", 4).alias("std"))


@query(f"SELECT event_id, round(m, 4) AS middle, round(m + 2 * s, 4) AS upper, round(m - 2 * s, 4) AS lower FROM (SELECT event_id, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, row_number() OVER ({_W}) AS n FROM events WINDOW w AS ({_W} ROWS 9 PRECEDING)) WHERE n >= 10")
def series_bollinger(t):
    b = windows.bollinger(t.events, "value", 10, _BY, _ORD)
    return b.select("event_id", *[F.round(c, 4).alias(c) for c in ("middle", "upper", "lower")])


_ORDERED = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_ORDERED}), f AS (SELECT user_id, event_id, i, value AS ema FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, 0.25 * e.value + 0.75 * f.ema FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, round(ema + 0.0000001, 4) AS ema FROM f")
def series_ema(t):
    return windows.ema(t.events, "value", 0.25, _BY, _ORD).select("event_id", F.round(F.col("ema") + 0.0000001, 4).alias("ema"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_ORDERED}), f AS (SELECT user_id, event_id, i, value AS a, value AS b, 0.0::DOUBLE AS s FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, a, b, 0.2 * (a - b) + 0.8 * s FROM (SELECT e.user_id, e.event_id, e.i, f.a * (1 - 2.0 / 13) + e.value * 2.0 / 13 AS a, f.b * (1 - 2.0 / 27) + e.value * 2.0 / 27 AS b, f.s AS s FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)) SELECT event_id, round(a - b, 4) AS macd, round(s, 4) AS signal, round(a - b - s, 4) AS histogram FROM f")
def series_macd(t):
    return windows.macd(t.events, "value", _BY, _ORD).select("event_id", *[F.round(c, 4).alias(c) for c in ("macd", "signal", "histogram")])


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_ORDERED}), f AS (SELECT user_id, event_id, i, value AS last, 0 AS n, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, value, n, CASE WHEN n <= 14 THEN g + greatest(d, 0) / 14 ELSE (g * 13 + greatest(d, 0)) / 14 END, CASE WHEN n <= 14 THEN l + greatest(-d, 0) / 14 ELSE (l * 13 + greatest(-d, 0)) / 14 END FROM (SELECT e.user_id, e.event_id, e.i, e.value, f.n + 1 AS n, f.g, f.l, e.value - f.last AS d FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)) SELECT event_id, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM f WHERE n >= 14")
def series_rsi(t):
    return windows.rsi(t.events, "value", _BY, _ORD).select("event_id", F.round("rsi", 4).alias("rsi"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_ORDERED}), f AS (SELECT user_id, event_id, i, value AS x, 2.0 / 3.0 AS p FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, f.x + (f.p + 1) / (f.p + 2) * (e.value - f.x), (1 - (f.p + 1) / (f.p + 2)) * (f.p + 1) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, round(x + 0.0000001, 4) AS estimate FROM f")
def series_kalman(t):
    return windows.kalman(t.events, "value", _BY, _ORD).select("event_id", F.round(F.col("estimate") + 0.0000001, 4).alias("estimate"))


@query("SELECT user_id, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(value) AS count FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-17' GROUP BY 1")
def series_slice_stats(t):
    from datetime import datetime

    s = windows.series_stats(windows.series_slice(t.events, "ts", datetime(2024, 1, 3), datetime(2024, 1, 17)), "value", "user_id")
    return s.select("user_id", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count")


_POINTS = "(SELECT user_id, epoch_us(ts) // 1000000 AS s, avg(value) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH p AS {_POINTS}, g AS (SELECT user_id, unnest(range(min(s), max(s) + 1, 21600)) AS s FROM p GROUP BY 1),
a AS (SELECT g.user_id, g.s, p.s AS s0, p.value AS v0 FROM g ASOF JOIN p ON g.user_id = p.user_id AND g.s >= p.s),
b AS (SELECT a.*, p.s AS s1, p.value AS v1 FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.s <= p.s)
SELECT user_id, s, round(CASE WHEN s0 = s OR s1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (s - s0) / (s1 - s0) END, 4) AS value FROM b""")
def series_resample(t):
    """A grid of six hours, linear between the points."""
    points = t.events.groupBy("user_id", F.floor(stream.micros("ts") / 1000000).alias("s")).agg(F.avg("value").alias("value"))
    return windows.resample(points, "s", "value", 21600, _BY).select("user_id", "s", F.round("value", 4).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(t):
    return stream.tumbling(t.events, "ts", "1 day", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))


@query("SELECT s AS start, s + INTERVAL 12 HOUR AS end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL")
def window_sliding(t):
    return stream.sliding(t.events, "ts", "12 hours", "6 hours", F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def window_session(t):
    return stream.sessions(t.events, "ts", "2 hours", F.count(F.lit(1)).alias("n"), by=("user_id",))


@query("SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n IS NULL OR n - ts > INTERVAL 1 HOUR")
def stream_debounce(t):
    return stream.debounced(t.events, "ts", 3600, "user_id").select("event_id")


@query("SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id, epoch_us(ts) // 3600000000")
def stream_throttle(t):
    return stream.throttled_marks(t.events, "ts", 3600, "user_id").select("user_id", "ts")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def stream_sliding_count(t):
    return stream.rate_in_window(t.events, "ts", 86400, "user_id").select("event_id", "in_window")


def _limited(t, make):
    rows = t.events.select("event_id", "user_id", "ts")
    return limiters.limit(rows, "ts", "user_id", make, "event_id").select("event_id", "admitted")


_TIMES = "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_NEXT = "FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1"


@query(f"{_TIMES}, f AS (SELECT user_id, event_id, i, s, 2.0::DOUBLE AS t, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, s, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (SELECT e.user_id, e.event_id, e.i, e.s, least(3, f.t + (e.s - f.s) * (1 / 3600.0::DOUBLE)) AS t {_NEXT})) SELECT event_id, admitted FROM f")
def limit_token_bucket(t):
    return _limited(t, lambda: limiters.TokenBucket(3, 1 / 3600))


@query(f"{_TIMES}, f AS (SELECT user_id, event_id, i, s AS since, 2 AS t, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, since + n * 3600, CASE WHEN least(3, t + n) >= 1 THEN least(3, t + n) - 1 ELSE 0 END, least(3, t + n) >= 1 FROM (SELECT e.user_id, e.event_id, e.i, f.since, f.t, floor((e.s - f.since) / 3600)::INTEGER AS n {_NEXT})) SELECT event_id, admitted FROM f")
def limit_discrete_bucket(t):
    return _limited(t, lambda: limiters.DiscreteBucket(3, 1, 3600))


@query(f"{_TIMES}, f AS (SELECT user_id, event_id, i, [s] AS log, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, CASE WHEN len(kept) < 2 THEN list_append(kept, s) ELSE kept END, len(kept) < 2 FROM (SELECT e.user_id, e.event_id, e.i, e.s, list_filter(f.log, lambda x: x > e.s - 7200) AS kept {_NEXT})) SELECT event_id, admitted FROM f")
def limit_sliding_log(t):
    return _limited(t, lambda: limiters.SlidingLog(2, 7200))


@query("WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, event_id, i, s AS start, 1 AS n, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - f.start >= 7200 THEN e.s ELSE f.start END, CASE WHEN e.s - f.start >= 7200 THEN 1 ELSE f.n + 1 END, e.s - f.start >= 7200 OR f.n < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, admitted FROM f")
def limit_fixed_window(t):
    return _limited(t, lambda: limiters.FixedWindow(2, 7200))


@query(f"{_TIMES}, f AS (SELECT user_id, event_id, i, s, 1.0::DOUBLE AS level, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, s, CASE WHEN level < 3 THEN level + 1 ELSE level END, level < 3 FROM (SELECT e.user_id, e.event_id, e.i, e.s, greatest(0, f.level - (e.s - f.s) * (1 / 3600.0::DOUBLE)) AS level {_NEXT})) SELECT event_id, admitted FROM f")
def limit_leaky_bucket(t):
    return _limited(t, lambda: limiters.LeakyBucket(3, 1 / 3600))


@query("SELECT user_id, max(v) AS version, count(*) AS events, arg_max(event_type, v) AS event_type, arg_max(value, v) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) GROUP BY user_id")
def events_replay(t):
    rows = limiters.with_versions(t.events, "user_id", "ts", "event_id")
    return limiters.replay(rows, "user_id", "version", "event_type", "value").withColumn("version", F.col("version").cast("long"))


@query("SELECT k AS key, arg_max(value, (ts, dead, event_id)) AS value FROM (SELECT user_id % 50 AS k, event_type = 'error' AS dead, * FROM events) GROUP BY k HAVING NOT arg_max(dead, (ts, dead, event_id))")
def crdt_last_writer(t):
    """Entries of two replicas; an error is a tombstone."""
    rows = t.events.selectExpr("user_id % 50 as key", "value", "ts as timestamp", "event_type = 'error' as tombstone", "event_id")
    a, b = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return limiters.merge_last_writer(a, b, tie="event_id").select("key", "value")


@query("SELECT CAST(sum(u) - sum(d) AS BIGINT) AS value FROM (SELECT user_id, max(event_id) AS u, max(event_id // 2) AS d FROM events GROUP BY 1)")
def crdt_counter(t):
    rows = t.events.selectExpr("user_id as node", "event_id as up", "event_id div 2 as down")
    return limiters.counter_value(rows, "node", "up", "down")
