"""Queries of the statistics, sketches and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import sketches
from .base import Tables, query


def _r(c, digits: int = 4):
    return F.round(c, digits)


@query("SELECT l_returnflag, round(var_samp(l_quantity), 4) AS var_s, round(var_pop(l_quantity), 4) AS var_p, round(stddev_samp(l_quantity), 4) AS sd_s, round(stddev_pop(l_quantity), 4) AS sd_p, round(avg(l_quantity), 4) AS mean, max(l_quantity) - min(l_quantity) AS range FROM lineitem GROUP BY 1")
def stat_spread(t: Tables):
    c = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(_r(agg.variance(c)).alias("var_s"), _r(agg.variance(c, True)).alias("var_p"), _r(agg.stddev(c)).alias("sd_s"), _r(agg.stddev(c, True)).alias("sd_p"), _r(F.avg(c)).alias("mean"), agg.value_range(c).alias("range"))


_MOMENTS = "(SELECT avg(x) AS m, count(*)::DOUBLE AS n FROM (SELECT value AS x FROM events))"


@query(f"SELECT round(m3 / pow(m2, 1.5), 4) AS g1, round(m3 / pow(m2, 1.5) * n * n / ((n - 1) * (n - 2)), 4) AS adjusted, round(m4 / (m2 * m2) - 3, 4) AS kurtosis FROM (SELECT any_value(n) AS n, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM events, {_MOMENTS})")
def stat_shape(t):
    return t.events.agg(_r(agg.skewness("value")).alias("g1"), _r(agg.skewness_adjusted("value")).alias("adjusted"), _r(agg.kurtosis("value")).alias("kurtosis"))


@query("WITH c AS (SELECT l_quantity AS mode, count(*) AS count FROM lineitem GROUP BY 1) SELECT * FROM c WHERE count = (SELECT max(count) FROM c) ORDER BY mode")
def stat_modes(t):
    return agg.modes(t.lineitem, "l_quantity")


@query("SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def stat_quantiles(t):
    c = "l_extendedprice"
    g = t.lineitem.groupBy("l_linestatus").agg(agg.quartiles(c).alias("q"), _r(agg.iqr(c)).alias("iqr"), _r(agg.percentile(c, 90)).alias("p90"))
    return g.select("l_linestatus", *[_r(F.col(f"q.{x}")).alias(x) for x in ("q1", "q2", "q3")], "iqr", "p90")


@query("SELECT round(100 * avg(CASE WHEN value <= 42 THEN 1.0 ELSE 0.0 END), 4) AS rank FROM events")
def stat_percentile_rank(t):
    return t.events.agg(_r(agg.percentile_rank("value", 42)).alias("rank"))


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = greatest(1, ceil(n * 0.95))")
def stat_nearest_rank(t):
    return agg.nearest_rank(t.events, "value", 0.95, "event_type")


@query("SELECT event_id, round((value - m) / s, 4) AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type)")
def stat_z_scores(t):
    rows = agg.with_moments(t.events, "value", "event_type")
    return rows.select("event_id", _r(agg.z_score(F.col("value"), F.col("mean"), F.col("sd"))).alias("z"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def stat_min_max(t):
    return agg.min_max_scaled(t.part, "p_retailprice").select("p_partkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events GROUP BY event_type")
def stat_summary(t):
    s = agg.summarize(t.events, "value", "event_type")
    return s.select("event_type", "count", "min", "max", *[_r(c).alias(c) for c in ("mean", "median", "std", "q1", "q3", "iqr")])


_FENCE = "(SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)"


@query(f"SELECT o_orderkey FROM orders, {_FENCE} WHERE o_totalprice NOT BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a)")
def stat_outliers(t):
    return agg.outliers(t.orders, "o_totalprice", 0.3).select("o_orderkey")


@query(f"SELECT count(*) AS n FROM orders, {_FENCE} WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def stat_without_outliers(t):
    return agg.outliers(t.orders, "o_totalprice", keep=True).agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM events), c AS (SELECT least(floor((value - lo) / w), 11)::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY 1) SELECT range::INTEGER AS bin, round(lo + range * w, 4) AS lower, round(lo + range * w + w, 4) AS upper, coalesce(n, 0) AS count FROM range(0, 12) CROSS JOIN b LEFT JOIN c ON range = bin")
def stat_histogram(t):
    return agg.histogram(t.events, "value", 12).select("bin", _r("lower").alias("lower"), _r("upper").alias("upper"), "count")


@query("SELECT l_discount, count(*) AS count FROM lineitem GROUP BY 1")
def stat_frequency(t):
    return agg.frequency(t.lineitem, "l_discount")


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS cov_s, round(covar_pop(l_quantity, l_extendedprice), 2) AS cov_p, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def stat_regression(t):
    x, y = "l_quantity", "l_extendedprice"
    a = t.lineitem.agg(agg.covariance(x, y).alias("cov_s"), agg.covariance(x, y, True).alias("cov_p"), agg.pearson(x, y).alias("r"), *agg.linear_regression(x, y))
    return a.select(F.round("cov_s", 2).alias("cov_s"), F.round("cov_p", 2).alias("cov_p"), F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS spearman FROM r")
def stat_spearman(t):
    return agg.spearman(t.part, "p_size", "p_retailprice").select(F.round("spearman", 6).alias("spearman"))


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT CASE WHEN regr_slope(value, i) > 1e-10 THEN 'increasing' WHEN regr_slope(value, i) < -1e-10 THEN 'decreasing' ELSE 'flat' END AS trend FROM r")
def stat_trend(t):
    return agg.trend(t.events, "value", "event_id")


@query("SELECT position, step, n AS count, round(100.0 * n / first, 4) AS percent FROM (SELECT 0 AS position, 'view' AS step, count(*) FILTER (WHERE event_type = 'view') AS n, count(*) FILTER (WHERE event_type = 'view') AS first FROM events UNION ALL SELECT 1, 'click', count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'view') FROM events UNION ALL SELECT 2, 'purchase', count(*) FILTER (WHERE event_type = 'purchase'), count(*) FILTER (WHERE event_type = 'view') FROM events)")
def stat_funnel(t):
    return agg.funnel(t.events, "event_type", ["view", "click", "purchase"]).select("position", "step", "count", _r("percent").alias("percent"))


@query("SELECT event_id, round(exp(-pow((value - 50) / 20, 2) / 2) / (20 * sqrt(2 * pi())), 8) AS pdf FROM events")
def stat_normal_pdf(t):
    return t.events.select("event_id", F.round(agg.normal_pdf(F.col("value"), 50, 20), 8).alias("pdf"))


@query()
def stat_normal_cdf(t):
    return t.events.select("event_id", F.round(agg.normal_cdf(F.col("value"), 50, 20), 6).alias("cdf"))


@query()
def stat_bootstrap(t):
    return agg.bootstrap_interval(t.events, "value", 100)


@query("WITH s AS (SELECT 1 / (1 + exp(-(value - 50) / 20)) AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, value FROM events) SELECT round(avg(pow(p - y, 2)), 6) AS mse, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss, round(avg(greatest(value - 50, 0)), 6) AS relu FROM s")
def stat_losses(t):
    rows = t.events.select(agg.sigmoid((F.col("value") - 50) / 20).alias("p"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"), agg.relu(F.col("value") - 50).alias("u"))
    return rows.agg(F.round(agg.mse("p", "y"), 6).alias("mse"), F.round(agg.cross_entropy("p", "y", None), 6).alias("loss"), F.round(F.avg("u"), 6).alias("relu"))


@query()
def ab_assignment(t):
    users = t.events.select("user_id").distinct()
    return users.select("user_id", agg.ab_variant("checkout", F.col("user_id"), [("a", 50), ("b", 30), ("c", 20)]).alias("variant"))


@query()
def sketch_distinct(t):
    """Sketches of parts of the data, merged: within a few per cent of the exact count."""
    parts = t.events.groupBy("event_type").agg(sketches.distinct_sketch("user_id").alias("s"))
    return parts.agg(sketches.merged_distinct("s").alias("estimate"))


@query()
def sketch_count_min(t):
    table = sketches.count_min_table(t.events, "user_id")
    return sketches.count_min_lookup(t.events.select("user_id").distinct(), table, "user_id")


@query()
def sketch_bloom(t):
    bloom = sketches.bloom_table(t.orders.select("o_custkey"), "o_custkey", 2000)
    return sketches.bloom_has(t.customer.select(F.col("c_custkey").alias("o_custkey")), bloom, "o_custkey", 2000)


@query("SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, user_id LIMIT 10")
def sketch_top_items(t):
    return sketches.top_items(t.events, "user_id", 10)


@query()
def sample_reservoir(t):
    return sketches.reservoir(t.events.select("event_id", "value"), 100, 7, "event_id")


@query()
def sample_weighted(t):
    return sketches.weighted_reservoir(t.events.select("event_id", "value"), "value", 100, 7, "event_id")


@query()
def hash_ring(t):
    return t.customer.select("c_custkey", sketches.ring_node(F.col("c_custkey"), ["n1", "n2", "n3", "n4"], 16).alias("node"))


@query()
def hash_rendezvous(t):
    return t.customer.select("c_custkey", sketches.rendezvous_node(F.col("c_custkey"), ["n1", "n2", "n3", "n4"]).alias("node"))


@query()
def merkle_root(t):
    root = sketches.merkle_root(t.region, "r_name", "r_regionkey")
    return t.spark.createDataFrame([(root,)], "root string")
