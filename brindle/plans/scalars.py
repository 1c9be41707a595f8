"""Queries of the scalar functions: strings, text, dates, numbers, JSON, encodings, URLs, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, encoding, expressions, maths, phonetic, similarity, strings, text, urls
from ..sources import documents
from .base import Tables, query


@query("SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS capital, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:9] || '...' END AS short, lpad(p_partkey::VARCHAR, greatest(length(p_partkey::VARCHAR), 6)::INTEGER, '0') AS padded, reverse(p_name) AS backwards, (length(p_name) - length(replace(p_name, 'a', '')))::INTEGER AS letters, replace(p_name, ' ', '-') AS kebab FROM part")
def str_basic(t: Tables):
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.capitalize(n).alias("capital"), strings.truncate(n, 12).alias("short"), strings.pad_start(F.col("p_partkey").cast("string"), 6, "0").alias("padded"), F.reverse(n).alias("backwards"), strings.count_occurrences(n, "a").alias("letters"), F.replace(n, F.lit(" "), F.lit("-")).alias("kebab"))


@query("SELECT c_custkey, lower(c_name[1]) || regexp_replace(c_name[2:], '[^A-Za-z0-9]+', '', 'g') AS camel, upper(c_name[1]) || regexp_replace(c_name[2:], '[^A-Za-z0-9]+', '', 'g') AS pascal, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS snake, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS kebab, upper(c_name[1]) || lower(c_name[2:]) AS title, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS slug FROM customer")
def str_cases(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", strings.camel_case(n).alias("camel"), strings.pascal_case(n).alias("pascal"), strings.snake_case(n).alias("snake"), strings.kebab_case(n).alias("kebab"), strings.title_case(n).alias("title"), strings.slugify(n).alias("slug"))


@query("SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def str_html(t):
    return t.pages.select("page_id", strings.escape_html(strings.strip_html(F.col("html"))).alias("escaped"))


@query("SELECT page_id, md5(html) = md5(html) AS same FROM pages")
def str_html_round_trip(t):
    return t.pages.select("page_id", (strings.unescape_html(strings.escape_html(F.col("html"))) == F.col("html")).alias("same"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS edits, round(CASE WHEN greatest(length(a.n_name), length(b.n_name)) = 0 THEN 1 ELSE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS ratio, round(len(list_intersect(string_split(a.n_name, ''), string_split(b.n_name, ''))) / len(list_distinct(list_concat(string_split(a.n_name, ''), string_split(b.n_name, '')))), 6) AS jaccard FROM nation a, nation b")
def str_distances(t):
    pairs = t.nation.selectExpr("n_nationkey as a", "n_name as x").crossJoin(t.nation.selectExpr("n_nationkey as b", "n_name as y"))
    x, y = F.col("x"), F.col("y")
    return pairs.select("a", "b", F.levenshtein(x, y).cast("long").alias("edits"), F.round(strings.similarity_ratio(x, y), 6).alias("ratio"), F.round(strings.jaccard_characters(x, y), 6).alias("jaccard"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, damerau_levenshtein(a.n_name, b.n_name) AS swaps, round(jaro_similarity(a.n_name, b.n_name), 6) AS jaro FROM nation a, nation b")
def str_distances_udf(t):
    pairs = t.nation.selectExpr("n_nationkey as a", "n_name as x").crossJoin(t.nation.selectExpr("n_nationkey as b", "n_name as y"))
    return pairs.select("a", "b", similarity.damerau_levenshtein("x", "y").cast("long").alias("swaps"), F.round(similarity.jaro("x", "y"), 6).alias("jaro"))


@query()
def str_common(t):
    pairs = t.nation.selectExpr("n_nationkey as a", "n_name as x").crossJoin(t.region.selectExpr("r_regionkey as b", "r_name as y"))
    return pairs.select("a", "b", similarity.longest_common_subsequence("x", "y").alias("subsequence"), similarity.longest_common_substring("x", "y").alias("substring"), F.round(similarity.jaro_winkler("x", "y"), 6).alias("winkler"), F.round(similarity.cosine_characters("x", "y"), 6).alias("cosine"))


@query()
def str_phonetic(t):
    return t.nation.select("n_nationkey", *[f(F.col("n_name")).alias(n) for n, f in phonetic.CODES.items()])


@query("SELECT conv_id, turn, regexp_matches(text, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email, length(text) AS chars, len(regexp_extract_all(text, '[a-z]+')) AS runs FROM conversations")
def str_checks(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", strings.is_email(c).alias("email"), F.length(c).cast("long").alias("chars"), strings.count_matches(c, "[a-z]+").cast("long").alias("runs"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS mails, len(regexp_extract_all(text, '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}')) AS addresses FROM documents")
def pii_scan(t):
    c = F.col("text")
    return t.documents.select("doc_id", strings.count_matches(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").cast("long").alias("mails"), strings.count_matches(c, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}").cast("long").alias("addresses"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '*', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '*', 'g')) AS redacted FROM documents")
def pii_redact(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
    return t.documents.select("doc_id", F.md5(strings.redact(F.col("text"), kinds).cast("binary")).alias("redacted"))


_SENTENCES = "len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' \\n\\t\\r')), lambda x: x <> ''))"


@query(f"SELECT doc_id, {_SENTENCES} AS sentences, len(string_split(text, chr(10))) AS lines, length(text) AS chars FROM documents")
def text_counts(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.size(text.sentences(c)).cast("long").alias("sentences"), strings.line_count(c).cast("long").alias("lines"), F.length(c).cast("long").alias("chars"))


@query()
def text_readability(t):
    c = F.col("text")
    rows = t.conversations
    return rows.select("conv_id", "turn", *[F.round(f(c), 4).alias(n) for n, f in (("ease", text.flesch_ease), ("grade", text.flesch_kincaid_grade), ("fog", text.gunning_fog), ("smog", text.smog), ("ari", text.automated_readability), ("cli", text.coleman_liau))])


@query("SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) GROUP BY 1 ORDER BY count DESC, word LIMIT 50")
def text_top_words(t):
    words = t.conversations.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(50)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate + INTERVAL 1 MONTH AS month_later, o_orderdate + INTERVAL 36 HOUR AS later, date_trunc('month', o_orderdate)::TIMESTAMP AS month, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1998-06-15')) AS ms, abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1998-06-15 12:00:00')) // 86400000 AS days, day(last_day(o_orderdate)) AS month_days, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS week, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders")
def date_basic(t):
    d, fix = F.col("o_orderdate"), F.lit("1998-06-15 12:00:00").cast("timestamp")
    ms = F.unix_millis(d) - F.unix_millis(F.lit("1998-06-15").cast("timestamp"))
    return _ntz(t).select(
        "o_orderkey", dates.format_date(d, "YYYY-MM-DD").alias("day"), _plain(dates.add_months_clamped(d, 1)).alias("month_later"), _plain(dates.add_hours(d, 36)).alias("later"), _plain(dates.start_of(d, "month")).alias("month"), ms.alias("ms"), dates.diff_in_days(d, fix).alias("days"),
        dates.days_in_month(d).cast("long").alias("month_days"), F.dayofyear(d).cast("long").alias("doy"), dates.iso_week(d).cast("long").alias("week"), dates.is_weekend(d).alias("weekend"),
    )


def _plain(ts):
    """Without a zone, as the tables have it."""
    return ts.cast("timestamp_ntz")


def _ntz(t):
    """Orders with their date as a timestamp of the session's zone, which is UTC."""
    return t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)::TIMESTAMP) AS rolled FROM orders")
def date_rollover(t):
    return _ntz(t).select("o_orderkey", _plain(dates.add_months_rolled(F.col("o_orderdate"), 1)).alias("rolled"))


@query("SELECT n_nationkey, len(range(TIMESTAMP '2024-01-31', TIMESTAMP '2024-01-31' + INTERVAL (n_nationkey) DAY + INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS days FROM nation")
def date_ranges(t):
    start = F.lit("2024-01-31").cast("timestamp")
    return t.nation.select("n_nationkey", F.size(dates.date_range(start, dates.add_days(start, F.col("n_nationkey")))).cast("long").alias("days"))


@query("SELECT event_id FROM events WHERE minute(ts) IN (0, 15, 30, 45) AND hour(ts) BETWEEN 8 AND 18 AND dayofweek(ts) BETWEEN 1 AND 5")
def date_cron(t):
    return t.events.where(dates.matches_cron("*/15 8-18 * * 1-5", F.col("ts"))).select("event_id")


@query("SELECT event_id, trim((CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || 'd ' ELSE '' END) || (CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600)::VARCHAR || 'h ' ELSE '' END) || (CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60)::VARCHAR || 'm ' ELSE '' END) || (CASE WHEN s % 60 > 0 THEN (s % 60)::VARCHAR || 's' ELSE '' END)) AS duration, s * 1000 AS ms FROM (SELECT event_id, event_id * 977 % 400000 + 1 AS s FROM events)")
def date_durations(t):
    text_ = dates.format_duration((F.col("event_id") * 977 % 400000 + 1) * 1000)
    return t.events.select("event_id", text_.alias("duration"), dates.parse_duration(text_).alias("ms"))


@query("SELECT p_partkey, least(greatest(p_size, 10), 40) AS clamped, floor(p_retailprice * 10 + 0.5) / 10 AS rounded, gcd(p_partkey, 360) AS g, lcm(p_partkey, 6) AS l, bit_count(p_partkey) = 1 AS power, round(10 + (p_size - 1) * 90.0 / 49, 6) AS mapped FROM part")
def math_basic(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", maths.clamp(F.col("p_size"), 10, 40).alias("clamped"), maths.round_to(F.col("p_retailprice"), 1).alias("rounded"), maths.gcd(k, F.lit(360)).alias("g"), maths.lcm(k, F.lit(6)).alias("l"), maths.is_power_of_two(k).alias("power"), F.round(maths.map_range(F.col("p_size"), 1, 50, 10, 100), 6).alias("mapped"))


@query("SELECT n FROM range(2, 2001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(d) WHERE d < n AND n % d = 0)")
def math_primes(t):
    return maths.primes_up_to(t.spark, 2000)


@query()
def math_numbers(t):
    n = F.col("n_nationkey") + 1
    return t.nation.select("n_nationkey", maths.to_roman(n * 79).alias("roman"), maths.from_roman(maths.to_roman(n * 79)).alias("back"), maths.choose(F.lit(30), n).cast("long").alias("choose"), maths.prime_factors(n * 84).alias("factors"), maths.ordinal(n).alias("ordinal"), maths.format_compact(n * 123456).alias("compact"), maths.format_bytes(n * 98765).alias("bytes"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(list_distance(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.1::DOUBLE)), 5) AS distance FROM embeddings")
def math_vectors(t):
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(maths.dot(v, v), 5).alias("dot"), F.round(maths.norm(v), 5).alias("norm"), F.round(maths.euclidean(v, F.array_repeat(F.lit(0.1), 64)), 5).alias("distance"))


@query("WITH a AS (SELECT l_linenumber AS row, l_suppkey % 5 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) SELECT x.row, y.row AS col, round(sum(x.value * y.value), 2) AS value FROM a x JOIN a y ON x.col = y.col GROUP BY 1, 2")
def math_matrix_product(t):
    a = t.lineitem.groupBy(F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 5).alias("col")).agg(F.sum("l_quantity").alias("value"))
    return maths.matrix_multiply(a, maths.matrix_transpose(a)).withColumn("value", F.round("value", 2))


@query("SELECT p_partkey, round((p_size + 2) * 3 - p_retailprice / 10, 4) AS a, round(pow(p_size, 2) % 7, 4) AS b, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c, round(greatest(p_size, 20) + sqrt(p_size), 4) AS d FROM part")
def expr_compiled(t):
    """Expressions from text, run as plain Spark expressions."""
    names = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    e = lambda s: expressions.compile_expression(s, names)
    return t.part.select("p_partkey", F.round(e("(size + 2) * 3 - price / 10"), 4).alias("a"), F.round(e("size ^ 2 % 7"), 4).alias("b"), e('if(size > 25, "big", "small")').alias("c"), F.round(e("max(size, 20) + sqrt(size)"), 4).alias("d"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount, 4) AS total, round((l_quantity + l_extendedprice) / 2, 4) AS mean FROM lineitem")
def expr_formula(t):
    cells = {"A1": F.col("l_quantity"), "B1": F.col("l_extendedprice"), "C1": F.col("l_discount")}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(expressions.compile_formula("=SUM(A1:C1)", cells), 4).alias("total"), F.round(expressions.compile_formula("=AVERAGE(A1,B1)", cells), 4).alias("mean"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_get(t):
    return t.events.select("event_id", arrays.json_get(F.col("props"), "k").alias("k"), arrays.is_valid_json(F.col("props")).alias("valid"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":{\"id\":' || event_id::VARCHAR || '}}' AS merged FROM events")
def json_merge(t):
    extra = F.concat(F.lit('{"n":{"id":'), F.col("event_id").cast("string"), F.lit("}}"))
    return t.events.select("event_id", arrays.json_merge("props", extra).alias("merged"))


@query("SELECT event_id, '{\"n.id\":' || event_id::VARCHAR || ',\"n.tags.0\":\"a\"}' AS flat FROM events")
def json_flatten(t):
    nested = F.concat(F.lit('{"n":{"id":'), F.col("event_id").cast("string"), F.lit(',"tags":["a"]}}'))
    return t.events.select("event_id", arrays.json_flatten(nested).alias("flat"))


@query("SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, lower(hex(encode(p_name))) AS hex, to_base64(encode(p_name)) AS b64 FROM part")
def enc_digests(t):
    c = F.col("p_name")
    return t.part.select("p_partkey", encoding.md5(c).alias("md5"), encoding.sha1(c).alias("sha1"), encoding.sha256(c).alias("sha256"), encoding.to_hex(c).alias("hex"), encoding.to_base64(c).alias("b64"))


def _crc_sql(first: str, enter: str, bit: str) -> str:
    """A cyclic check of the bytes b: ``enter`` takes byte x into h, ``bit`` is one of its eight steps on a."""
    return f"list_reduce(b, lambda h, x: list_reduce(range(8), lambda a, k: {bit}, {enter}), {first}::BIGINT)"


_HASHES = f"""SELECT p_partkey, list_reduce(b, lambda h, x: (h * 33 + x) % 4294967296, 5381::BIGINT) AS h0, list_reduce(b, lambda h, x: (h * 65599 + x) % 4294967296, 0::BIGINT) AS h1,
list_reduce(b, lambda h, x: xor(h, x) * 16777619 % 4294967296, 2166136261::BIGINT) AS h2, ((n + later) % 65521 * 65536 + (1 + total) % 65521)::BIGINT AS h3, (later % 255 * 256 + total % 255)::INTEGER AS h4,
({_crc_sql("0", "xor(h, x)", "xor(a * 2 % 256, CASE WHEN a >= 128 THEN 7::BIGINT ELSE 0::BIGINT END)")})::INTEGER AS h5,
({_crc_sql("65535", "xor(h, x * 256)", "xor(a * 2 % 65536, CASE WHEN a >= 32768 THEN 4129::BIGINT ELSE 0::BIGINT END)")})::INTEGER AS h6,
xor({_crc_sql("4294967295", "xor(h, x)", "xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)")}, 4294967295::BIGINT) AS crc32
FROM (SELECT p_partkey, b, len(b) AS n, list_sum(b)::BIGINT AS total, list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x))::BIGINT AS later FROM (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT) AS b FROM part))"""


@query(_HASHES)
def enc_hashes(t):
    c = F.col("p_name")
    return t.part.select("p_partkey", *[f(c).alias(f"h{i}") for i, f in enumerate((encoding.djb2, encoding.sdbm, encoding.fnv1a32, encoding.adler32, encoding.fletcher16, encoding.crc8, encoding.crc16))], encoding.crc32(c).alias("crc32"))


@query("SELECT p_partkey, true AS base58, true AS base32, true AS rle, true AS lzw, true AS huffman FROM part")
def enc_round_trips(t):
    c = F.col("p_name")
    coded = t.part.select("p_partkey", "p_name", encoding.huffman_encode(c).alias("h"))
    return coded.select(
        "p_partkey", (encoding.from_base58(encoding.base58(c)) == c).alias("base58"), (encoding.from_base32(encoding.base32(c)) == c).alias("base32"),
        (encoding.rle_decode(encoding.rle_encode(F.regexp_replace(c, "[0-9]", "x"))) == F.regexp_replace(c, "[0-9]", "x")).alias("rle"), (encoding.lzw_decode(encoding.lzw_encode(c)) == c).alias("lzw"), (encoding.huffman_decode(F.col("h.bits"), F.col("h.codes")) == c).alias("huffman"),
    )


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parts(t):
    u = F.col("url")
    return t.pages.select("page_id", urls.part(u, "PROTOCOL").alias("protocol"), urls.part(u, "HOST").alias("host"), urls.part(u, "PATH").alias("path"), urls.part(u, "QUERY").alias("query"), urls.query_get(urls.part(u, "QUERY"), "page").alias("page"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_links(t):
    return t.pages.select("page_id", F.size(urls.links(F.col("html"))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def page_text(t):
    return t.pages.select("page_id", documents.html_text(F.col("html")).alias("text"), documents.html_headings(F.col("html")).alias("headings"))


@query("SELECT n_nationkey, to_json([x FOR x IN [3, 1, 2, 1, n_nationkey] IF x IN [1, 2]])::VARCHAR AS inter, to_json([x FOR x IN [3, 1, 2, 1, n_nationkey] IF x NOT IN [1, 2]])::VARCHAR AS diff, to_json([n_nationkey, 3, 1, 2, 1])::VARCHAR AS rotated FROM nation")
def arr_algebra(t):
    a = F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(1), F.col("n_nationkey"))
    b = F.array(F.lit(1), F.lit(2))
    return t.nation.select("n_nationkey", F.to_json(arrays.intersection(a, b)).alias("inter"), F.to_json(arrays.difference(a, b)).alias("diff"), F.to_json(arrays.rotate(a, 1)).alias("rotated"))


@query("""SELECT n AS n_nationkey, (CASE WHEN n = 7 THEN '[{"value":7,"count":3},' ELSE '[{"value":' || n || ',"count":2},{"value":7,"count":1},' END) || '{"value":' || r || ',"count":1}]' AS runs, to_json([n, n, 7, r])::VARCHAR AS back, to_json([n, 0, 7 - n, r - 7])::VARCHAR AS deltas, to_json([n, n, 7, r])::VARCHAR AS same, to_json([[n, n, 7], [r]])::VARCHAR AS chunks FROM (SELECT n_nationkey AS n, n_regionkey AS r FROM nation)""")
def arr_codecs(t):
    a = F.array(F.col("n_nationkey"), F.col("n_nationkey"), F.lit(7), F.col("n_regionkey"))
    return t.nation.select("n_nationkey", F.to_json(arrays.run_lengths(a)).alias("runs"), F.to_json(arrays.run_lengths_expand(arrays.run_lengths(a))).alias("back"), F.to_json(arrays.delta_encode(a)).alias("deltas"), F.to_json(arrays.delta_decode(arrays.delta_encode(a))).alias("same"), F.to_json(arrays.chunk(a, 3)).alias("chunks"))
