"""SQL of the queries that DuckDB can express, on the same tables."""

from __future__ import annotations

_HOST = """
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""

_DOUBLE = "regexp_matches(last2, '^(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\\.[a-z]{2}$')"


def _rho(name: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(n, 0) = 0 OR k = 0 OR k = n OR n - nn / n - (g - 1) <= 0 THEN 1.0 ELSE
      1 / least(greatest(((kk - n * (k / n) * (k / n)) / ((k / n) * (1 - k / n)) - (g - 1)) / (n - nn / n - (g - 1)), 0.001), 0.9) - 1 END AS s
      FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn, sum(k * k / n::DOUBLE) AS kk FROM {name} WHERE n > 0))"""


OP1 = f"""
WITH urls AS ({_HOST}),
outcomes AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS k FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
hosts0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
hosts1 AS (SELECT *, string_split(host, '.') AS parts, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS last2 FROM hosts0),
hosts AS (SELECT host, n, k, CASE WHEN {_DOUBLE} THEN array_to_string(list_slice(parts, -3, -1), '.') ELSE last2 END AS domain,
                 CASE WHEN {_DOUBLE} THEN last2 ELSE parts[-1] END AS suffix FROM hosts1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
total AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS share FROM suffixes),
ss AS {_rho("suffixes")}, sd AS {_rho("domains")}, sh AS {_rho("hosts")},
s2 AS (SELECT suffix, (k + share * s) / (n + s) AS m FROM suffixes, total, ss),
d2 AS (SELECT domain, suffix, (domains.k + s2.m * s) / (domains.n + s) AS m FROM domains JOIN s2 USING (suffix), sd),
h2 AS (SELECT host, hosts.n AS n, (hosts.k + d2.m * s) / (hosts.n + s) AS m, s FROM hosts JOIN d2 USING (domain, suffix), sh),
ab AS (SELECT host, m, m * (n + s) AS a, (1 - m) * (n + s) AS b FROM h2),
grid AS (SELECT *, ln(a / b) AS mid, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS wide, unnest(range(0, 401)) AS i FROM ab),
odds AS (SELECT *, mid + wide * (0.04 * (i - 200)) AS u FROM grid),
weights AS (SELECT host, m, mid, wide, i, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - a * mid + (a + b) * (greatest(mid, 0) + ln(1 + exp(-abs(mid))))) AS w FROM odds),
sums AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS c, 0.05 * sum(w) OVER (PARTITION BY host) AS need FROM weights),
known AS (SELECT host, m AS mean, 1 / (1 + exp(-(mid + wide * (0.04 * (i + (need - c + w) / w - 200.5))))) AS bound FROM sums WHERE c >= need AND c - w < need),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM urls)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
                 ELSE CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END END AS verdict,
       round(mean, 6) AS mean, round(bound, 6) AS bound
FROM ruled JOIN known USING (host)
"""

OP9 = """
WITH sources AS (SELECT source AS src, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY 1),
rates AS (SELECT src, w / (SELECT sum(w) FROM sources) * (SELECT sum(n) FROM sources) / n AS rate FROM sources),
terms AS (SELECT src, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT)) AS k FROM rates)),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
lists AS (SELECT src, list(c ORDER BY k) AS cs FROM cdf GROUP BY src),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('brindle:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS m
  FROM documents d JOIN lists ON d.source IS NOT DISTINCT FROM src)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('brindle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, m)) AS copy FROM drawn)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT item, w, least(n, 13) AS k, unnest(range(0, n - least(n, 13) + 1)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, item, i, grams.k AS k FROM grams JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7 = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
bits AS (SELECT page_id, h, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(('0x' || c)::INTEGER), 4, '0')), '') AS b FROM rows),
digests AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(b, 5 * i + j + 1, 1)::INTEGER * (16 // (2 ** j)::INTEGER)))::INTEGER, 1)), '') AS d FROM bits)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM digests)
"""

SQL = {"op7_warc": OP7, "op1_url_reputation": OP1, "op8_decontaminate": OP8, "op9_mix": OP9}
