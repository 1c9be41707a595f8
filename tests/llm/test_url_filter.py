import math

from brindle.llm import queries, url_filter


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host.translate({c: c + 32 for c in range(65, 91)}), path[:stop]


def brute_rule(host, path):
    best = None
    for what, h, p in queries.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return best


URLS = ["http://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://net/", "http://net", "ftp://x.example.com/de/", "x.org/fr/", "http://a.org/fr/1", "http://a.org?/fr/", None, "", "http://", "http://ÄB.org/fr/", "a://b://c/d", "http://badexample.net/", "http://www.co.uk/x", "http://z.a.co.uk/#/en/"]


def table(spark, urls, outcomes):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, good string")
    return pages, spark.createDataFrame(outcomes, "page_id long, good int")


def test_parts_and_rules(spark):
    pages, outcomes = table(spark, URLS, [(0, 1), (1, 0), (3, None), (None, 1), (99, 1)])
    rows = {r.page_id: r for r in url_filter.judge(pages, outcomes, queries.RULES).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = brute_parts(u)
        assert (rows[i].host, rows[i].path) == (host, path)
        rule = brute_rule(host, path)
        assert rows[i].rule == (rule[1] if rule else None)
        assert rows[i].verdict == (rule[0] if rule else "allow" if rows[i].bound >= 0.5 else "block")


def test_shrinkage(spark):
    urls = [f"http://good{i % 4}.fine.info/{i}" for i in range(40)] + [f"http://bad{i % 4}.poor.info/{i}" for i in range(40)] + ["http://new.fine.info/", "http://new.poor.info/", "http://lone.biz/"]
    pages, outcomes = table(spark, urls, [(i, int(i < 40)) for i in range(80)])
    rows = [r for r in url_filter.judge(pages, outcomes, ()).orderBy("page_id").collect()]
    assert {r.verdict for r in rows[:40]} == {"allow"} and {r.verdict for r in rows[40:80]} == {"block"}
    # hosts without outcomes lean on their domain, and with none there on the rest
    assert rows[80].mean > 0.8 > 0.2 > rows[81].mean and rows[81].mean < rows[82].mean < rows[80].mean
    assert all(0 < r.mean < 1 and 0 <= r.bound <= 1 for r in rows)


def incomplete_beta(a, b, x, n=200_000):
    """The beta distribution function by the midpoint rule in log odds."""
    lo, hi = math.log(a / b) - 60 * (1 + 1 / a), math.log(x / (1 - x))
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    h = (hi - lo) / n
    return sum(math.exp(norm + a * u - (a + b) * (max(u, 0) + math.log1p(math.exp(-abs(u))))) for u in (lo + h * (i + 0.5) for i in range(n))) * h


def test_bound_is_the_quantile_of_the_posterior(spark):
    pages = spark.createDataFrame([(i, "h.d.s") for i in range(8)], "page_id long, host string")
    outcomes = spark.createDataFrame([(i, int(i < 6)) for i in range(8)], "page_id long, good int")
    r = url_filter.reputation(pages, outcomes).first()
    assert (r.n, r.k) == (8, 6)
    m = (6 + 0.5) / 9
    for _ in range(3):  # with one group at each level the strength is 1
        m = (6 + m) / 9
    assert math.isclose(r["mean"], m) and math.isclose(incomplete_beta(m * 9, (1 - m) * 9, r.bound), 0.05, abs_tol=1e-4)
    params = [(0.3, 0.2), (0.05, 2.0), (5.0, 0.5), (40.0, 60.0), (9000.0, 10.0)]
    rows = spark.createDataFrame(params, "a double, b double").select("a", "b", url_filter.beta_quantile("a", "b", 0.05).alias("q")).collect()
    for r in rows:
        assert 0 <= r.q < r.a / (r.a + r.b)
        assert r.q < 1e-12 or math.isclose(incomplete_beta(r.a, r.b, r.q), 0.05, abs_tol=1e-3)


def test_suffix_rules_as_data(spark):
    rules = spark.createDataFrame([("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("// a comment",), ("",), ("k12.ca.us",)], "rule string")
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.uk": ("x.uk", "uk"), "a.b.any.ck": ("b.any.ck", "any.ck"), "a.www.ck": ("www.ck", "ck"), "p.q.k12.ca.us": ("q.k12.ca.us", "k12.ca.us"), "z.other": ("z.other", "other"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.domain, r.suffix) for r in url_filter.with_suffixes(hosts, rules).collect()} == want


def test_rules_of_one_length(spark):
    """Of rules alike in length that both fit, the later by name holds; a host cannot fit two of one host length otherwise."""
    pages, outcomes = table(spark, ["http://a.b/c/d"], [])
    r = url_filter.judge(pages, outcomes, (("block", "a.b", "/"), ("allow", "b", "/c/"))).first()
    assert (r.rule, r.verdict) == ("b/c/", "allow") if "b/c/" > "a.b/" else ("a.b/", "block")


def test_edges(spark):
    pages, outcomes = table(spark, ["http://a.b/"], [])
    assert url_filter.judge(pages, outcomes, queries.RULES).first()["mean"] == 0.5
    assert url_filter.judge(pages.limit(0), outcomes, queries.RULES).collect() == []
