"""Host reputation by empirical Bayes.

Labelled page outcomes are summed to hosts, registered domains and suffixes. The
share of good pages of each level is shrunk towards that of the level above by a
beta-binomial prior whose strength is estimated from the data by moments, and a
host passes if a low quantile of its posterior, a beta distribution, reaches a threshold.

Defined results: a null url, or one without ``://``, has an empty host and path and
is judged by the prior of the empty suffix. Repeated urls or page ids are judged
row by row; repeated outcomes of a page all count. Null outcomes count nothing. With
no outcome at all the share is 0.5 everywhere. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Without a table of suffixes: the last label, or the last two where a country's label (two letters) follows one of these.
SECOND_LEVEL = "^(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\\.[a-z]{2}$"

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Rules are a written list, compiled into one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def domain_suffix(host: Column) -> tuple[Column, Column]:
    last2 = F.substring_index(host, ".", -2)
    suffix = F.when(last2.rlike(SECOND_LEVEL), last2).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(last2.rlike(SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(last2)
    return domain, suffix


def with_suffixes(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """``hosts`` (host and others) with domain and suffix.

    suffixes: rules (rule) as public lists have them, one a line: ``co.uk``, ``*.ck`` for any label before, and ``!www.ck``
    for exceptions. The longest that fits holds, an exception before all; without any the suffix is the
    last label. They are joined to the endings of the hosts, and sent to all tasks only if their size allows it.
    """
    if suffixes is None:
        domain, suffix = domain_suffix(F.col("host"))
        return hosts.withColumns({"domain": domain, "suffix": suffix})
    ends = hosts.select("host").distinct().select("host", F.expr("explode(sequence(1, size(split(host, '[.]')))) as k")).withColumn("end", F.expr("substring_index(host, '.', -k)"))
    forms = ends.select("host", F.expr("""inline(array(named_struct('k', k, 'rule', end, 'first', 0), named_struct('k', k, 'rule', concat('*.', substring_index(host, '.', 1 - k)), 'first', 0),
        named_struct('k', k - 1, 'rule', concat('!', end), 'first', 1)))"""))  # fmt: skip
    rules = suffixes.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()
    longest = forms.join(rules, "rule").groupBy("host").agg(F.max_by("k", F.struct("first", "k")).alias("k"))
    known = hosts.join(longest, "host", "left").withColumn("k", F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)))
    return known.withColumns({"domain": F.expr("substring_index(host, '.', -k - 1)"), "suffix": F.expr("substring_index(host, '.', -k)")}).drop("k")


#: Steps of the grid, and its half width in deviations, on which a beta distribution is summed up.
STEPS, WIDTH = 400, 8


def beta_quantile(a: str, b: str, share: float) -> Column:
    """The quantile ``share`` of the beta distribution of the columns ``a`` and ``b``.

    The density is summed over a grid of log odds around log(a / b), and its sum cut at ``share``, straight between two steps.
    """
    width = f"sqrt(1 / {a} + 1 / ({a} * {a}) + 1 / {b} + 1 / ({b} * {b}))"
    at = f"(ln({a} / {b}) + {width} * ({WIDTH / (STEPS // 2)}D * (i - {STEPS // 2})))"
    log_density = lambda u: f"({a} * {u} - ({a} + {b}) * (greatest({u}, 0D) + ln(1 + exp(-abs({u})))))"
    weights = f"transform(sequence(0, {STEPS}), i -> exp({log_density(at)} - {log_density(f'ln({a} / {b})')}))"
    cut = f"""transform(array({weights}), w -> aggregate(w, named_struct('left', {share}D * aggregate(w, 0D, (s, x) -> s + x), 'i', 0D, 'open', true),
        (s, x) -> named_struct('left', if(s.open, s.left - x, s.left), 'i', if(s.open, if(s.left <= x, s.i + s.left / x, s.i + 1), s.i), 'open', s.open and s.left > x)).i)[0]"""
    u = f"(ln({a} / {b}) + {width} * ({WIDTH / (STEPS // 2)}D * ({cut} - {STEPS // 2}.5D)))"
    return F.expr(f"1 / (1 + exp(-{u}))")


def strength(groups: DataFrame) -> float:
    """Prior strength of the groups (n, k), by moments of the beta-binomial: 1 / rho - 1, rho the correlation within groups."""
    r = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not r["n"]:
        return 1.0
    p, more = r["k"] / r["n"], r["n"] - r["nn"] / r["n"] - (r["g"] - 1)
    if p in (0.0, 1.0) or more <= 0:
        return 1.0
    rho = ((r["kk"] - r["n"] * p * p) / (p * (1 - p)) - (r["g"] - 1)) / more
    return 1 / min(max(rho, 0.001), 0.9) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, *, share: float = 0.05, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, k, mean, bound) for each host of ``pages`` (page_id, host), from ``outcomes`` (page_id, good 0 or 1).

    bound: the quantile ``share`` of the posterior beta distribution of the host's share.
    """
    found = outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    hosts = keep(pages.join(found, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")), "hosts")
    hosts = with_suffixes(hosts, suffixes)
    up = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (total["k"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    ss, sd, sh = (strength(x) for x in (suffixes, domains, hosts))
    post = lambda above, s: (F.col("k") + above * s) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", post(F.lit(overall), ss).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", post(F.col("suffix_mean"), sd).alias("domain_mean"))
    posts = hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", post(F.col("domain_mean"), sh).alias("mean"))
    # what the posterior counts for and against: n + strength in all
    posts = posts.withColumns({"a": F.col("mean") * (F.col("n") + F.lit(sh)), "b": (1 - F.col("mean")) * (F.col("n") + F.lit(sh))})
    return posts.select("host", "n", "k", "mean", beta_quantile("a", "b", share).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *, threshold: float = 0.5, share: float = 0.05, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, bound for each row of ``pages`` (page_id, url)."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(urls.select("page_id", "host"), outcomes, share=share, suffixes=suffixes).select("host", "mean", "bound")
    return urls.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"),
    )
