"""URL filter: fixed rules first, then the reputation of a host by empirical Bayes.

Labelled page outcomes (0 kept, 1 bad) are counted for each host, registered domain and suffix. The rate of bad pages of
each level has a beta prior that is centred on the posterior mean of the level above it:

    all pages -> suffix -> registered domain -> host

The weight of a prior comes from the data (method of moments over the children of that level, clipped to a range), so hosts
with few labels take the rate of their domain, hosts with many labels their own. A url is blocked if the lower bound of its
host's posterior, mean - z * standard deviation, is above `max_bad`.

Everything is DataFrame code: counts are aggregated before any shuffle of pages, and only the join of the verdicts to the
pages moves pages (a sort-merge join, which AQE splits where one host holds a large part of them).

Cases: a null url, or one without `://`, has an empty host and path, fits no rule and is judged as the host '' like any
other; an empty label table gives the flat prior, so nothing but rules blocks; repeated rows stay as they are; other columns
of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """verdict for urls whose host is `host` or below it and whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Suffixes of two labels below which names are registered; a parameter of the operator.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.za", "com.mx", "com.ar", "co.in", "com.cn", "com.tr")


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level) & (two != host), two).otherwise(last)


def domain_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*second_level) & (two != host), three).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def _prior_weight(children: DataFrame, keys: list[str], least: float, most: float) -> DataFrame:
    """Weight of the beta prior over the children (columns n, bad, mean of the parent as m) of each key.

    Moments of the beta-binomial: with S the sum of n * (rate - m)^2, C children, N = sum n and Q = sum n^2,
    between = (S - (C - 1) * m * (1 - m)) / (N - Q / N), and the weight is m * (1 - m) / between - 1.
    """
    m = F.col("m")
    rate = F.col("bad") / F.col("n")
    sums = children.where("n > 0").groupBy(*keys).agg(
        F.first("m").alias("m"), F.count("*").alias("c"), F.sum("n").cast("double").alias("total"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"), F.sum(F.col("n") * (rate - m) * (rate - m)).alias("s"),
    )
    spread = F.col("total") - F.col("squares") / F.col("total")
    between = (F.col("s") - (F.col("c") - 1) * m * (1 - m)) / spread
    weight = F.when((spread > 0) & (between > 0), m * (1 - m) / F.when((spread > 0) & (between > 0), between) - 1).otherwise(F.lit(most))
    return sums.select(*keys, F.least(F.greatest(weight, F.lit(least)), F.lit(most)).alias("w"))


def host_reputation(hosts: DataFrame, prior_mean: float = 0.1, prior_weight: float = 10.0, least_weight: float = 2.0, most_weight: float = 200.0, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """hosts(host, n, bad): labelled pages and bad ones of each host. Returns host, n, bad, mean, sd of its posterior."""
    hosts = hosts.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), domain_of(F.col("host"), second_level).alias("domain"), suffix_of(F.col("host"), second_level).alias("suffix"))
    # each level is written once, so that none is counted again for the next
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + prior_mean * prior_weight) / (F.coalesce(F.sum("n"), F.lit(0)) + prior_weight)).alias("m"))

    def posterior(m: Column, w: Column) -> Column:
        return (F.col("bad") + w * m) / (F.col("n") + w)

    # the one row of `top` and its weight are joined through a constant key: a single row, so always broadcast
    suffixes = suffixes.withColumn("k", F.lit(1)).join(F.broadcast(top.withColumn("k", F.lit(1))), "k")
    weight = _prior_weight(suffixes, ["k"], least_weight, most_weight)
    suffixes = suffixes.join(F.broadcast(weight), "k", "left").withColumn("w", F.coalesce("w", F.lit(most_weight)))
    suffixes = suffixes.select("suffix", posterior(F.col("m"), F.col("w")).alias("m"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.join(_prior_weight(domains, ["suffix"], least_weight, most_weight), "suffix", "left").withColumn("w", F.coalesce("w", F.lit(most_weight)))
    domains = written(domains.select("suffix", "domain", posterior(F.col("m"), F.col("w")).alias("m")), "domain-means")
    hosts = hosts.join(domains, ["suffix", "domain"])
    hosts = hosts.join(_prior_weight(hosts, ["suffix", "domain"], least_weight, most_weight), ["suffix", "domain"], "left").withColumn("w", F.coalesce("w", F.lit(most_weight)))
    a, b = F.col("bad") + F.col("w") * F.col("m"), F.col("n") - F.col("bad") + F.col("w") * (1 - F.col("m"))
    return hosts.select("host", "n", "bad", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], z: float = 1.645, max_bad: float = 0.25, **prior) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad). Returns page_id, host, path, rule, verdict and bad_bound of every page.

    verdict: that of the longest rule that fits, else 'block' if the posterior bound of the host's bad rate is above max_bad.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # a repeated label row counts once: its worst outcome
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = written(urls.join(marks, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    bound = host_reputation(counted, **prior).select("host", (F.col("mean") - z * F.col("sd")).alias("bad_bound"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    said = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in rules]) if rules else F.lit(None).cast("string")
    return (
        urls.join(bound, "host", "left")
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"), "bad_bound")
    )
