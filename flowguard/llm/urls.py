"""Address filters: rules by host and path, and the empirical-Bayes reputation of hosts for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import plain_names, small_join
from flowguard.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Suffixes of two labels, below which the registered domain has three.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz",
                   "co.in", "com.cn", "com.mx", "co.za", "co.kr", "com.tr", "com.ar")
#: Normal quantile of the one-sided bound, and the block rate that the bound must exceed.
BOUND, BLOCK_RATE = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path up to `?`, `#` or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix (one label, or a known pair) and registered domain (one label more); a host of no more labels is its own domain."""
    labels = F.split(host, r"\.")
    pair = F.concat_ws(".", F.slice(labels, -2, 2))
    double = (F.size(labels) >= 2) & pair.isin(*DOUBLE_SUFFIXES)
    suffix = F.when(double, pair).otherwise(F.element_at(labels, -1))
    domain = F.when(double, F.when(F.size(labels) >= 3, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(host)).otherwise(
        F.when(F.size(labels) >= 2, pair).otherwise(host))
    return suffix, domain


def shrink(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Posterior mean and concentration of each child: its outcomes on top of the beta prior centred on its parent.

    The concentration of the prior is fitted over all labelled children by moments: with overall block rate p, the
    pooled squared deviation sum n (k/n - parent)^2 is compared with its binomial part; the more children scatter, the
    weaker the prior. Held between 1 and 1000, also when nothing is labelled.
    """
    joined = small_join(child, parent.select(on, F.col("mean").alias("prior")), [on], [child.columns[0]])
    n, k, p = F.col("n").cast("double"), F.col("k").cast("double"), F.col("prior")
    labelled = joined.where("n > 0").agg(
        F.sum(n * (k / n - p) * (k / n - p)).alias("scatter"), F.sum(p * (1 - p)).alias("binomial"),
        F.sum(n * p * (1 - p)).alias("spread"))
    # E[scatter] = binomial + (spread - binomial) * rho, with rho = 1 / (1 + concentration)
    rho = (F.col("scatter") - F.col("binomial")) / (F.col("spread") - F.col("binomial"))
    strength = F.when(F.col("spread") - F.col("binomial") > 1e-9, F.when(rho > 1e-3, 1 / rho - 1).otherwise(F.lit(1000.0)))
    fitted = labelled.select(F.least(F.greatest(F.coalesce(strength, F.lit(10.0)), F.lit(1.0)), F.lit(1000.0)).alias("strength"))
    both = joined.join(F.broadcast(fitted))  # one row
    a = F.col("strength") * F.col("prior") + F.col("k")
    return both.select(*child.columns, (a / (F.col("strength") + F.col("n"))).alias("mean"), (F.col("strength") + F.col("n")).alias("weight"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """One row per host (`host`, `mean`, `low`): posterior block rate and its one-sided lower bound.

    `outcomes` has `host`, `suffix`, `domain` and `verdict` per page, the verdict null where a page has no label. Hosts
    are counted before anything is joined, so a host with a third of all pages is one row.
    """
    hosts = cut_lineage(outcomes.groupBy("host", "suffix", "domain").agg(
        F.count("verdict").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("k")))
    overall = hosts.agg(((F.sum("k") + 1.0) / (F.sum("n") + 2.0)).alias("mean")).select(F.lit(1).alias("all"), F.coalesce("mean", F.lit(0.5)).alias("mean"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = shrink(suffixes, overall, "all")
    by_domain = shrink(domains, by_suffix, "suffix")
    by_host = shrink(hosts.select("host", "domain", "n", "k"), by_domain, "domain")
    low = F.col("mean") - BOUND * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return by_host.select("host", "mean", F.greatest(low, F.lit(0.0)).alias("low"))


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """Adds `host`, `path`, `rule` and `verdict` (allow or block) to every page, replacing columns of those names.

    The longest fitting rule decides. Pages decided by rules are the labelled outcomes from which the reputation of
    every host is estimated: counts of the host are shrunk towards its registered domain, that towards its suffix, and
    that towards all pages. A page that no rule fits is blocked when the lower bound of its host's block rate exceeds
    one half, else allowed. Null urls and urls without `://` have empty host and path and are judged like a host of
    their own. Repeated rows get equal verdicts; an empty table gives an empty result.
    """
    made = ["host", "path", "rule", "verdict"]
    pages, names, of = plain_names(pages, made)
    url = of[url]
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumn("host", host).withColumn("path", path)
    text, verdict = best_rule(F.col("host"), F.col("path"), rules)
    suffix, domain = suffix_and_domain(F.col("host"))
    parsed = parsed.withColumn("rule", text).withColumn("verdict", verdict)
    known = reputations(parsed.select("host", suffix.alias("suffix"), domain.alias("domain"), "verdict"))
    learned = known.select("host", F.when(F.col("low") > BLOCK_RATE, F.lit("block")).otherwise(F.lit("allow")).alias("__learned"))
    joined = small_join(parsed, learned, ["host"], [url])
    return joined.withColumn("verdict", F.coalesce("verdict", "__learned")).drop("__learned").select(*pages.columns, *made).toDF(*names, *made)
