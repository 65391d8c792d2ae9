"""URL filter: explicit host/path rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix.  The rate of bad pages is shrunk down
that chain: the suffix towards the overall rate, the domain towards its suffix, the host towards its domain.  Each
level's prior strength comes from the spread of its groups' counts beyond binomial noise (method of moments), and
a host is blocked if the lower bound of its beta posterior exceeds a threshold.

The suffix is the last label and the registered domain the last two, unless the host ends in one of the
``long_suffixes`` given (no public suffix list is bundled).

Defined results: null urls and urls without ``://`` have empty host and path; the empty host is its own domain and
suffix.  Hosts without labels get their domain's prior.  A page with several label rows is bad if any row says so;
label rows with neither value do not count.  Without any label the overall rate is 0 and nothing is blocked.  No
pages give no rows; repeated page_ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secscan.llm.common import ascii_lower, written


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is host plus path prefix; it fits the host and its subdomains."""

    rule: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def levels(host: Column, long_suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    domain, suffix = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    for s in sorted(long_suffixes, key=lambda s: (s.count("."), s)):
        n, under = s.count(".") + 1, (host == s) | host.endswith("." + s)
        domain = F.when(under, F.substring_index(host, ".", -n - 1)).otherwise(domain)
        suffix = F.when(under, F.lit(s)).otherwise(suffix)
    return domain, suffix


def apply_rules(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    pick = lambda value: F.coalesce(*[F.when(r.fits(host, path), F.lit(value(r))) for r in ranked],
                                    F.lit(None).cast("string"))
    return pick(lambda r: r.rule), pick(lambda r: r.verdict)


def _shrink(groups: DataFrame) -> DataFrame:
    """Posterior mean ``mu`` and strength ``kappa`` of each group from (n, k) and the parent's mean ``up``.

    With an intra-group correlation r, Pearson's X2 expects sum(1 + (n - 1) r); solved for r, kept within
    [0.0001, 0.5], the prior strength is 1/r - 1.
    """
    v = "(n * up * (1 - up))"
    spread = groups.agg(F.expr(
        f"least(0.5D, greatest(0.0001D, coalesce((sum((k - n * up) * (k - n * up) / {v}) FILTER (WHERE {v} > 0)"
        f" - count(1) FILTER (WHERE {v} > 0)) / nullif(sum(n - 1) FILTER (WHERE {v} > 0), 0), 0.0001D)))"))
    return groups.withColumn("kappa", 1 / spread.scalar() - 1).withColumn("mu", F.expr("(k + kappa * up) / (n + kappa)"))


def reputation(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """``outcomes`` (host, domain, suffix, bad) with ``bad`` 0, 1 or null -> one row per host with ``lower``.

    All counts are sums combined before the shuffle, so a host with a third of all pages is one row per task.
    """
    hosts = written(outcomes.groupBy("suffix", "domain", "host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.expr("coalesce(sum(k) / nullif(sum(n), 0), 0D)"))
    s = _shrink(suffixes.withColumn("up", overall.scalar()))
    d = _shrink(domains.join(s.select("suffix", F.col("mu").alias("up")), "suffix"))
    h = _shrink(hosts.join(d.select("domain", "suffix", F.col("mu").alias("up")), ["suffix", "domain"]))
    h = h.withColumn("a", F.expr("k + kappa * up")).withColumn("b", F.expr("n - k + kappa * (1 - up)"))
    return h.select("host", F.col("n").cast("bigint").alias("n_labelled"), F.col("k").cast("bigint").alias("n_bad"),
                    F.expr(f"mu - {z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))").alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[UrlRule], threshold: float = 0.25, z: float = 1.64,
          long_suffixes: Sequence[str] = ()) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict, and the host's labelled and bad pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = levels(F.col("host"), long_suffixes)
    bad = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END")).alias("bad"))
    outcomes = p.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix")).join(bad, "page_id", "left")
    verdicts = reputation(outcomes, z)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return p.join(verdicts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"),
        "n_labelled", "n_bad")
