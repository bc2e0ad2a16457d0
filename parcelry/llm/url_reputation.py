"""URL filters: allow and block rules, and empirical-Bayes host reputation where no rule fits.

Pages that a rule decides are the labelled outcomes (block counts as bad). Bad rates are shrunk through
beta-binomial priors, from the whole table to the suffix, to the registered domain, to the host, and a page
that no rule fits is blocked if the lower bound of its host's posterior bad rate is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rule that fits, as struct(rule, verdict), or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest rule wins;
    of equally long ones the one with the longer host, then block before allow.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].find("/"), r[0] == "allow"))
    found = None
    for verdict, rule in ordered:
        at, below = rule.split("/", 1)
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host (all of it if it has fewer)."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def reputation(outcomes: DataFrame, strength_max: float = 1000.0) -> DataFrame:
    """host, bad, n, rate, bound from one row per host with bad and n (n may be 0).

    At each level the children's bad rates give a beta prior by moments: the parent's shrunken rate is its
    mean, and the strength s solves Var(rate) = m (1 - m) / (s + 1), kept within 1 and strength_max. bound is the
    posterior mean less two posterior standard deviations. Without any outcome, rate is 0.5 with strength 1, so
    that nothing is blocked.
    """
    hosts = outcomes.select("host", "bad", "n", registered_domain(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))

    def strength(level: DataFrame, name: str) -> DataFrame:
        """One row: the mean rate and the prior's strength, from all rows of a level that have outcomes."""
        m = F.sum("bad") / F.sum("n")
        # E[(bad - n m)^2 / n] in sums that need no second pass; 1 / E[n] is taken out as sampling noise.
        v = (F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("n") * m * m) / F.sum("n")
        one = level.filter(F.col("n") > 0).agg(F.coalesce(m, F.lit(0.5)).alias("m"), F.coalesce(v, F.lit(0.0)).alias("v"))
        s = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0))
        return one.select(F.col("m").alias(f"{name}_m"), F.least(F.greatest(s, F.lit(1.0)), F.lit(strength_max)).alias(f"{name}_s"))

    def shrunk(m: Column, s: Column) -> Column:
        return (F.col("bad") + m * s) / (F.col("n") + s)

    top = strength(suffixes, "top")
    suffixes = suffixes.join(F.broadcast(top)).select("suffix", shrunk(F.col("top_m"), F.col("top_s")).alias("suffix_rate"))  # top: one row
    domains = domains.join(F.broadcast(strength(domains, "mid"))).join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), F.col("mid_s")).alias("domain_rate"))
    host = hosts.join(F.broadcast(strength(hosts, "low"))).join(domains, "domain")
    rate, total = shrunk(F.col("domain_rate"), F.col("low_s")), F.col("n") + F.col("low_s")
    return host.select("host", "bad", "n", rate.alias("rate"), (rate - 2 * F.sqrt(rate * (1 - rate) / (total + 1))).alias("bound"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of pages (repeated rows stay).

    A null url, or one without '://', has an empty host and path. Pages that no rule fits are blocked if their
    host's lower posterior bound of the bad rate is above limit. An empty table gives no rows. Only page_id and url
    are used; other columns don't matter.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parsed.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    outcomes = judged.groupBy("host").agg(
        F.sum(F.when(F.col("by_rule") == "block", 1).otherwise(0)).alias("bad"), F.count("by_rule").alias("n")
    )
    standing = saved(reputation(outcomes).select("host", (F.col("bound") > limit).alias("bad_host")), "host-reputation")
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(standing, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
