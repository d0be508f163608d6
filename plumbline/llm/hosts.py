"""Empirical-Bayes host reputation beside URL rules.

Every page's own content is a labelled outcome: a page of few words or of many
symbols is bad. Outcomes are counted by host, and beta-binomial means shrink
from host to registered domain to public suffix to all pages: each level's
prior has its parent's mean and a strength fitted to how much the level's
rates scatter beyond chance. A rule decides its pages; all others get the
verdict of their host's posterior bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import table, unused, without


class Rule(NamedTuple):
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule(True, "org", "/"),
    Rule(False, "example.org", "/es/"),
    Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"),
    Rule(False, "com", "/de/"),
)
#: Second-level labels under which country suffixes register names.
SECOND_LEVEL = ("co", "com", "org", "net", "edu", "gov", "ac")
#: A host is blocked if the share of bad pages is above LIMIT at Z standard deviations under the posterior mean.
LIMIT, Z = 0.25, 1.64
#: A page is bad with fewer words, or with more symbols a word.
LEAST_WORDS, MOST_SYMBOLS = 50, 0.3
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*+>|<!--.*?-->|<[^>]*+>"
_NUMERIC = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
#: Bounds of a prior's strength in pages, and the share of bad pages that two pages are taken to have before any is seen.
WEAKEST, STRONGEST, FIRST = 1.0, 1000.0, 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    url = url.cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct (rule, allow) of the longest rule that fits a host or a parent of it and begins the path; else null."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def page_outcome(html: Column) -> Column:
    """1 for a bad page, 0 for a good one, null without a page: judged by the words and symbols outside its markup."""
    seen = F.regexp_replace(html.cast("string"), _HIDDEN, " ")
    words, symbols = F.regexp_count(seen, F.lit(r"[^\x20\x09-\x0D]+")), F.regexp_count(seen, F.lit(r"[#*$%&|<>]"))
    return F.when((words < LEAST_WORDS) | (symbols > MOST_SYMBOLS * words), 1).when(html.isNotNull(), 0)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix by label count: the last label, or two under a country's second level. A numeric host is its own domain, without a suffix."""
    plain = F.regexp_replace(host, r":[0-9]*$", "")
    numeric = plain.rlike(_NUMERIC)
    labels = F.split(plain, r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    suffix = F.when(two, F.concat_ws(".", second, last)).otherwise(last)
    depth = F.when(two, 3).otherwise(2)
    domain = F.array_join(F.when(n > depth, F.slice(labels, n - depth + 1, depth)).otherwise(labels), ".")
    return F.when(numeric, plain).otherwise(domain), F.when(numeric, "").otherwise(suffix)


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: what scatter of the rates is left over the binomial's, given each group's parent mean."""
    spread = mean * (1 - mean)
    rate = F.col("bad") / F.col("n")
    row = groups.where((F.col("n") > 0) & (spread > 0)).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("s"), F.sum(spread).alias("binomial"), F.sum(spread * (F.col("n") - 1)).alias("rest")
    ).first()
    if not row["n"] or not row["rest"]:
        return STRONGEST
    rho = (row["s"] - row["binomial"]) / row["rest"]  # E[s] = sum spread * (1 + (n - 1) rho), rho = 1 / (strength + 1)
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) from (host, bad), one row per host; ``bad`` is 0, 1 or null (no outcome).

    Hosts without outcomes have the mean of their domain's posterior, and so on upwards; with no outcome at all it is FIRST.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = (whole["bad"] + 2 * FIRST) / (whole["n"] + 2)

    def shrunk(groups: DataFrame, mean: Column, key: str) -> tuple[DataFrame, float]:
        m = _strength(groups, mean)
        return groups.withColumn(key, (F.col("bad") + m * mean) / (F.col("n") + m)), m

    suffixes, _ = shrunk(suffixes, F.lit(top), "suffix_mean")
    domains, _ = shrunk(stored(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "domains"), F.col("suffix_mean"), "domain_mean")
    hosts, m = shrunk(stored(hosts.join(domains.select("domain", "domain_mean"), "domain"), "host-means"), F.col("domain_mean"), "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m + 1))
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - Z * deviation).alias("bound"))


def judge_pages(pages: DataFrame, url: str = "url", html: str | None = "html", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add host, path, rule, reputation (posterior mean of the share of bad pages), bound and verdict (allow or block) to every row.

    A rule decides its pages; all others follow their host's bound. Null urls
    and urls without :// have an empty host, which is judged like any other. A
    null page is no outcome, and if ``html`` is None there is none; all hosts
    then have the share FIRST. Input columns named as the new ones are
    replaced; the page itself is not returned; repeated rows stay, and each
    counts as a page; no rows give none.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    new = ("host", "path", "rule", "verdict", "reputation", "bound")
    out = without(pages, *new)
    bad, found = unused(out, "bad"), unused(out, "found")
    outcome = page_outcome(F.col(f"`{html}`")) if html else F.lit(None).cast("int")
    out = out.withColumns({bad: outcome, "host": host, "path": path}).drop(*[html] * bool(html))
    known = reputations(stored(out.select("host", F.col(bad).alias("bad")), "outcomes"))
    known = known.select(F.col("host").alias(f"{found}_host"), F.col("mean").alias("reputation"), "bound")
    out = out.drop(bad).withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    out = out.join(known, out["host"] == known[f"{found}_host"], "left").drop(f"{found}_host")
    allowed = F.coalesce(F.col(f"{found}.allow"), F.col("bound") <= LIMIT)
    return out.withColumn("rule", F.col(f"{found}.rule")).withColumn("verdict", F.when(allowed, "allow").otherwise("block")).drop(found)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judge_pages(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "reputation", "bound")
