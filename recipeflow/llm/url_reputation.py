"""URL filter by Empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host.  Few hosts have enough of
them, so each host's rate is shrunk through beta-binomial priors along host ->
registered domain -> suffix: the prior of a host is centred on its domain's posterior
mean, that of a domain on its suffix's, that of a suffix on the overall rate.  How
strongly a level is pulled to its parent is estimated from the data: the moment
estimator compares the spread of rates within a level with what binomial noise alone
would give.  A host is kept when a lower bound of its posterior good rate reaches a
threshold that itself follows from the overall rate, so a host with no evidence of its own stands where
its domain or suffix stands.

The rules, if any, come first: a rule fits its host and all subdomains when the
path starts with the rule's; the longest rule wins.

Counting is a partial aggregate, so a host with a third of all pages is no hot group.
Verdicts are made per distinct host and written once; the join back is by
host, both sides plain exchanges that AQE can split, or a broadcast where Spark sees a small table.

Defined results: a URL that is NULL or has no ``://`` has empty host and path and is
judged like a host without evidence; ports and users of a host make no domain, and an address is a domain of its own; a NULL outcome is no evidence; rows repeated in whole count and
return as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import boxed
from recipeflow.session import stage

#: Labels under which countries register names: in front of a two-letter last label they belong to the suffix.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: The suffix of hosts that are addresses; each is a domain of its own.
ADDRESSES = "(address)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host, then / and a path prefix

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """``host`` without user, port and final dots."""
    return F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$|\.+(?=$|:[0-9]*$)", "")


def _address(bare: Column) -> Column:
    return bare.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")


def _compound(bare: Column) -> Column:
    return bare.rlike(r"(^|\.)(" + "|".join(REGISTRY_LABELS) + r")\.[a-z]{2}$")


def public_suffix(host: Column) -> Column:
    bare = bare_host(host)
    labels = F.when(_compound(bare), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(_address(bare), F.lit(ADDRESSES)).otherwise(labels)


def registered_domain(host: Column) -> Column:
    bare = bare_host(host)
    labels = F.when(_compound(bare), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(_address(bare), bare).otherwise(labels)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, F.lit(r.pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength s of a level by moments: for groups of n outcomes with k good around their parent's
    rate p, the squared deviations sum to about ``sum(n p q (1 + (n-1) / (s+1)))``.  Three sums over the level."""
    q = F.col("p") * (1 - F.col("p"))
    seen = groups.where("n > 0")
    got = seen.agg(
        F.sum((F.col("k") - F.col("n") * F.col("p")) ** 2).alias("spread"),
        F.sum(F.col("n") * q).alias("noise"),
        F.sum(F.col("n") * (F.col("n") - 1) * q).alias("extra"),
    ).first()
    if not got or not got["extra"]:
        return least
    rho = (got["spread"] - got["noise"]) / got["extra"]  # 1 / (s + 1)
    return most if rho <= 1 / (most + 1) else max(least, 1 / rho - 1)


def host_reputation(outcomes: DataFrame, z: float = 1.64) -> tuple[DataFrame, float]:
    """(host, n, k, prior, strength, mean, lower) for each host of ``outcomes`` (host, good 0/1/NULL), and the overall rate.

    ``lower`` is the posterior mean less ``z`` posterior standard deviations.
    """
    good = F.col("good").cast("double")
    hosts = stage(
        outcomes.groupBy("host").agg(F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0.0)).alias("k")),
        "reputation-counts",
    ).select("*", registered_domain(F.col("host")).alias("domain"), public_suffix(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain").agg(
        F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (total["k"] + 0.5) / (total["n"] + 1) if total and total["n"] else 0.5

    def shrunk(level: DataFrame, name: str) -> DataFrame:
        s = _strength(level)
        out = level.withColumn("strength", F.lit(s))
        return stage(
            out.withColumn("mean", (F.col("k") + s * F.col("p")) / (F.col("n") + s)), "reputation-" + name
        )

    suffixes = shrunk(suffixes.withColumn("p", F.lit(overall)), "suffix")
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("p")), "suffix"), "domain")
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("p")), "domain"), "host")
    weight = F.col("n") + F.col("strength")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))
    lower = F.greatest(F.lit(0.0), F.col("mean") - z * sd)
    return hosts.select(
        "host", "n", "k", F.col("p").alias("prior"), "strength", "mean", lower.alias("lower")
    ), float(overall)


def judge_urls(
    pages: DataFrame,
    outcome: Column,
    rules: list[Rule] = (),
    url_col: str = "url",
    z: float = 1.64,
    ratio: float = 0.5,
) -> DataFrame:
    """Rows of ``pages`` as struct ``_doc`` with host, path, rule, verdict, mean, lower.

    ``outcome`` is 1 for a good page, 0 for a bad one, NULL if not labelled.  Without a rule the
    verdict is ``allow`` when the host's lower posterior bound is at least ``ratio`` times the overall good rate.
    """
    url = F.col(url_col)
    seen = boxed(pages, host=url_host(url), path=url_path(url), good=outcome)
    reputation, overall = host_reputation(seen.select("host", "good"), z)
    reputation = stage(reputation.select("host", "mean", "lower"), "reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), list(rules))
    allowed = F.col("lower") >= ratio * overall
    return seen.drop("good").join(reputation, "host").select(
        "_doc",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(allowed, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        "mean",
        "lower",
    )
