"""Host reputation by empirical Bayes, and rules on hosts and paths that override it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.sources.shared import materialize

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("host", "domain", "suffix")
WEAKEST, STRONGEST = 1.0, 1000.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels; a stand-in for a list of public suffixes."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; block wins a tie; null where none fits.

    A rule fits its host and every host under it, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """Beta prior strength of ``n``, ``good`` counts by moments: how alike the groups are.

    One row of sums; groups without outcomes take no part.
    """
    s = (
        groups.where("n > 0")
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("good").alias("good"),
            F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
        )
        .first()
    )
    if not s["k"]:
        return STRONGEST
    mean = s["good"] / s["n"]
    spread, room = mean * (1 - mean), s["n"] - s["nn"] / s["n"]
    if spread <= 0 or room <= 0:
        return STRONGEST
    between = (s["gg"] - s["n"] * mean * mean - (s["k"] - 1) * spread) / room
    share = between / spread
    return STRONGEST if share <= 1 / (1 + STRONGEST) else max(WEAKEST, min(STRONGEST, 1 / share - 1))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of every host's share of good pages: ``host, n, good, mean, lower, upper``.

    ``outcomes`` has ``host`` and ``good`` (0, 1, or null where unlabelled), a row a
    page. A suffix's share is shrunk to the share over all pages, a domain's to its
    suffix's, a host's to its domain's; the strength of each level's prior is
    estimated from how its groups vary. The bound is the mean plus or minus ``z``
    posterior deviations. Without any outcome the overall share is 1/2. Hosts are
    pre-aggregated, so a host with a third of all pages is one row a task.
    """
    hosts = materialize(
        outcomes.groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good"),
        "hosts",
    )
    both = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*both)
    suffixes = hosts.groupBy("suffix").agg(*both)
    k = {"host": _strength(hosts), "domain": _strength(domains), "suffix": _strength(suffixes)}
    total = hosts.agg(*both).first()
    top = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(prior: Column | float, level: str) -> Column:
        return (F.col("good") + k[level] * (prior if isinstance(prior, Column) else F.lit(prior))) / (F.col("n") + k[level])

    suffix_mean = suffixes.select("suffix", shrunk(top, "suffix").alias("suffix_mean"))
    domain_mean = domains.join(suffix_mean, "suffix").select("domain", shrunk(F.col("suffix_mean"), "domain").alias("domain_mean"))
    posterior = hosts.join(domain_mean, "domain").select(
        "host", "n", "good", shrunk(F.col("domain_mean"), "host").alias("mean"), (F.col("n") + k["host"]).alias("weight")
    )
    wide = z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return posterior.select(
        "host", "n", "good", "mean", (F.col("mean") - wide).alias("lower"), (F.col("mean") + wide).alias("upper")
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], min_good: float = 0.5, z: float = 1.645
) -> DataFrame:
    """Verdict on every page: its longest rule's, else its host's.

    ``pages`` has ``page_id`` and ``url``, ``labels`` has ``page_id`` and ``good``
    (several labels of a page count once each; null ones not at all). A host is
    blocked when even the upper bound of its share of good pages is below
    ``min_good``; hosts that little is known of are allowed. A url that is null or
    has no ``://`` has empty host and path, which are judged like any other.
    Repeated pages are judged each; an empty table gives no rows. The join on the
    host may meet a host with a third of all rows: its few columns are joined to one
    row, and adaptive execution splits the partition.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    good = labels.select(F.col("page_id").alias("_page"), "good").where("good IS NOT NULL")
    outcomes = own.select("page_id", "host").join(good, F.col("page_id") == F.col("_page"), "left").select("host", "good")
    rule = match_rule(F.col("host"), F.col("path"), rules)
    block = F.col("upper") < F.lit(min_good)
    return (
        own.join(reputation(outcomes, z), "host", "left")
        .withColumn("_rule", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), F.when(block, "block").otherwise("allow")).alias("verdict"),
            F.col("mean").alias("good_share"),
            "lower",
            "upper",
        )
    )
