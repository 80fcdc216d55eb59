"""URL filter: listed rules, and for other URLs the reputation of the host by empirical Bayes, in DataFrame operations only.

Labelled page outcomes are counted by host, registered domain and suffix. At each level a beta prior with the
posterior mean of the level above is put on the share of bad pages; its strength is estimated for the level by
moments (the overdispersion of the counts against what is drawn from the level above). A host is blocked if the
lower bound of its share of bad pages is over the threshold, so hosts of which little is known are let through.

All counts are sums before a shuffle; pages meet one row for each host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of two labels under which names are registered; a parameter of host_reputation.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """block or allow for a host and its subdomains, where the path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label of the host, or two of them; an address in numbers is its own."""
    two = F.substring_index(_name(host), ".", -2)
    return F.when(_is_address(host), _name(host)).when(two.isin(*suffixes), two).otherwise(F.substring_index(_name(host), ".", -1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and the label before it; an address in numbers is its own."""
    two, three = (F.substring_index(_name(host), ".", n) for n in (-2, -3))
    return F.when(_is_address(host), _name(host)).when(two.isin(*suffixes), three).otherwise(two)


def _name(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def _is_address(host: Column) -> Column:
    return _name(host).rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")


def _strength(children: DataFrame) -> float:
    """How many pages the prior counts for, from rows with n, bad and mean (the prior mean)."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / (F.col("mean") * (1 - F.col("mean")))
    excess, more = children.agg(F.sum(spread - 1), F.sum(F.col("n") - 1)).first()
    rho = min(max((excess or 0.0) / more, 0.001), 0.5) if more else 0.5
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n_labelled, bad_share (posterior mean) and bad_at_least (its lower bound) of distinct hosts (host).

    outcomes has a row for each labelled page: host, bad (boolean; null counts as no label). Without any, all means are 0.5.
    """
    place = lambda df: df.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", url_suffix(F.col("host"), suffixes))
    known = place(outcomes.filter("bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = known.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    n, bad = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 0.5) / (n + 1)

    def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
        k = _strength(level)
        return level.withColumn("share", (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)), k

    tops, k_suffix = shrunk(tops.withColumn("mean", F.lit(overall)))
    domains, k_domain = shrunk(domains.join(tops.select("suffix", F.col("share").alias("mean")), "suffix"))
    _, k_host = shrunk(known.join(domains.select("domain", "suffix", F.col("share").alias("mean")), ["domain", "suffix"]))
    out = (
        place(hosts)
        .join(known.select("host", "n", "bad"), "host", "left")
        .join(domains.select("domain", "suffix", F.col("share").alias("of_domain")), ["domain", "suffix"], "left")
        .join(tops.select("suffix", F.col("share").alias("of_suffix")), "suffix", "left")
    )
    prior = F.coalesce("of_domain", "of_suffix", F.lit(overall))
    a = F.coalesce("bad", F.lit(0)) + k_host * prior
    total = F.coalesce("n", F.lit(0)) + k_host
    share = a / total
    return out.select("host", F.coalesce("n", F.lit(0)).alias("n_labelled"), share.alias("bad_share"), (share - z * F.sqrt(share * (1 - share) / (total + 1))).alias("bad_at_least"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled and bad_at_least (the bound that decides without a rule) of every row of pages (page_id, url).

    The longest rule that fits decides (of equally long ones the first); without one, block if the host's share of bad pages is over the
    threshold by its lower bound, else allow. outcomes: url, bad. Null urls and such without :// have an empty host and
    path, and that host's reputation. Null page_ids are kept; repeated rows give a row each; an empty table gives none;
    other columns are ignored.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    placed = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = outcomes.select(url_host(outcomes["url"]).alias("host"), outcomes["bad"].alias("bad"))
    reputation = host_reputation(placed.select("host").distinct(), seen, z)
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):  # what comes last decides
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.startswith(F.col("path"), F.lit(r.path))
        rule, by_rule = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(by_rule)
    by_host = F.when(F.col("bad_at_least") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return placed.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_host).alias("verdict"), "n_labelled", "bad_at_least")
