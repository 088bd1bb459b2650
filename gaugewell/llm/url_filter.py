"""Url verdicts: given rules first, then an empirical-Bayes reputation of the host.

Labelled pages of a host are successes (bad) among trials.  The share of bad
pages has a beta prior, whose mean is that of the registered domain, whose own
prior has the mean of the suffix, whose own prior has the mean of all.  How
tight the priors are is estimated from the spread between the groups of a level
(moments of the beta-binomial).  A host is blocked when the lower bound of its
posterior (mean less z standard deviations) is over the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a host below which names are registered, besides the last label alone.
TWO_PART_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
LIMIT, Z = 0.25, 1.645


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next of / ? # or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host/path) that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _tightness(groups: DataFrame) -> Column | float:
    """Prior size s = (1 − ρ)/ρ from groups (n, k, m = mean of the parent)."""
    spread = F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    row = groups.agg(F.round(spread, 6).alias("spread"), F.round(scale, 6).alias("scale")).first()
    rho = (row["spread"] or 0.0) / row["scale"] if row["scale"] else 0.5  # nothing is known
    rho = min(max(rho, 0.001), 0.999)
    return (1 - rho) / rho


def host_reputation(hosts: DataFrame) -> DataFrame:
    """host, pages, reputation (posterior mean share of bad pages), bound (lower) of each row (host, pages, n labelled, k bad)."""
    hosts = cut_lineage(hosts.select("host", "pages", "n", "k", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix")))
    domains = cut_lineage(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("domains")))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((every["k"] or 0) + 1) / ((every["n"] or 0) + 2)
    at = suffixes.withColumn("m", F.lit(mean))
    size = _tightness(at)
    at = at.select("suffix", "domains", ((F.col("m") * size + F.col("k")) / (size + F.col("n"))).alias("m"))
    at = cut_lineage(join_totals(domains, at, ["suffix"], "domains"))
    size = _tightness(at)
    at = at.select("domain", "hosts", ((F.col("m") * size + F.col("k")) / (size + F.col("n"))).alias("m"))
    at = cut_lineage(join_totals(hosts.select("host", "pages", "domain", "n", "k"), at, ["domain"], "hosts"))
    size = _tightness(at)
    good = (1 - F.col("m")) * size + F.col("n") - F.col("k")
    bad = F.col("m") * size + F.col("k")
    sd = F.sqrt(bad * good / ((bad + good) ** 2 * (bad + good + 1)))
    return at.select("host", "pages", (bad / (bad + good)).alias("reputation"), F.greatest(F.lit(0.0), bad / (bad + good) - Z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """id_col, host, path, rule, verdict, reputation, bound of every page.

    ``outcomes`` (id, bad) has labelled pages, bad being 0 or 1; of several for
    an id the worst counts, nulls are left out, pages with a null id have none.
    A url that is null or has no ``://`` has an empty host and path and is
    judged as the host ''.  Every row comes out, repeated ones repeated; other
    columns are ignored; no pages give no rows.
    """
    url = F.col(f"`{url_col}`").cast("string")
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    known = outcomes.filter("id is not null and bad is not null").groupBy("id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = parsed.join(known, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    counts = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    hosts = counts.join(labelled, "host", "left").na.fill(0, ["n", "k"])
    judged = join_totals(parsed, cut_lineage(host_reputation(hosts)), ["host"], "pages")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), F.round("reputation", 6).alias("reputation"), F.round("bound", 6).alias("bound"))
