"""URL filter by empirical-Bayes host reputation; DataFrame functions only.

A page's outcome is bad when its label says low quality or toxic.  Outcomes are summed per host, registered domain
and suffix.  Each level's beta prior has the posterior mean of the level above as its mean and a strength estimated
from the spread of its members (moments of the beta-binomial).  A host is blocked when the lower posterior bound of
its bad rate (mean minus ``z`` standard deviations) is above ``max_bad``: few outcomes shrink to the domain, and
hosts without any follow their domain, suffix, or the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import join_groups

Z = 1.645
MAX_BAD = 0.5
#: Prior strength where a level has too few members to estimate one, and the range of estimates.
STRENGTH, LEAST, MOST = 10.0, 1.0, 10000.0
#: Suffixes of two labels that hold without a suffix table; others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za")
#: The suffix that all hosts share which are addresses; each of them is a registered domain of its own.
ADDRESS = "(address)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to / ? # or the end, A-Z in lower case; then the path up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def is_address(bare: Column) -> Column:
    """Dotted numbers, or an address in brackets."""
    return bare.rlike(r"^[0-9]+([.][0-9]+){3}$") | bare.startswith("[")


def suffix_and_domain(host: Column, listed: Column | None = None) -> tuple[Column, Column]:
    """Suffix: ``listed``, else the last label, or two of the fixed ones; registered domain: one label more (the host, if there is none).

    An address has no labels: its suffix is ADDRESS and its domain is the address.
    """
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))
    suffix = suffix if listed is None else F.coalesce(listed, suffix)
    labels = F.split(bare, "[.]")
    # A suffix of n labels leaves the last n + 1 of the host.
    kept = F.least(F.size(F.split(suffix, "[.]")) + 1, F.size(labels))
    domain = F.array_join(F.slice(labels, -kept, kept), ".")
    address = is_address(bare)
    return F.when(address, F.lit(ADDRESS)).otherwise(suffix), F.when(address, bare).otherwise(domain)


def listed_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, ...) with ``listed``: the suffix that a table of rules (suffix) gives, null where none fits.

    The tails of a host's labels become rows that meet the rules by equality.  A rule is a suffix (``com.mx``), a suffix below
    any label (``*.ck``) or an exception (``!www.ck``, whose suffix is one label shorter).  The longest fitting rule holds, and
    an exception before any other.  Null and repeated rules count for nothing.
    """
    labels = F.split(bare_host(F.col("host")), "[.]")
    n = F.size(labels)
    tails = hosts.select("host").distinct().where(~is_address(bare_host(F.col("host")))).select(
        "host", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("tail"))
    below = F.expr("substring(tail, instr(tail, '.') + 1)")
    has_more = F.col("tail").contains(".")
    kinds = F.array_compact(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("tail").alias("rule")),
        F.when(has_more, F.struct(F.lit(0).alias("kind"), F.concat(F.lit("*."), below).alias("rule"))),
        F.struct(F.lit(1).alias("kind"), F.concat(F.lit("!"), F.col("tail")).alias("rule"))))
    asked = tails.select("host", "tail", below.alias("below"), F.explode(kinds).alias("k")).select("host", "tail", "below", "k.kind", "k.rule")
    rules = suffixes.where("suffix is not null").select(F.translate("suffix", UPPER, LOWER).alias("rule")).distinct()
    found = asked.join(rules, "rule").groupBy("host").agg(F.max_by(
        F.when(F.col("kind") == 1, F.col("below")).otherwise(F.col("tail")), F.struct("kind", F.length("tail"))).alias("listed"))
    return hosts.join(found, "host", "left")


def rule_match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _strength() -> Column:
    """Beta prior strength from members with n outcomes of which k are bad: sums n, k, k*k/n, n*n and member count c."""
    over = F.try_divide
    mu = over(F.col("k"), F.col("n"))
    spread = F.col("kk") - F.col("k") * mu
    noise = mu * (1 - mu)
    room = F.col("n") - over(F.col("nn"), F.col("n")) - (F.col("c") - 1)
    rho = over(spread - noise * (F.col("c") - 1), noise * room)
    held = F.greatest(F.least(rho, F.lit(1 / (1 + LEAST))), F.lit(1 / (1 + MOST)))
    return F.when((F.col("c") > 2) & (noise > 0) & (room > 0), (1 - held) / held).otherwise(F.lit(STRENGTH))


def _sums(members: DataFrame, *keys: str) -> DataFrame:
    """Members' outcomes, of those that have any, summed per key; rows counts the members."""
    return members.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.coalesce(F.try_divide(F.col("k") * F.col("k"), F.col("n")), F.lit(0.0))).alias("kk"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"), F.count(F.when(F.col("n") > 0, 1)).alias("c"), F.count("*").alias("members"))


def _posterior(mean: str, strength: str) -> Column:
    return (F.col("k") + F.col(mean) * F.col(strength)) / (F.col("n") + F.col(strength))


def reputations(hosts: DataFrame, z: float = Z, suffix_rules: DataFrame | None = None) -> DataFrame:
    """(host, pages, n, k) -> the same with bad_bound.  Hosts, domains and suffixes are joined as tables of any size."""
    if suffix_rules is not None:
        hosts = listed_suffixes(hosts, suffix_rules)
    suffix, domain = suffix_and_domain(F.col("host"), None if suffix_rules is None else F.col("listed"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    domains = cut_lineage(_sums(hosts, "domain", "suffix").withColumn("host_strength", _strength()).withColumnRenamed("members", "hosts"))
    suffixes = _sums(domains.select("suffix", "n", "k"), "suffix").withColumn("domain_strength", _strength()).withColumnRenamed("members", "domains")
    mean, strength = _sums(suffixes.select("n", "k")).select(
        F.coalesce((F.col("k") + 1) / (F.col("n") + 2), F.lit(0.5)), _strength()).first()
    tops = cut_lineage(suffixes.withColumn("_mean", F.lit(mean)).withColumn("_strength", F.lit(strength)).withColumn(
        "suffix_mean", _posterior("_mean", "_strength")).select("suffix", "suffix_mean", "domain_strength", "domains"))
    n_hosts, n_domains = hosts.count(), domains.count()
    middle = join_groups(domains, tops, "suffix", "domains", n_domains).withColumn(
        "domain_mean", _posterior("suffix_mean", "domain_strength")).select("domain", "domain_mean", "host_strength", F.col("hosts").alias("_hosts"))
    scored = join_groups(hosts, cut_lineage(middle), "domain", "_hosts", n_hosts)
    a = F.col("k") + F.col("domain_mean") * F.col("host_strength")
    b = F.col("n") - F.col("k") + (1 - F.col("domain_mean")) * F.col("host_strength")
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return scored.select("host", "pages", "n", "k", (mean - z * deviation).alias("bad_bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], z: float = Z, max_bad: float = MAX_BAD,
                suffix_rules: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_labelled, host_bad, bad_bound.

    ``pages`` (page_id, url), ``labels`` (doc_id, quality, toxic) with doc_id naming the page; several labels of one
    page count as its worst, null marks as good.  Null urls, or urls without ``://``, have empty host and path and are
    judged as one host.  Null page ids have no label.  Repeated pages count and are returned each time.
    ``suffix_rules`` (suffix) are rules of public suffixes, see :func:`listed_suffixes`; without them a short fixed list holds.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))
    hosts = cut_lineage(parsed.select("page_id", "host").join(outcomes, "page_id", "left").groupBy("host").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    known = cut_lineage(reputations(hosts, z, suffix_rules))
    rule, ruled = rule_match(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return join_groups(parsed, known, "host", "pages", total).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("k").alias("host_bad"), "bad_bound")
