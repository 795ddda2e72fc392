"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are summed per host, registered domain and
suffix.  Each level is shrunk towards the one above by a beta-binomial prior:
its mean is the posterior mean of the parent, its strength is fitted by moments
over all siblings of the level.  A host is blocked where the lower bound of its
posterior bad rate exceeds a limit.

Only (host, domain, suffix) sums are shuffled, combined before the shuffle, and
the pages are joined to hosts by a plain equi-join that adaptive execution may
split where a host is hot or turn into a broadcast where the hosts are few.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the verdict of the overall rate; null labels count as
unlabelled; repeated rows give repeated results; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm.scratch import store

# The rules of the contract, (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Suffixes of two labels under which a registered domain has three.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
BLOCK_RATE = 0.5
#: Standard deviations between the posterior mean and the bound.
Z = 1.645
#: Pseudo-counts of the weakest and strongest prior that the moments may ask for.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return F.when((F.size(labels) > 1) & two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more, or the host if it has no more."""
    labels, n = F.split(host, r"\."), F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # later ones, which are longer, take precedence
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _strength(level: DataFrame) -> DataFrame:
    """One row: pseudo-counts of the beta prior of a level with n, bad and prior mean m.

    By moments: E[(r - m)^2] over units is m(1-m)/n + m(1-m)/(s+1) * (1 - 1/n), so the
    spread that binomial noise doesn't explain gives s.
    """
    noise = F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) - noise)
    weight = F.sum((F.col("n") - 1) * noise)
    rho = F.when(weight > 0, spread / F.nullif(weight, F.lit(0.0)))
    s = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(MAX_STRENGTH))
    return level.where(F.col("n") > 0).agg(
        F.least(F.greatest(F.coalesce(s, F.lit(MAX_STRENGTH)), F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("s")
    )


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds post (posterior mean) and total (posterior pseudo-counts) to (n, bad, m)."""
    s = _strength(level).first()["s"]  # one number
    s = MAX_STRENGTH if s is None else float(s)
    return level.withColumn("total", F.col("n") + F.lit(s)).withColumn(
        "post", (F.col("bad") + F.col("m") * F.lit(s)) / F.col("total")
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: rows (host, bad 0/1 or null).  One row per host: n, bad, post, bound."""
    rows = outcomes.select("host", F.col("bad").cast("double").alias("bad"))
    hosts = rows.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")
    )
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = store(hosts, "hosts")  # pages are read once for it; all that follows reads one row a host
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(*sums).first()
    mean = (float(overall["bad"] or 0.0) + 1.0) / (float(overall["n"] or 0.0) + 2.0)
    suffixes = _shrunk(suffixes.withColumn("m", F.lit(mean)))
    up = lambda level, key: level.select(key, F.col("post").alias("m"))
    domains = _shrunk(domains.join(up(suffixes, "suffix"), "suffix"))
    hosts = _shrunk(hosts.join(up(domains, "domain"), "domain"))
    sd = F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("total") + 1))
    return hosts.select("host", "n", "bad", "post", (F.col("post") - Z * sd).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict of every page: the longest rule's, else that of its host's posterior bound.

    labels: rows (doc_id, toxic) whose doc_id is the page_id of the labelled page; any
    positive label of a page counts as a bad outcome.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    bad = bad.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("bad"))
    outcomes = rows.select("page_id", "host").join(bad, "page_id", "left")
    known = host_reputation(outcomes)
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    return (
        rows.join(known.select("host", "bound", "post"), "host", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("bound") > BLOCK_RATE, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", F.col("post").alias("bad_rate"), F.col("bound").alias("bad_bound"))
    )
