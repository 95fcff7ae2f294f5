"""URL filters: rules first, then empirical-Bayes host reputation.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts
with the rule's path; the longest wins. Pages that a rule decides are the labelled outcomes
(block is bad); there are no others, and rules choose their pages by path, so the outcomes
of a host may stand for a part of it only. Its pages without a rule are therefore counted as
exposure: they enter its prior's weight at the prior's mean, and a host of whose pages few
are labelled stays near its domain's rate. Rates are shrunk level by level through
beta-binomial priors: suffix towards the whole, registered domain towards its suffix, host
towards its registered domain. A level's prior weight comes from its over-dispersion by
the method of moments. A page without a rule is blocked if the lower posterior bound of its
host's bad rate is over ``limit``; a host without outcomes has its domain's prior.

DataFrame functions only. Pages are summed by host before anything is shuffled, and the
table of hosts is written once, as all levels are read from it. It meets the pages by a
broadcast while it is small; beyond that a host's pages are dealt out over SALTS tasks, so
that a host with a third of all pages is no single task. A null url, or one without "://",
has an empty host and path, fits no rule and takes the verdict of the empty host. Equal
rows keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import BROADCAST_KEYS
from .scratch import Scratch

#: Fixed values of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Suffixes of two labels under which names are registered; all others are one label.
SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "com.au", "co.jp")
LIMIT = 0.5
Z = 1.645
#: Up to so many rules are folded into the plan; more are joined.
FOLDED_RULES = 200
SALTS = 32

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (its text, or null) and rule_verdict to rows with host and path."""
    spark = pages.sparkSession
    if len(rules) <= FOLDED_RULES:
        rule = verdict = F.lit(None).cast("string")
        for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
            fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
            rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    table = spark.createDataFrame(list(rules), "rule_host string, rule_path string, v string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host", "path").distinct()
    fits = hosts.withColumn("rule_host", F.explode(tails)).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("v"))).alias("best"))
    joined = pages.join(best, ["host", "path"], "left")
    return joined.withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.v")}).drop("best")


def host_levels(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain (one label more) of a host."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    long = last(2).isin(*suffixes)
    return F.when(long, last(2)).otherwise(last(1)), F.when(long, last(3)).otherwise(last(2))


def _shrunk(groups: DataFrame, prior: Column) -> DataFrame:
    """Posterior alpha and beta of rows with bad, n, unseen and a prior mean; the level's prior weight is one number."""
    m = F.least(F.greatest(prior, F.lit(1e-3)), F.lit(1 - 1e-3))
    spread = F.sum((F.col("bad") - F.col("n") * m) ** 2 / (m * (1 - m)))
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    rho = F.when(pairs > 0, (spread - F.sum("n")) / pairs).otherwise(F.lit(0.5))
    rho = F.least(F.greatest(rho, F.lit(0.01)), F.lit(0.99))
    weight = groups.agg((1 / rho - 1).alias("weight"))
    own = F.col("weight") + F.col("unseen")
    alpha, beta = F.col("bad") + own * m, F.col("n") - F.col("bad") + own * (1 - m)
    return groups.join(F.broadcast(weight)).withColumns({"alpha": alpha, "beta": beta}).drop("weight")


def host_counts(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, bad, unseen, suffix, domain): labelled, bad and unlabelled pages of each host."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), (F.count("*") - F.count("bad")).alias("unseen"))
    suffix, domain = host_levels(F.col("host"), suffixes)
    return counts.withColumns({"suffix": suffix, "domain": domain})


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, mean, lower): the posterior of each host's bad rate, from ``host_counts``."""
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "unseen")]
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("prior"))
    tops = _shrunk(hosts.groupBy("suffix").agg(*sums).join(F.broadcast(whole)), F.col("prior")).select("suffix", mean.alias("prior"))
    mids = _shrunk(hosts.groupBy("suffix", "domain").agg(*sums).join(tops, "suffix"), F.col("prior")).select("suffix", "domain", mean.alias("prior"))
    own = _shrunk(hosts.join(mids, ["suffix", "domain"]), F.col("prior"))
    total = F.col("alpha") + F.col("beta")
    return own.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("lower"))


def judge(pages: DataFrame, rules=RULES, suffixes=SUFFIXES, *, limit: float = LIMIT, z: float = Z, few: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = url_parts(F.col("url"))
    parts = with_rule(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    bad = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    hosts = scratch.save(host_counts(parts.select("host", bad.alias("bad")), suffixes), "hosts")
    known = scratch.save(reputation(hosts, z).select("host", (F.col("lower") > limit).alias("shut")), "known")
    if hosts.count() <= few:
        met = parts.join(F.broadcast(known), "host")
    else:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        met = salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
    return met.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("shut"), "block").otherwise("allow")).alias("verdict"))


_SHRUNK_SQL = """
  SELECT *, bad + (w + unseen) * m AS alpha, n - bad + (w + unseen) * (1 - m) AS beta FROM (
    SELECT g.*, 1 / least(greatest(CASE WHEN s.pairs > 0 THEN (s.spread - s.total) / s.pairs ELSE 0.5 END, 0.01), 0.99) - 1 AS w
    FROM {g} g, (SELECT sum(n * (n - 1)) AS pairs, sum(n) AS total, sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) AS spread FROM {g}) s)
"""

ORACLE_SQL = f"""
WITH urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_SMALL}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM urls
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
), outcome AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM ruled
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, count(*) - count(bad) AS unseen, string_split(host, '.') AS l FROM outcome GROUP BY host
), levels AS (
  SELECT host, n, bad, unseen, CASE WHEN array_to_string(l[-2:], '.') IN {SUFFIXES!r} THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
         CASE WHEN array_to_string(l[-2:], '.') IN {SUFFIXES!r} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM hosts
), g1 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, sum(unseen) AS unseen, least(greatest((SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM levels), 0.001), 0.999) AS m FROM levels GROUP BY suffix
), s1 AS ({_SHRUNK_SQL.format(g="g1")}), g2 AS (
  SELECT a.suffix, a.domain, a.n, a.bad, a.unseen, least(greatest(s1.alpha / (s1.alpha + s1.beta), 0.001), 0.999) AS m
  FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, sum(unseen) AS unseen FROM levels GROUP BY suffix, domain) a JOIN s1 USING (suffix)
), s2 AS ({_SHRUNK_SQL.format(g="g2")}), g3 AS (
  SELECT h.host, h.n, h.bad, h.unseen, least(greatest(s2.alpha / (s2.alpha + s2.beta), 0.001), 0.999) AS m FROM levels h JOIN s2 USING (suffix, domain)
), s3 AS ({_SHRUNK_SQL.format(g="g3")}), known AS (
  SELECT host, p - {Z} * sqrt(p * (1 - p) / (t + 1)) > {LIMIT} AS shut FROM (SELECT host, alpha / (alpha + beta) AS p, alpha + beta AS t FROM s3)
)
SELECT page_id, host, path, rule, CASE bad WHEN 1 THEN 'block' WHEN 0 THEN 'allow' ELSE CASE WHEN shut THEN 'block' ELSE 'allow' END END AS verdict
FROM outcome JOIN known USING (host)
"""
