"""Findings brought up to date with each other: what call sites prove about a declared library.

A dependency finding of a reconcilable library, declared directly in a ``package.json``, is
eased if the library's call sites in that package are decisive: at least one is resolved
(confirmed), and every one names a symmetric algorithm. A site belongs to the deepest package
above it that declares the library. A target whose source scan left something out is not
touched. Findings go in and come out, all rows and columns, only verdicts changed.

Sites are counted and judged with partial aggregates; the few that are cited come from the
first of each of SALTS parts of a package's sites, so a package may hold most of all rows.
Rows without a path are no sites; null confidences are not confirmed; a null rule is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (dependency rule, library, beginning of the rules of its call sites), rules that tell of an incomplete source scan.
RECONCILABLE = (("deps/npm-jsonwebtoken", "jsonwebtoken", "jwt/jsonwebtoken/"),)
INCOMPLETE = ("source/scan-truncated", "source/unreadable-path", "source/ast-fallback", "source/findings-capped")
SALTS = 64


def directory(path):
    """The directory of a path, "" for the root."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def owned_sites(findings: DataFrame) -> DataFrame:
    """Call sites of reconcilable libraries with the library's rule (dep) and the package (dir) that each belongs to."""
    libraries = F.broadcast(findings.sparkSession.createDataFrame(RECONCILABLE, "dep string, library string, sites string"))
    rows = findings.where("path is not null")
    direct = rows.where((F.col("category") == "deps") & (F.element_at(F.split("path", "/"), -1) == "package.json"))
    dirs = direct.join(libraries, F.col("rule_id") == F.col("dep")).select("target", "dep", directory("path").alias("dir")).distinct()
    sites = rows.join(libraries, F.startswith("rule_id", F.col("sites"))).select("target", "ord", "dep", "path", "rule_id", "confidence", "algorithm", "evidence")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = sites.withColumn("dir", F.explode(above)).join(dirs, ["target", "dep", "dir"])
    deepest = F.max_by(F.struct("dir", "rule_id", "confidence", "algorithm", "evidence"), F.length("dir"))
    return met.groupBy("target", "ord", "dep", "path").agg(deepest.alias("s")).select("target", "ord", "dep", "path", "s.*")


def verdicts(findings: DataFrame, shown: int = 5) -> DataFrame:
    """(target, dep, dir, sites, cited): packages whose sites are decisive, in targets whose source scan is whole."""
    owned = owned_sites(findings)
    judged = owned.groupBy("target", "dep", "dir").agg(
        F.count("*").alias("sites"), F.bool_or(F.coalesce(F.col("confidence") == "confirmed", F.lit(False))).alias("resolved"), F.bool_and(F.rlike("rule_id", F.lit("/hmac$"))).alias("symmetric")
    ).where("resolved and symmetric")
    package, order = ["target", "dep", "dir"], ["ord", "path"]
    salted = owned.withColumn("salt", F.pmod(F.xxhash64("ord", "path"), F.lit(SALTS)))
    few = salted.withColumn("k", F.row_number().over(Window.partitionBy(*package, "salt").orderBy(*order))).where(F.col("k") <= shown)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy(*package).orderBy(*order))).where(F.col("k") <= shown)
    text = F.concat(F.coalesce(F.regexp_replace("algorithm", "^JWT-", ""), F.lit("HMAC")), F.lit(" at "), F.coalesce("evidence", "path"))
    cited = first.groupBy(*package).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("text")))), lambda c: c["text"]), ", ").alias("cited"))
    gaps = findings.where(F.col("rule_id").isin(*INCOMPLETE)).select("target").distinct()
    more = F.when(F.col("sites") > shown, F.format_string("%s, and %d more", "cited", F.col("sites") - shown)).otherwise(F.col("cited"))
    return judged.join(cited, package).join(gaps, "target", "left_anti").select(*package, "sites", more.alias("cited"))


def updated(findings: DataFrame, shown: int = 5) -> DataFrame:
    """``findings`` with the verdicts of ``verdicts`` applied to the direct dependencies they are about.

    Takes target, ord, rule_id, category, severity, pq_status, confidence, algorithm, path, evidence and recommendation; other columns stay.
    """
    proved = verdicts(findings, shown).select(F.col("target").alias("_target"), F.col("dep").alias("_dep"), F.col("dir").alias("_dir"), F.col("sites").alias("_sites"), F.col("cited").alias("_cited"))
    direct = (F.col("category") == "deps") & (F.element_at(F.split("path", "/"), -1) == "package.json")
    met = findings.join(proved, direct & F.col("target").eqNullSafe(F.col("_target")) & (F.col("rule_id") == F.col("_dep")) & (directory("path") == F.col("_dir")), "left")
    eased = F.col("_dep").isNotNull()
    where = F.when(F.col("_dir") == "", "the root").otherwise(F.concat(F.col("_dir"), F.lit("/")))
    told = F.format_string("All %d call sites of the package at %s use HMAC (symmetric): %s. Its public-key paths are not in use there. %s", "_sites", where, "_cited", F.coalesce("recommendation", F.lit("")))
    values = {"severity": F.lit("low"), "pq_status": F.lit("transitional"), "confidence": F.lit("high"), "recommendation": told}
    return met.select(*[F.when(eased, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in findings.columns])
