"""Queries over JavaScript calls resolved to their modules, and over findings that they change."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import reconcile, resolved, source
from keystrata.sources.fixtures import fixture

from .queries import query

_CALLS = "SELECT target, path, strpos(code, needle) - 1 AS at, 1 + len(substr(code, 1, CAST(strpos(code, needle) - 1 AS BIGINT))) - len(replace(substr(code, 1, CAST(strpos(code, needle) - 1 AS BIGINT)), chr(10), '')) AS line, rule, algorithm, bits, confidence, severity FROM script_calls"


@query(_CALLS, "script_calls")
def resolved_calls(spark, sf_dir):
    return resolved.resolved_calls(fixture(spark, sf_dir, "scripts")).drop("api", "method")


@query(f"SELECT rule, confidence, count(*) AS calls, count(DISTINCT path) AS files, count(*) FILTER (algorithm IS NULL) AS at_runtime FROM ({_CALLS}) GROUP BY rule, confidence", "script_calls")
def resolved_rules(spark, sf_dir):
    rows = resolved.resolved_calls(fixture(spark, sf_dir, "scripts"))
    return rows.groupBy("rule", "confidence").agg(F.count("*").alias("calls"), F.countDistinct("path").alias("files"), F.count_if(F.col("algorithm").isNull()).alias("at_runtime"))


# The oracle's own statement: packages by the beginning of their paths, the deepest one owns a site.
_VERDICTS = """
packages AS (SELECT DISTINCT target, path[1:length(path) - 12] AS stem FROM scanned WHERE rule_id = 'deps/npm-jsonwebtoken' AND path LIKE '%package.json'),
owned AS (SELECT target, ord, path, any_value(rule_id) AS rule_id, any_value(confidence) AS confidence, any_value(algorithm) AS algorithm, any_value(evidence) AS evidence, arg_max(stem, length(stem)) AS stem
  FROM scanned JOIN packages USING (target) WHERE rule_id LIKE 'jwt/jsonwebtoken/%' AND starts_with(path, stem) GROUP BY target, ord, path),
verdict AS (SELECT target, stem, count(*) AS sites, concat(array_to_string(list(concat(coalesce(replace(algorithm, 'JWT-', ''), 'HMAC'), ' at ', evidence) ORDER BY ord, path)[1:5], ', '), CASE WHEN count(*) > 5 THEN concat(', and ', count(*) - 5, ' more') ELSE '' END) AS cited
  FROM owned WHERE target NOT IN (SELECT target FROM scanned WHERE rule_id = 'source/ast-fallback') GROUP BY target, stem HAVING bool_or(confidence = 'confirmed') AND bool_and(rule_id LIKE '%/hmac'))"""


@query(f", {_VERDICTS} SELECT target, trim(stem, '/') AS dir, sites, cited FROM verdict", "scanned")
def reconcile_verdicts(spark, sf_dir):
    return reconcile.verdicts(fixture(spark, sf_dir, "scanned")).drop("dep")


@query(
    f""", {_VERDICTS} SELECT target, ord, rule_id, path, CASE WHEN sites IS NULL THEN severity ELSE 'low' END AS severity, CASE WHEN sites IS NULL THEN pq_status ELSE 'transitional' END AS pq_status, CASE WHEN sites IS NULL THEN confidence ELSE 'high' END AS confidence,
    CASE WHEN sites IS NULL THEN recommendation ELSE concat('All ', sites, ' call sites of the package at ', CASE WHEN stem = '' THEN 'the root' ELSE stem END, ' use HMAC (symmetric): ', cited, '. Its public-key paths are not in use there. ', recommendation) END AS recommendation
    FROM scanned s LEFT JOIN verdict v ON s.target = v.target AND s.rule_id = 'deps/npm-jsonwebtoken' AND s.path = concat(v.stem, 'package.json')""".replace("SELECT target, ord, rule_id, path, CASE", "SELECT s.target, ord, rule_id, path, CASE"),
    "scanned",
)
def reconciled_findings(spark, sf_dir):
    return reconcile.updated(fixture(spark, sf_dir, "scanned")).select("target", "ord", "rule_id", "path", "severity", "pq_status", "confidence", "recommendation")


@query("SELECT target, path, rule, severity, CASE WHEN severity = 'low' THEN 'unknown' ELSE 'vulnerable' END AS pq_status, signal FROM digest_files", "digest_files")
def hash_role_uses(spark, sf_dir):
    files = fixture(spark, sf_dir, "digest_files").select("target", "path", "content")
    return source.assessed(source.match(files, ("javascript", "python", "go", "java"))).select("target", "path", "rule", "severity", "pq_status", "signal")
