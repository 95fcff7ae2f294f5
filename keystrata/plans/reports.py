"""Registered queries over lock files, algorithm labels, usage and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions.vocabulary import described
from keystrata.operators import manifests, reports, risk
from keystrata.sources.fixtures import fixture

from .queries import query


@query(
    r"""SELECT target, path, regexp_extract(key, 'node_modules/((@[^/]+/)?[^/]+)$', 1) AS name, version FROM
    (SELECT *, json_extract_string(content, concat('$.packages."', key, '".version')) AS version FROM (SELECT *, unnest(json_keys(content, '$.packages')) AS key FROM manifests WHERE path LIKE '%/package-lock.json'))
    WHERE key LIKE '%node_modules/%' AND version IS NOT NULL""",
    "manifests",
)
def deps_npm_lock(spark, sf_dir):
    return manifests.npm_lock(fixture(spark, sf_dir, "manifests"))


@query(
    r"""SELECT target, path, regexp_extract(part, '^"?((@[^/@"]+/)?[^@"]+)@', 1) AS name, split_part(split_part(part, 'version "', 2), '"', 1) AS version
    FROM (SELECT *, unnest(string_split(content, concat(chr(10), chr(10)))) AS part FROM manifests WHERE path LIKE '%/yarn.lock') WHERE part LIKE '%version "%'""",
    "manifests",
)
def deps_yarn(spark, sf_dir):
    return manifests.yarn_lock(fixture(spark, sf_dir, "manifests"))


@query(
    r"""SELECT target, path, regexp_extract(item, '^[A-Za-z0-9]+') AS name, trim(regexp_replace(split_part(item, ';', 1), '^[A-Za-z0-9]+(\[[a-z]+\])?', '')) AS version
    FROM (SELECT *, unnest(regexp_extract_all(split_part(split_part(content, 'dependencies = [', 2), chr(10), 1), '"([^"]*)"', 1)) AS item FROM manifests WHERE path LIKE '%/pyproject.toml')
    UNION ALL SELECT target, path, split_part(line, ' ', 1), split_part(line, '"', 2)
    FROM (SELECT *, unnest(string_split(split_part(content, '[tool.poetry.dependencies]', 2), chr(10))) AS line FROM manifests WHERE path LIKE '%/pyproject.toml') WHERE line LIKE '% = "%' AND line NOT LIKE 'python %'""",
    "manifests",
)
def deps_toml(spark, sf_dir):
    return manifests.pyproject(fixture(spark, sf_dir, "manifests"))


@query(
    """SELECT algorithm, CASE WHEN algorithm IN ('MD5', 'SHA-1') THEN 'hash' WHEN algorithm = 'DES' THEN 'block-cipher' WHEN algorithm LIKE 'ECDH%' THEN 'key-agree' WHEN algorithm = 'JWT-HS256' THEN 'mac'
    WHEN algorithm = 'JWT-none' THEN 'other' WHEN algorithm = 'MLKEM1024' THEN 'kem' ELSE 'signature' END AS primitive,
    CASE algorithm WHEN 'JWT-HS256' THEN NULL WHEN 'MLKEM1024' THEN 5 ELSE 0 END AS level, count(*) AS findings FROM findings WHERE algorithm IS NOT NULL GROUP BY algorithm""",
    "findings",
)
def describe_algorithms(spark, sf_dir):
    labels = fixture(spark, sf_dir, "findings").where("algorithm is not null").groupBy("algorithm").agg(F.count("*").alias("findings"))
    return labels.withColumn("d", described(F.col("algorithm"))).select("algorithm", "d.primitive", "d.level", "findings")


@query(
    """SELECT target, ord, CASE WHEN usage <> '' THEN usage WHEN rule_id = 'tls/hybrid-kex' THEN 'key-establishment' WHEN rule_id = 'tls/leaf-public-key' THEN 'authentication' WHEN rule_id = 'tls/leaf-signature' THEN 'signature'
    WHEN rule_id = 'tls/negotiated-protocol' THEN 'protocol' WHEN rule_id LIKE 'keys/private-key%' THEN 'secret-material' WHEN rule_id LIKE 'jwt/%' THEN 'authentication' ELSE '' END AS uses FROM findings""",
    "findings",
)
def resolve_usage(spark, sf_dir):
    return risk.with_threats(fixture(spark, sf_dir, "findings")).select("target", "ord", F.array_join("uses", ",").alias("uses"))


@query(
    """SELECT target, ord, CASE WHEN rule_id LIKE 'keys/%' THEN 'secret material' WHEN classical_break IS NOT NULL THEN classical_break WHEN pq_status <> 'vulnerable' THEN NULL WHEN algorithm = 'MD5' THEN 'collision-broken digest'
    WHEN algorithm = 'SHA-1' THEN 'sha-1' WHEN algorithm = 'DES' THEN 'broken cipher' WHEN algorithm = 'JWT-none' THEN 'alg none' WHEN algorithm = 'RSA-1024' THEN 'below minimum strength' END AS reason FROM findings""",
    "findings",
)
def classical_break(spark, sf_dir):
    return risk.with_threats(fixture(spark, sf_dir, "findings")).select("target", "ord", "reason")


@query("SELECT target, ord, CAST(to_json({'rule_id': rule_id, 'category': category, 'severity': severity, 'pq_status': pq_status, 'algorithm': algorithm, 'context': context}) AS VARCHAR) AS line FROM findings", "findings")
def report_json(spark, sf_dir):
    return reports.json_rows(fixture(spark, sf_dir, "findings"))


@query(r"SELECT target, ord, concat('| ', upper(severity), ' | ', rule_id, ' | ', coalesce(algorithm, ''), ' |') AS line FROM findings", "findings")
def report_markdown(spark, sf_dir):
    return reports.markdown_rows(fixture(spark, sf_dir, "findings"))


@query("SELECT target, ord, CAST(dense_rank() OVER (PARTITION BY target ORDER BY rule_id) - 1 AS INT) AS rule_index, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'low' THEN 'note' ELSE 'none' END AS level FROM findings", "findings")
def sarif_results(spark, sf_dir):
    return reports.results(fixture(spark, sf_dir, "findings"))
