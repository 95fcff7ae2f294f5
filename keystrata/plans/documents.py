"""Registered queries over further lock files, identifiers of signatures and whole SARIF logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions import oids, vocabulary
from keystrata.operators import manifests, reports
from keystrata.sources.fixtures import LOCKED, fixture

from .queries import query

_DECLARED = ", ".join(f"({k}, '{name}', '{version}', {str(whole).lower()})" for k, name, version, whole in LOCKED)


def _declared(columns: str, *numbers: int) -> str:
    """What the lock files of these numbers declare, by the fixture's own answers."""
    return f"""SELECT target, path, name, replace(version, '@v', fill) AS version{columns} FROM lock_files JOIN (VALUES {_DECLARED}) AS d(k, name, version, whole) ON number = k
    WHERE number IN ({", ".join(map(str, numbers))})"""


@query(_declared(", whole", 0, 1, 2), "lock_files")
def deps_npm_lock_v1(spark, sf_dir):
    return manifests.npm_lock_v1(fixture(spark, sf_dir, "lock_files"))


@query(_declared("", 3, 4), "lock_files")
def deps_pnpm(spark, sf_dir):
    return manifests.pnpm_lock(fixture(spark, sf_dir, "lock_files"))


@query(_declared("", 5, 6), "lock_files")
def deps_pipfile_lock(spark, sf_dir):
    return manifests.pipfile_lock(fixture(spark, sf_dir, "lock_files"))


_ARC = "CAST(regexp_extract(oid, '[0-9]+$') AS INT)"
_SET = "concat(['SHA2', 'SHAKE'][{0} // 6 + 1], '-', ['128', '192', '256'][{0} % 6 // 2 + 1], ['s', 'f'][{0} % 2 + 1])"


@query(
    f"""SELECT event_id, CASE WHEN oid LIKE '1.3.101.%' THEN CASE n WHEN 112 THEN 'Ed25519' WHEN 113 THEN 'Ed448' END
    WHEN oid LIKE '1.2.840.10045.4.3.%' AND n BETWEEN 1 AND 4 THEN concat('ecdsaWithSHA', ['224', '256', '384', '512'][n])
    WHEN oid LIKE '1.2.840.113549.%' THEN CASE WHEN n = 10 THEN 'rsassaPss' WHEN n IN (2, 3, 4, 5, 11, 12, 13, 14) THEN concat(['md2', 'md4', 'md5', 'sha1', '', '', '', '', '', 'sha256', 'sha384', 'sha512', 'sha224'][n - 1], 'WithRSAEncryption') END
    WHEN oid LIKE '2.16.840.%' THEN CASE WHEN n BETWEEN 1 AND 2 THEN concat('dsaWithSHA', ['224', '256'][n]) WHEN n BETWEEN 17 AND 19 THEN concat('ML-DSA-', ['44', '65', '87'][n - 16])
      WHEN n BETWEEN 20 AND 31 THEN concat('SLH-DSA-', {_SET.format("(n - 20)")}) WHEN n BETWEEN 32 AND 34 THEN concat('HashML-DSA-', ['44', '65', '87'][n - 31], '-with-SHA512')
      WHEN n BETWEEN 35 AND 46 THEN concat('HashSLH-DSA-', {_SET.format("(n - 35)")}, '-with-', CASE WHEN n IN (35, 36) THEN 'SHA256' WHEN n < 41 THEN 'SHA512' WHEN n IN (41, 42) THEN 'SHAKE128' ELSE 'SHAKE256' END) END END AS name
    FROM (SELECT *, {_ARC} AS n FROM oids)""",
    "oids",
)
def oid_names(spark, sf_dir):
    return fixture(spark, sf_dir, "oids").select("event_id", oids.signature_name(F.col("oid")).alias("name"))


_PASCAL = "array_to_string([concat(upper(w[1]), w[2:]) for w in string_split_regex(rule_id, '[^A-Za-z0-9]+') if w <> ''], '')"


@query(
    f"""SELECT target, 0 AS part, 0 AS ord, '{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"keystrata","rules":[' AS line FROM findings GROUP BY target
    UNION ALL SELECT target, 1, k, concat(CASE WHEN k > 0 THEN ',' ELSE '' END, '{{"id":"', rule_id, '","name":"', {_PASCAL}, '"}}') FROM (SELECT target, rule_id, row_number() OVER (PARTITION BY target ORDER BY rule_id) - 1 AS k FROM findings GROUP BY target, rule_id)
    UNION ALL SELECT target, 2, 0, ']}}}},"results":[' FROM findings GROUP BY target
    UNION ALL SELECT target, 3, ord, concat(CASE WHEN r > 1 THEN ',' ELSE '' END, '{{"ruleId":"', rule_id, '","ruleIndex":', k, ',"level":"', CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END,
      '","rank":', CASE severity WHEN 'critical' THEN '95' WHEN 'high' THEN '80' WHEN 'medium' THEN '50' WHEN 'low' THEN '30' ELSE '0' END, ',"message":{{"text":"', concat_ws(': ', rule_id, algorithm), '"}}',
      CASE WHEN host IS NULL THEN '' ELSE concat(',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"tls://', host, ':', port, '"}}}},"logicalLocations":[{{"name":"', host, ':', port, '","kind":"resource","fullyQualifiedName":"', host, ':', port, '"}}]}}]') END,
      ',"properties":{{"severity":"', severity, '","security-severity":"', CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '3.0' ELSE '0.0' END, '","pq_status":"', pq_status, '"}}}}')
      FROM (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY rule_id) - 1 AS k, row_number() OVER (PARTITION BY target ORDER BY ord) AS r FROM findings)
    UNION ALL SELECT target, 4, 0, concat('],"properties":{{"target":"', target, '"}}}}]}}') FROM findings GROUP BY target""",
    "findings",
)
def sarif_document(spark, sf_dir):
    return reports.sarif_lines(fixture(spark, sf_dir, "findings"))


@query("SELECT p_partkey, params AS parameter_set, curve, bits, mode FROM label_details", "label_details")
def algorithm_details(spark, sf_dir):
    return fixture(spark, sf_dir, "label_details").select("p_partkey", vocabulary.details(F.col("label")).alias("d")).select("p_partkey", "d.*")
