"""Registered queries over bills of cryptographic materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.operators import cbom
from keystrata.operators.ranks import ranked
from keystrata.sources.fixtures import fixture

from .queries import _PQ, _SEV, query

SCANNED_AT = "1996-01-01T00:00:00Z"


def findings(spark, sf_dir) -> DataFrame:
    """The fixture's rows with their certificate, where they have one, as an array; its key is an RSA key."""
    cert = F.struct(
        "subject", "issuer", "not_before", "not_after", F.col("algorithm").alias("signature_algorithm"), F.col("oid").alias("signature_oid"), F.lit("RSA-2048").alias("public_key"), F.lit(2048).alias("public_key_bits")
    )
    return fixture(spark, sf_dir, "assets").withColumn("certificates", F.when(F.col("subject").isNotNull(), F.array(cert)))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_ALG = "concat('crypto/algorithm/', " + _SLUG + ")"
_HEX = "substr(sha256({0}), 1, 16)"
_AT = "concat('tls://', CASE WHEN host LIKE '%:%' THEN concat('[', host, ']') ELSE host END, CASE WHEN port IS NOT NULL THEN concat(':', port) ELSE '' END)"
_PLACED = f", placed AS (SELECT *, coalesce(path, CASE WHEN host IS NOT NULL THEN {_AT} END) AS location, CASE WHEN path IS NOT NULL AND line > 0 THEN line END AS at_line FROM assets)"
_IDENTITY = _HEX.format("concat(subject, '|', coalesce(issuer, ''), '|', not_after, '|RSA-2048')")
_LEAF = f""", leaf AS (SELECT target, location AS endpoint, min(ord) FILTER (told) AS ord, arg_max(algorithm, (ord, id)) FILTER (told AND rule_id = 'tls/leaf-signature') AS signature, arg_max(oid, (ord, id)) FILTER (told AND rule_id = 'tls/leaf-signature') AS signature_oid,
  arg_max(algorithm, (ord, id)) FILTER (told AND rule_id = 'tls/leaf-public-key') AS key FROM (SELECT *, algorithm IS NOT NULL AND rule_id IN ('tls/leaf-signature', 'tls/leaf-public-key') AS told FROM placed WHERE host IS NOT NULL) GROUP BY target, location HAVING NOT bool_or(subject IS NOT NULL) AND bool_or(told))"""
_PROVIDED = ", provided AS (SELECT * FROM (VALUES " + ", ".join(f"('deps/{e}-{n}', '{e}', '{n}', {k}, '{label}')" for e, n, labels in dims.PROVIDED for k, label in enumerate(labels.split())) + ") AS v(rule_id, kind, library, pos, label))"
# Purls of the fixture's libraries, by hand: (rule, purl, version, range).
_LIBRARIES = ", libraries AS (SELECT * FROM (VALUES ('deps/npm-tweetnacl', '1.0.3', 'pkg:npm/tweetnacl@1.0.3', 'tweetnacl', '1.0.3', NULL), ('deps/npm-tweetnacl', '', 'pkg:npm/tweetnacl', 'tweetnacl', NULL, NULL), ('deps/npm-jsonwebtoken', '^9.0.2', 'pkg:npm/jsonwebtoken', 'jsonwebtoken', NULL, '^9.0.2'), ('deps/other', '==2.0.0-rc.1', 'pkg:npm/%40scope/pkg@2.0.0-rc.1', '@scope/pkg', '2.0.0-rc.1', NULL), ('deps/pypi-pynacl', '>=1.5', 'pkg:pypi/py-nacl', 'Py_NaCl', NULL, '>=1.5')) AS v(rule_id, version, purl, name, pinned, declared))"
_DEPS = "placed p JOIN libraries l ON p.rule_id = l.rule_id AND coalesce(p.version, '') = l.version"
_SCHEME = "CASE protocol WHEN 'TLS' THEN 'tls' ELSE 'other' END"
_OWN = f"SELECT target, ord, id, severity, pq_status, location, at_line, {{pos}} AS pos, {{ref}} AS ref, '{{kind}}' AS kind, {{name}} AS name, {{oid}} AS oid, true AS seen FROM placed WHERE {{where}}"


def _own(kind: str, ref: str, name: str, where: str, pos: int = 0, oid: str = "NULL") -> str:
    return _OWN.format(kind=kind, ref=ref, name=name, where=where, pos=pos, oid=oid)


_CLAIMS = (
    _PLACED
    + _LEAF
    + _PROVIDED
    + _LIBRARIES
    + ", claims AS ("
    + " UNION ALL ".join(
        (
            _own("algorithm", _ALG.format("algorithm"), "algorithm", "subject IS NOT NULL", 0, "oid"),
            _own("algorithm", "'crypto/algorithm/rsa-2048'", "'RSA-2048'", "subject IS NOT NULL", 1),
            _own("key", f"concat('crypto/key/public/', {_IDENTITY})", "concat(subject, ' public key')", "subject IS NOT NULL", 2),
            _own("certificate", f"concat('crypto/certificate/', {_IDENTITY})", "subject", "subject IS NOT NULL", 3),
            _own("algorithm", _ALG.format("algorithm"), "algorithm", "category <> 'deps' AND subject IS NULL AND algorithm IS NOT NULL", 3, "oid"),
            _own("key", "concat('crypto/key/', CASE WHEN rule_id LIKE '%private%' THEN 'private/' ELSE 'public/' END, " + _HEX.format("concat(rule_id, '|', location, CASE WHEN at_line IS NOT NULL THEN concat(':', at_line) ELSE '' END)") + ")",
                 "concat(CASE WHEN rule_id LIKE '%private%' THEN 'Private' ELSE 'Public' END, ' key material (', location, CASE WHEN at_line IS NOT NULL THEN concat(':', at_line) ELSE '' END, ')')", "category = 'keys'", 4),
            _own("algorithm", _ALG.format("grp"), "grp", "grp IS NOT NULL"),
            _own("protocol", f"concat('crypto/protocol/', CASE WHEN protocol = 'TLS' THEN 'tls-1-3-' ELSE 'other-unknown-' END, {_HEX.format('location')})", f"concat(upper({_SCHEME}), CASE WHEN protocol = 'TLS' THEN ' 1.3' ELSE '' END, ' (', location, ')')", "rule_id = 'tls/negotiated-protocol'", 1),
            f"SELECT target, ord, id, severity, pq_status, location, at_line, 9, l.purl, 'library', l.name, NULL, true FROM {_DEPS}",
            f"SELECT target, ord, id, NULL, NULL, NULL, NULL, pos, {_ALG.format('label')}, 'algorithm', label, NULL, false FROM placed JOIN provided USING (rule_id)",
            f"SELECT target, 1e18, '', NULL, NULL, NULL, NULL, 0, {_ALG.format('signature')}, 'algorithm', signature, signature_oid, false FROM leaf WHERE signature IS NOT NULL",
            f"SELECT target, 1e18, '', NULL, NULL, NULL, NULL, 0, {_ALG.format('key')}, 'algorithm', key, NULL, false FROM leaf WHERE key IS NOT NULL",
        )
    )
    + ")"
)


def _named(values: tuple[str, ...], rank: str) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


@query(
    _CLAIMS + f""" SELECT target, ref, arg_min(kind, (ord, pos)) AS kind, arg_min(name, (ord, pos)) AS name, {_named(dims.PQ_STATUSES, f"min({_PQ}) FILTER (seen)")} AS pq_status, {_named(dims.SEVERITIES, f"min({_SEV}) FILTER (seen)")} AS severity,
    count(DISTINCT id) FILTER (seen) AS findings, count(DISTINCT concat(location, '#', at_line)) FILTER (seen AND location IS NOT NULL) AS places FROM claims GROUP BY target, ref""",
    "assets",
)
def cbom_assets(spark, sf_dir):
    """Every asset and library that is not made from leaf findings alone, with its worst verdicts and how much it lists."""
    claimed = cbom.claims(findings(spark, sf_dir)).where("at.phase = 0 or kind = 'algorithm'")
    count = lambda what: F.count_if(F.col("list") == what).alias(what + "s")
    listed = cbom.items(claimed).groupBy("target", "ref").agg(count("finding"), count("place"))
    rows = cbom.components(claimed).select("target", "ref", "kind", "name", "pq_status", "severity").join(listed, ["target", "ref"], "left")
    return rows.fillna(0, ["findings", "places"])


@query(
    _PLACED + f""" SELECT DISTINCT target, concat('crypto/certificate/', {_IDENTITY}) AS ref, subject, coalesce(issuer, '') AS issuer, CASE WHEN not_before LIKE '%Z' THEN not_before END AS not_before, CASE WHEN not_after NOT LIKE '1997-02-30%' THEN not_after END AS not_after,
    {_ALG.format("algorithm")} AS signature_ref, concat('crypto/key/public/', {_IDENTITY}) AS key_ref FROM (SELECT *, row_number() OVER (PARTITION BY target, {_IDENTITY} ORDER BY ord) AS n FROM placed WHERE subject IS NOT NULL) WHERE n = 1""",
    "assets",
)
def cbom_certificates(spark, sf_dir):
    """Certificates with their validity, where it is a time, and the assets of their signature and key."""
    rows = cbom.components(cbom.claims(findings(spark, sf_dir)).where("at.phase = 0 and kind = 'certificate'"))
    of = lambda name: F.get_json_object("body", f"$.certificateProperties.{name}")
    return rows.select(
        "target", "ref", of("subjectName").alias("subject"), of("issuerName").alias("issuer"), of("notValidBefore").alias("not_before"), of("notValidAfter").alias("not_after"),
        of("signatureAlgorithmRef").alias("signature_ref"), of("subjectPublicKeyRef").alias("key_ref"),
    )


@query(_PLACED + _LEAF + " SELECT target, endpoint, ord, signature, signature_oid, key FROM leaf", "assets")
def cbom_leaf_fallback(spark, sf_dir):
    return cbom.leaves(cbom.typed(findings(spark, sf_dir))).select("target", "endpoint", "ord", F.col("signature.algorithm").alias("signature"), F.col("signature.oid").alias("signature_oid"), F.col("key.algorithm").alias("key"))


@query(
    _PLACED + _LIBRARIES + f" SELECT target, purl, arg_min(l.name, ord) AS name, any_value(pinned) AS version, string_agg(DISTINCT declared, ',' ORDER BY declared) AS declared, count(DISTINCT id) AS findings FROM {_DEPS} GROUP BY target, purl",
    "assets",
)
def cbom_libraries(spark, sf_dir):
    """Libraries by package URL, with the ranges that manifests declare and the number of findings."""
    claimed = cbom.claims(findings(spark, sf_dir)).where("kind = 'library'")
    texts = F.array_sort(F.collect_list(F.when(F.col("list") == "declared", F.col("text"))))
    listed = cbom.items(claimed).groupBy("target", "ref").agg(F.nullif(F.array_join(texts, ","), F.lit("")).alias("declared"), F.count_if(F.col("list") == "finding").alias("findings"))
    return cbom.components(claimed).join(listed, ["target", "ref"]).select("target", F.col("ref").alias("purl"), "name", "version", "declared", "findings")


@query(_PLACED + _PROVIDED + _LIBRARIES + f" SELECT DISTINCT target, purl AS library, {_ALG.format('label')} AS ref, pos FROM {_DEPS} JOIN provided r ON r.rule_id = p.rule_id", "assets")
def cbom_provides(spark, sf_dir):
    return cbom.provides(findings(spark, sf_dir))


@query()
def cbom_document(spark, sf_dir):
    """Whole documents in numbered lines; tests put them together and hold them against a plain builder."""
    return ranked(cbom.document_lines(findings(spark, sf_dir), SCANNED_AT), ["target"], [F.col("place")], place="number").select("target", "number", "line")
