"""Registered queries over endpoints, targets, walks, key blocks and the texts of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions import names
from keystrata.operators import endpoints, estate, keys, source, targets, walk
from keystrata.sources.fixtures import fixture

from .queries import ORACLE_SQL, TODAY, query


@query("SELECT event_id, role, signal FROM digest_lines", "digest_lines")
def hash_role(spark, sf_dir):
    rows = fixture(spark, sf_dir, "digest_lines").select("event_id", names.digest_role(F.col("line")).alias("r"))
    return rows.select("event_id", "r.role", "r.signal")


_CODES = [*range(1, 9), *range(10, 32), *range(127, 160), *range(0x2028, 0x202F), *range(0x2066, 0x206A)]
_SHOWN = "text"
for _c in _CODES:
    _SHOWN = f"replace({_SHOWN}, chr({_c}), '" + (f"\\x{_c:02x}" if _c < 256 else f"\\u{_c:04x}") + "')"


@query(f"SELECT doc_id, {_SHOWN} AS text FROM controls", "controls")
def sanitize_text(spark, sf_dir):
    return fixture(spark, sf_dir, "controls").select("doc_id", names.sanitized(F.col("text")).alias("text"))


_SLUG = "trim(regexp_replace(lower(coalesce(algorithm, title)), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT target, ord, title, coalesce(confidence, 'medium') AS confidence, coalesce(rule_id, concat(category, '/', CASE WHEN rest = '' THEN 'finding' ELSE rest END)) AS rule_id FROM (SELECT *, CASE WHEN starts_with(s, concat(category, '-')) THEN substr(s, length(category) + 2) ELSE s END AS rest FROM (SELECT *, {_SLUG} AS s FROM raw_findings))", "raw_findings")
def normalize(spark, sf_dir):
    rule = F.coalesce("rule_id", names.rule_named(F.col("category"), F.coalesce("algorithm", "title")))
    return fixture(spark, sf_dir, "raw_findings").select("target", "ord", names.sanitized(F.col("title")).alias("title"), F.coalesce("confidence", F.lit("medium")).alias("confidence"), rule.alias("rule_id"))


_GAP = "rule_id IN ('source/file-too-large', 'source/ast-fallback', 'deps/unsupported-manifest', 'deps/scan-truncated')"


@query(
    f"""SELECT target, "check", note IS NULL AS complete, note, skipped, concat("check", ' (', CASE WHEN note IS NULL THEN 'complete' ELSE concat('partial: ', note) END, ')') AS line
    FROM (SELECT t.target, c."check", (SELECT string_agg(DISTINCT title, '; ' ORDER BY title) FROM scan_gaps g WHERE g.target = t.target AND starts_with(rule_id, c."check") AND {_GAP}) AS note,
    (SELECT string_agg(DISTINCT title, '; ' ORDER BY title) FROM scan_gaps g WHERE g.target = t.target AND c."check" = 'source' AND rule_id = 'source/directories-skipped') AS skipped
    FROM (SELECT DISTINCT target FROM scan_gaps) t CROSS JOIN (VALUES ('source'), ('deps')) AS c("check"))""",
    "scan_gaps",
)
def coverage_rollup(spark, sf_dir):
    return walk.coverage(fixture(spark, sf_dir, "scan_gaps"))


_DIR = "regexp_replace(path, '/?[^/]*$', '')"


@query(f"SELECT target, path FROM tree t WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT target, {_DIR} AS dir FROM tree WHERE regexp_extract(path, '[^/]*$') IN ('pyvenv.cfg', 'CACHEDIR.TAG')) m WHERE m.target = t.target AND dir <> '' AND starts_with(t.path, concat(dir, '/')))", "tree")
def skip_markers(spark, sf_dir):
    return walk.below_no_marker(fixture(spark, sf_dir, "tree"))


@query("SELECT doc_id, path, class FROM odd_files", "odd_files")
def walk_classes(spark, sf_dir):
    return fixture(spark, sf_dir, "odd_files").select("doc_id", "path", walk.walk_class(F.col("path")).alias("class"))


@query("SELECT path, count(*) AS files FROM odd_files WHERE class = 'unread-manifest' GROUP BY path", "odd_files")
def unsupported_manifests(spark, sf_dir):
    return fixture(spark, sf_dir, "odd_files").where(walk.walk_class(F.col("path")) == "unread-manifest").groupBy("path").agg(F.count("*").alias("files"))


@query("SELECT event_id, transport, host, CAST(port AS INT) AS port FROM remotes WHERE transport IS NOT NULL", "remotes")
def parse_remote(spark, sf_dir):
    return targets.remotes(fixture(spark, sf_dir, "remotes").select("event_id", "raw")).select("event_id", "transport", "host", "port")


@query("SELECT event_id, fine IS NOT NULL AS allowed FROM addresses_v6", "addresses_v6")
def address_policy_v6(spark, sf_dir):
    return targets.address_policy_v6(fixture(spark, sf_dir, "addresses_v6").select("event_id", "ip")).select("event_id", "allowed")


@query(
    """SELECT o_orderkey, CASE WHEN today <> '1996-01-01' THEN 'today' WHEN crqc_year NOT BETWEEN 1990 AND 2200 THEN 'crqc_year' WHEN migration_years <= 0 OR migration_years > 100 THEN 'migration_years'
    WHEN horizon_years < 0 THEN 'horizon_years' WHEN sensitivity > 1 THEN 'sensitivity' END AS fault FROM profiles""",
    "profiles",
)
def profile_valid(spark, sf_dir):
    return targets.profile_faults(fixture(spark, sf_dir, "profiles")).select("o_orderkey", "fault")


_KEY_ROWS = "SELECT target, path, line, label, rule_id, algorithm, severity, pq_status FROM key_files WHERE label IS NOT NULL"


@query(_KEY_ROWS, "key_files")
def match_keys(spark, sf_dir):
    return keys.key_blocks(fixture(spark, sf_dir, "key_files").select("target", "path", "content"))


@query(
    """SELECT host, port, "case", CASE WHEN "case" = 'old' AND (weak OR kex = 'static-RSA-key-exchange') THEN 'high' WHEN "case" IN ('old', 'refused', 'classical') THEN 'medium' ELSE 'info' END AS severity,
    CASE WHEN "case" IN ('old', 'refused', 'classical') THEN 'vulnerable' WHEN "case" <> 'accepted' THEN 'unknown' WHEN hybrid THEN 'transitional' ELSE 'safe' END AS pq_status,
    CASE WHEN "case" IN ('old', 'accepted') THEN 'confirmed' WHEN "case" = 'refused' AND refused = 5 THEN 'high' WHEN "case" IN ('refused', 'classical') THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN "case" = 'accepted' THEN first WHEN "case" IN ('old', 'refused', 'classical') THEN kex END AS algorithm, CASE WHEN "case" = 'accepted' THEN large WHEN "case" IN ('old', 'refused', 'classical') THEN false END AS cnsa2
    FROM (SELECT *, CASE WHEN protocol <> 'TLSv1.3' THEN 'old' WHEN first IS NOT NULL THEN 'accepted' WHEN refused > 0 THEN 'refused' WHEN untested = 5 THEN 'untested' WHEN kex IS NOT NULL THEN 'classical' ELSE 'open' END AS "case"
    FROM (SELECT h.host, h.port, h.protocol, CASE h.cipher WHEN 'DHE-RSA-AES128-SHA' THEN 'DHE-1024' WHEN 'AES256-GCM-SHA384' THEN 'static-RSA-key-exchange' WHEN 'DES-CBC3-SHA' THEN 'static-RSA-key-exchange' WHEN 'ECDHE-RSA-AES128-SHA' THEN 'ECDHE'
        WHEN 'ECDHE-RSA-AES128-GCM-SHA256' THEN 'ECDHE-P-256' ELSE CASE WHEN h.grp = 'X25519' THEN 'ECDHE-X25519' WHEN h.bits = 3072 THEN 'FFDHE-3072' END END AS kex, h.cipher LIKE 'DHE-%' AS weak,
        arg_min(p.grp, p.idx) FILTER (took) AS first, bool_and(p.idx IN (0, 1, 3)) FILTER (took) AS hybrid, bool_or(p.idx >= 3) FILTER (took) AS large, count(*) FILTER (outcome = 'rejected') AS refused, count(*) FILTER (outcome = 'untestable') AS untested
        FROM handshakes h JOIN (SELECT p.*, p.outcome = 'accepted' OR coalesce(h.grp = p.grp, false) AS took FROM probes p JOIN handshakes h USING (host, port)) p USING (host, port) GROUP BY ALL))""",
    "handshakes", "probes",
)
def tls_kex_finding(spark, sf_dir):
    return endpoints.key_exchange(fixture(spark, sf_dir, "handshakes"), fixture(spark, sf_dir, "probes"))


@query("SELECT host, port, 'tls/chain-untrusted' AS rule_id, 'medium' AS severity, 'unknown' AS pq_status, authorization_error AS evidence FROM tls_errors WHERE authorization_error IS NOT NULL UNION ALL SELECT host, port, 'tls/handshake-refused', 'info', 'unknown', handshake_refused FROM tls_errors WHERE handshake_refused IS NOT NULL", "tls_errors")
def tls_chain_trust(spark, sf_dir):
    return endpoints.trust(fixture(spark, sf_dir, "tls_errors"))


def _sql(name: str, rule: str, columns: str = "severity, pq_status", port: str = "port") -> str:
    return f"SELECT host, {port} AS port, {rule} AS rule_id, {columns} FROM ({ORACLE_SQL[name]})"


@query(
    " UNION ALL ".join([
        _sql("tls_leaf_key", "'tls/leaf-public-key'"), _sql("tls_signatures", "CASE chain_pos WHEN 1 THEN 'tls/leaf-signature' ELSE 'tls/intermediate-signature' END"), _sql("tls_chain", "'tls/chain-classical'"), _sql("tls_kex_finding", "'tls/hybrid-kex'"),
        _sql("tls_without_leaf", "'tls/no-leaf'", "'info', 'unknown'"), _sql("tls_chain_trust", "rule_id"), _sql("tls_validity", "CASE severity WHEN 'high' THEN 'tls/leaf-expired' ELSE 'tls/leaf-expiring' END", "severity, 'unknown'", "443"),
        _sql("tls_protocol", "'tls/negotiated-protocol'", port="443"),
    ]),
    "handshakes",
)
def analyze_tls(spark, sf_dir):
    return endpoints.findings(*(fixture(spark, sf_dir, t) for t in ("handshakes", "probes", "certs", "tls_errors")), TODAY)


@query(
    f"SELECT target, rule AS rule_id, severity, pq_status FROM ({ORACLE_SQL['assess_hits']}) UNION ALL SELECT CAST(target AS VARCHAR), rule_id, severity, pq_status FROM ({ORACLE_SQL['match_deps']}) UNION ALL SELECT target, rule_id, severity, pq_status FROM ({_KEY_ROWS})",
    "key_files",
)
def all_findings(spark, sf_dir):
    """Findings of source files, of dependencies and of key blocks as one bag."""
    uses = source.assessed(source.match(fixture(spark, sf_dir, "files"), ("javascript", "python", "go", "java", "other"))).select("target", F.col("rule").alias("rule_id"), "severity", "pq_status")
    deps = estate.match_deps(fixture(spark, sf_dir, "declared")).select(F.col("target").cast("string").alias("target"), "rule_id", "severity", "pq_status")
    blocks = keys.key_blocks(fixture(spark, sf_dir, "key_files").select("target", "path", "content")).select("target", "rule_id", "severity", "pq_status")
    return uses.unionByName(deps).unionByName(blocks)
