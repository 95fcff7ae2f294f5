"""Registered queries over manifests, algorithm labels, components, call sites and arriving observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions import calls, dims
from keystrata.operators import estate, manifests, risk, source
from keystrata.operators.ranks import ranked
from keystrata.sources.fixtures import SQL, fixture
from keystrata.streaming import arrivals

from .queries import _PQ, _SEV, ORACLE_SQL, QUERIES, query

_NAME = "regexp_extract(path, '[^/]*$')"


def _kind(at: int) -> str:
    return f"CASE {_NAME} " + " ".join(f"WHEN '{row[0]}' THEN '{row[at]}'" for row in manifests.KINDS) + " END"


@query(f"SELECT target, path, {_kind(1)} AS kind, {_kind(2)} AS ecosystem FROM manifests", "manifests")
def manifest_kinds(spark, sf_dir):
    return manifests.kinds(fixture(spark, sf_dir, "manifests"))


_KEYS = "SELECT target, path, name, json_extract_string(content, concat('$.{0}.\"', name, '\"')) AS version FROM (SELECT *, unnest(json_keys(content, '$.{0}')) AS name FROM manifests WHERE path LIKE '%/package.json')"


@query(_KEYS.format("dependencies") + " UNION ALL " + _KEYS.format("devDependencies"), "manifests")
def deps_npm(spark, sf_dir):
    return manifests.npm(fixture(spark, sf_dir, "manifests"))


@query(
    "SELECT target, path, regexp_extract(line, '^[A-Za-z0-9._-]+') AS name, trim(regexp_replace(split_part(line, ';', 1), '^[A-Za-z0-9._-]+(\\[[^\\]]*\\])?', '')) AS version FROM (SELECT *, unnest(string_split(content, chr(10))) AS line FROM manifests WHERE path LIKE '%/requirements.txt') WHERE regexp_matches(line, '^[A-Za-z0-9]')",
    "manifests",
)
def deps_requirements(spark, sf_dir):
    return manifests.requirements(fixture(spark, sf_dir, "manifests"))


@query("SELECT target, path, regexp_extract(part, 'name = \"([^\"]+)\"', 1) AS name, regexp_extract(part, 'version = \"([^\"]+)\"', 1) AS version FROM (SELECT *, unnest(string_split(content, '[[package]]')[2:]) AS part FROM manifests WHERE path SIMILAR TO '.*/(Cargo|poetry|uv)[.]lock')", "manifests")
def deps_locks(spark, sf_dir):
    return manifests.stanza_locks(fixture(spark, sf_dir, "manifests"))


@query(
    "SELECT target, path, section, split_part(line, ' ', 1) AS name, split_part(line, '\"', 2) AS version FROM (SELECT target, path, split_part(part, ']', 1) AS section, unnest(string_split(part, chr(10))) AS line FROM (SELECT *, unnest(string_split(concat(chr(10), content), concat(chr(10), '['))[2:]) AS part FROM manifests WHERE path LIKE '%/Cargo.toml')) WHERE line LIKE '% = \"%'",
    "manifests",
)
def manifest_sections(spark, sf_dir):
    return manifests.toml_entries(fixture(spark, sf_dir, "manifests"))


_OWNED = ", owned AS (SELECT s.target, s.ord, path, rule_id, confidence, arg_max(dir, length(dir)) AS dir FROM sites s JOIN manifest_dirs d ON s.target = d.target AND (dir = '' OR starts_with(path, concat(dir, '/'))) GROUP BY s.target, s.ord, path, rule_id, confidence) "


@query(_OWNED + "SELECT target, dir, count(*) AS sites FROM owned GROUP BY ALL", "sites", "manifest_dirs")
def owning_dir(spark, sf_dir):
    return manifests.owning_dirs(fixture(spark, sf_dir, "sites"), fixture(spark, sf_dir, "manifest_dirs")).groupBy("target", "dir").agg(F.count("*").alias("sites"))


@query(_OWNED + "SELECT target, dir, bool_or(confidence = 'confirmed') AND bool_and(rule_id LIKE '%/hmac') AS decisive, count(*) AS sites, concat(array_to_string(list(path ORDER BY ord, path)[1:5], ', '), CASE WHEN count(*) > 5 THEN concat(' and ', count(*) - 5, ' more') ELSE '' END) AS cited FROM owned GROUP BY target, dir", "sites", "manifest_dirs")
def reconcile(spark, sf_dir):
    return manifests.reconciled(fixture(spark, sf_dir, "sites"), fixture(spark, sf_dir, "manifest_dirs"))


@query("SELECT DISTINCT version, array_to_string(list_transform(string_split(regexp_extract(version, '[0-9]+([.][0-9]+)*'), '.'), lambda x: CAST(CAST(x AS DECIMAL(38, 0)) AS VARCHAR)), '.') AS parts FROM declared", "declared")
def extract_version(spark, sf_dir):
    found = fixture(spark, sf_dir, "declared").select("version").distinct()
    parts = F.split(F.regexp_extract("version", r"(\d+(?:\.\d+)*)", 1), r"\.")
    return found.select("version", F.array_join(F.transform(parts, lambda p: p.try_cast("decimal(38,0)").cast("string")), ".").alias("parts"))


@query("SELECT DISTINCT ecosystem, name, version, concat('pkg:', CASE ecosystem WHEN 'crates' THEN 'cargo' ELSE ecosystem END, '/', CASE ecosystem WHEN 'pypi' THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) ELSE name END, CASE WHEN version SIMILAR TO '[0-9].*' AND ecosystem <> 'crates' THEN concat('@', version) ELSE '' END) AS purl FROM declared", "declared")
def purl(spark, sf_dir):
    rows = fixture(spark, sf_dir, "declared").select("ecosystem", "name", "version").distinct()
    kind = F.when(F.col("ecosystem") == "crates", "cargo").otherwise(F.col("ecosystem"))
    name = F.when(F.col("ecosystem") == "pypi", estate.canonical_name(F.col("ecosystem"), F.col("name"))).otherwise(F.col("name"))
    pin = F.coalesce(F.concat(F.lit("@"), estate.pinned(F.col("ecosystem"), F.col("version"))), F.lit(""))
    return rows.withColumn("purl", F.concat(F.lit("pkg:"), kind, F.lit("/"), name, pin))


@query(f"SELECT target, ord, row_number() OVER (PARTITION BY target ORDER BY {_SEV}, ord) AS place FROM findings", "findings")
def report_order(spark, sf_dir):
    rows = fixture(spark, sf_dir, "findings").select("target", "ord", "severity")
    return ranked(rows, ["target"], [risk.rank_of(dims.SEVERITIES, "severity"), F.col("ord")]).drop("severity")


@query("SELECT target, path, least(count(*), 2) AS kept, greatest(count(*) - 2, 0) AS beyond FROM file_hits GROUP BY target, path", "file_hits")
def findings_capped(spark, sf_dir):
    """Uses in each file up to a cap (2 here, 500 in production), and how many are beyond it."""
    n = F.count("*")
    hits = source.match(fixture(spark, sf_dir, "files"), ("javascript", "python", "go", "java", "other"))
    return hits.groupBy("target", "path").agg(F.least(n, F.lit(2)).alias("kept"), F.greatest(n - 2, F.lit(0)).alias("beyond"))


@query(
    """SELECT host, port, CASE key_type WHEN 'rsa' THEN concat('RSA-', key_bits) WHEN 'ec' THEN 'ECDSA-secp192r1' WHEN 'ed25519' THEN 'Ed25519' WHEN 'unknown' THEN 'unknown-key' ELSE upper(key_type) END AS label, CASE WHEN key_type IN ('ml-dsa-87', 'unknown') THEN 'info' WHEN key_bits < 1024 THEN 'critical' WHEN curve IS NOT NULL THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN key_type IN ('rsa', 'ec', 'ed25519') THEN 'vulnerable' WHEN key_type = 'ml-dsa-87' THEN 'safe' ELSE 'unknown' END AS pq_status, CASE WHEN key_bits = 2048 THEN 2030 END AS deprecated, CASE WHEN key_bits = 2048 OR key_type = 'ed25519' THEN 2035 END AS disallowed FROM certs WHERE chain_pos = 1""",
    "certs",
)
def tls_leaf_key(spark, sf_dir):
    return estate.tls_leaf_keys(fixture(spark, sf_dir, "certs"))


_SIGNED = """CASE WHEN s LIKE 'md5%' THEN 'critical' WHEN s LIKE 'sha1%' THEN 'high' WHEN s LIKE 'ML-%' THEN 'info' ELSE 'medium' END AS severity, CASE WHEN s LIKE 'ML-%' THEN 'safe' WHEN s IS NULL OR s = '1.2.3.4' THEN 'unknown' ELSE 'vulnerable' END AS pq_status"""


@query(f"SELECT * FROM (SELECT host, port, chain_pos, s AS signature_algorithm, {_SIGNED} FROM (SELECT *, signature_algorithm AS s FROM certs) WHERE chain_pos = 1 OR NOT self_signed) WHERE chain_pos = 1 OR severity IN ('critical', 'high') OR pq_status = 'unknown'", "certs")
def tls_signatures(spark, sf_dir):
    return estate.tls_signatures(fixture(spark, sf_dir, "certs"))


@query("SELECT host, port, protocol FROM handshakes WHERE (host, port) NOT IN (SELECT (host, port) FROM certs WHERE chain_pos = 1)", "handshakes", "certs")
def tls_without_leaf(spark, sf_dir):
    return estate.tls_without_leaf(fixture(spark, sf_dir, "handshakes"), fixture(spark, sf_dir, "certs"))


@query("SELECT raw, 'octo' AS owner, 'widgets' AS repo, 'https://github.com/octo/widgets.git' AS url FROM scan_targets WHERE raw IN ('octo/widgets', 'https://github.com/octo/widgets', 'https://www.github.com/octo/widgets/')", "scan_targets")
def parse_repo(spark, sf_dir):
    return estate.repositories(fixture(spark, sf_dir, "scan_targets"))


@query("SELECT event_id, host, event_id % 6 IN (1, 2, 3) AS refused FROM hosts", "hosts")
def numeric_hosts(spark, sf_dir):
    return estate.numeric_hosts(fixture(spark, sf_dir, "hosts"))


@query("SELECT rule_id, severity, pq_status, count(*) AS findings FROM findings WHERE rule_id LIKE 'source/%' AND rule_id <> 'source/node-crypto/keygen' GROUP BY ALL", "findings")
def catalogued_findings(spark, sf_dir):
    """Findings of rules in the catalogue, with what the catalogue says of them."""
    rules = spark.createDataFrame(calls.rules(), "rule_id string, severity string, pq_status string, usage string").where("rule_id like 'source/%'")
    counts = fixture(spark, sf_dir, "findings").groupBy("rule_id").agg(F.count("*").alias("findings"))
    return counts.join(F.broadcast(rules), "rule_id").select("rule_id", "severity", "pq_status", "findings")


@query(f"SELECT target, concat('crypto/algorithm/', trim(regexp_replace(lower(algorithm), '[^a-z0-9]+', '-', 'g'), '-')) AS ref, min({_PQ}) AS pq, min({_SEV}) AS sev, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules, count(*) AS occurrences FROM findings WHERE algorithm IS NOT NULL GROUP BY ALL", "findings")
def cbom_components(spark, sf_dir):
    slug = F.regexp_replace(F.regexp_replace(F.lower("algorithm"), "[^a-z0-9]+", "-"), "^-|-$", "")
    rows = fixture(spark, sf_dir, "findings").where("algorithm is not null").groupBy("target", F.concat(F.lit("crypto/algorithm/"), slug).alias("ref"))
    rules = F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules")
    return rows.agg(F.min(risk.rank_of(dims.PQ_STATUSES, "pq_status")).alias("pq"), F.min(risk.rank_of(dims.SEVERITIES, "severity")).alias("sev"), rules, F.count("*").alias("occurrences"))


@query(
    "SELECT host, port, string_agg(grp, ',' ORDER BY idx) AS accepted FROM (SELECT host, port, lower(grp) AS low, arg_min(grp, idx) AS grp, min(idx) AS idx FROM (SELECT host, port, grp, -1 AS idx FROM handshakes WHERE grp IS NOT NULL UNION ALL SELECT host, port, grp, idx FROM probes WHERE outcome = 'accepted') GROUP BY ALL) GROUP BY host, port",
    "handshakes",
    "probes",
)
def tls_accepted_groups(spark, sf_dir):
    first = fixture(spark, sf_dir, "handshakes").where("grp is not null").select("host", "port", "grp", F.lit(-1).alias("idx"))
    rows = first.unionByName(fixture(spark, sf_dir, "probes").where("outcome = 'accepted'").select("host", "port", "grp", "idx"))
    once = rows.groupBy("host", "port", F.lower("grp").alias("low")).agg(F.min(F.struct("idx", "grp")).alias("g"))
    return once.groupBy("host", "port").agg(F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["grp"]), ",").alias("accepted"))


@query("SELECT o_orderkey, round(year(d) + (dayofyear(d) - 1) / (CASE WHEN year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) THEN 366.0 ELSE 365.0 END), 6) AS year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)", "advisories")
def fractional_year(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    start = F.trunc(day, "year")
    share = F.date_diff(day, start) / F.date_diff(F.add_months(start, 12), start)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.year(day) + share, 6).alias("year"))


def tls_protocol_stream(spark, sf_dir):
    """The protocol rule over orders that arrive as files."""
    orders = arrivals.arriving(spark, f"{sf_dir}/orders.parquet")
    return arrivals.judged_once(spark, spark.sql(SQL["handshakes"], orders=orders), estate.tls_protocol, "tls-protocol")


QUERIES["tls_protocol_stream"] = tls_protocol_stream
ORACLE_SQL["tls_protocol_stream"] = ORACLE_SQL["tls_protocol"]
