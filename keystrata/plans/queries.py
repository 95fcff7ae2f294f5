"""Registered queries over the derived estate tables, each beside the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.operators import estate, risk, source
from keystrata.operators.ranks import ranked
from keystrata.sources.fixtures import fixture, oracle

TODAY = "1996-01-01"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a query under its function's name, with its SQL over the named derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + ", ".join(f"{t} AS ({oracle(t)})" for t in tables) + " " + sql
        return f

    return add


def _case(values, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(values)) + f" ELSE {len(values)} END"


_SEV, _PQ = _case(dims.SEVERITIES, "severity"), _case(dims.PQ_STATUSES, "pq_status")
_LADDER = "['critical', 'high', 'medium', 'low', 'info']"


@query("SELECT target, count(*) AS findings, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + " FROM findings GROUP BY target", "findings")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "findings").groupBy("target").agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES))


@query(f"SELECT target, bool_or({_SEV} <= 1) AS failed FROM findings WHERE context IS NULL GROUP BY target", "findings")
def fail_gate(spark, sf_dir):
    return fixture(spark, sf_dir, "findings").where("context is null").groupBy("target").agg(F.bool_or(risk.rank_of(dims.SEVERITIES, "severity") <= 1).alias("failed"))


@query(f"SELECT rule_id, context, {_LADDER}[least(5, {_SEV} + 1 + CASE WHEN context IS NULL THEN 0 ELSE 2 END)] AS severity, count(*) AS n FROM findings GROUP BY ALL", "findings")
def calibrated(spark, sf_dir):
    step = F.when(F.col("context").isNull(), 1).otherwise(3)
    level = F.element_at(F.array(*map(F.lit, dims.SEVERITIES)), F.least(F.lit(5), risk.rank_of(dims.SEVERITIES, "severity") + step))
    return fixture(spark, sf_dir, "findings").groupBy("rule_id", "context", level.alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT target, ord, rule_id, algorithm FROM findings WHERE severity IN ('critical', 'high') AND pq_status = 'vulnerable' AND contains(lower(concat_ws(' ', rule_id, algorithm)), 'jwt')", "findings")
def findings_search(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "rule_id", "algorithm"))
    return fixture(spark, sf_dir, "findings").where(F.col("severity").isin("critical", "high") & (F.col("pq_status") == "vulnerable") & F.contains(text, F.lit("jwt"))).select("target", "ord", "rule_id", "algorithm")


@query("SELECT target, algorithm, count(*) AS n, count(*) FILTER (pq_status = 'vulnerable') AS vulnerable, min(ord) AS first_ord, arg_min(rule_id, ord) AS rule_id FROM findings WHERE algorithm IS NOT NULL GROUP BY target, algorithm", "findings")
def algorithm_inventory(spark, sf_dir):
    rows = fixture(spark, sf_dir, "findings").where("algorithm is not null")
    return rows.groupBy("target", "algorithm").agg(F.count("*").alias("n"), F.count_if(F.col("pq_status") == "vulnerable").alias("vulnerable"), F.min("ord").alias("first_ord"), F.min_by("rule_id", "ord").alias("rule_id"))


@query(f"SELECT target, rule_id, ord, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_SEV}, ord) AS place FROM findings) WHERE place <= 12", "findings")
def report_top12(spark, sf_dir):
    return estate.top_findings(fixture(spark, sf_dir, "findings"), 12, risk.rank_of(dims.SEVERITIES, "severity")).select("target", "rule_id", "ord", "place")


@query("SELECT target, ord, concat('CSW-', upper(category), '-', lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0')) AS id FROM (SELECT *, row_number() OVER (PARTITION BY target, category ORDER BY ord) AS k FROM findings)", "findings")
def finding_ids(spark, sf_dir):
    placed = ranked(fixture(spark, sf_dir, "findings").select("target", "category", "ord"), ["target", "category"], [F.col("ord")])
    return placed.withColumn("k", F.col("place").cast("string")).select("target", "ord", F.concat(F.lit("CSW-"), F.upper("category"), F.lit("-"), F.when(F.length("k") < 3, F.lpad("k", 3, "0")).otherwise(F.col("k"))).alias("id"))


@query(f"SELECT target, rule_id, CAST(row_number() OVER (PARTITION BY target ORDER BY rule_id) - 1 AS INT) AS rule_index, {_LADDER}[min({_SEV}) + 1] AS severity, count(*) AS results FROM findings GROUP BY target, rule_id", "findings")
def sarif_rules(spark, sf_dir):
    rows = fixture(spark, sf_dir, "findings").groupBy("target", "rule_id").agg(F.min(risk.rank_of(dims.SEVERITIES, "severity")).alias("sev"), F.count("*").alias("results"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("rule_id")) - 1
    return rows.select("target", "rule_id", place.alias("rule_index"), F.element_at(F.array(*map(F.lit, dims.SEVERITIES)), F.col("sev") + 1).alias("severity"), "results")


# The labels of the findings, judged by hand.
_CNSA = "CASE WHEN algorithm = 'MLKEM1024' THEN true WHEN algorithm IN ('RSA-2048', 'RSA-1024', 'ECDH-P-256', 'ECDSA-P-256', 'ECDHE-P-256', 'JWT-RS256', 'sha256WithRSAEncryption') THEN false END"


@query(f"SELECT algorithm, {_CNSA} AS cnsa2, count(*) AS n FROM findings WHERE algorithm IS NOT NULL GROUP BY algorithm", "findings")
def cnsa2_standing(spark, sf_dir):
    counts = fixture(spark, sf_dir, "findings").where("algorithm is not null").groupBy("algorithm").agg(F.count("*").alias("n"))
    return counts.withColumn("cnsa2", risk.cnsa2_standing(F.col("algorithm")))


# The oracle's own statement of usage, classical breaks and threats.
_THREATS = f"""
used AS (SELECT *, CASE WHEN usage <> '' THEN string_split(usage, ',')
    WHEN rule_id = 'tls/hybrid-kex' THEN ['key-establishment'] WHEN rule_id = 'tls/leaf-public-key' THEN ['authentication'] WHEN rule_id = 'tls/leaf-signature' THEN ['signature']
    WHEN rule_id = 'tls/negotiated-protocol' THEN ['protocol'] WHEN rule_id LIKE 'keys/private-key%' THEN ['secret-material'] WHEN rule_id LIKE 'jwt/%' THEN ['authentication'] ELSE [] END AS uses FROM findings),
judged AS (SELECT *, CASE WHEN list_contains(uses, 'secret-material') THEN 'secret material' WHEN classical_break IS NOT NULL THEN classical_break WHEN pq_status <> 'vulnerable' THEN NULL
    WHEN regexp_matches(algorithm, '(?i)md[245]([^0-9]|$)') THEN 'collision-broken digest' WHEN regexp_matches(algorithm, '(?i)sha-?1([^0-9]|$)') THEN 'sha-1'
    WHEN regexp_matches(algorithm, '(?i)(^|[^a-z])(tripledes|desede|desx|3des|des|arcfour|arc4|rc2|rc4)([^a-z]|$)') THEN 'broken cipher' WHEN lower(algorithm) = 'jwt-none' THEN 'alg none'
    WHEN TRY_CAST(regexp_extract(algorithm, '(?i)^(?:rsa|rsa-pss|dsa|dhe?|ffdhe)-([0-9]+)$', 1) AS INT) < 2048 THEN 'below minimum strength'
    WHEN TRY_CAST(regexp_extract(algorithm, '(?i)^(?:ecdsa|ecdhe?)-(?:p-|prime|secp|sect|brainpoolp)?([0-9]+)', 1) AS INT) < 224 THEN 'below minimum strength' END AS reason,
    len(list_intersect(uses, ['key-establishment', 'encryption', 'protocol'])) > 0 AS h, len(list_intersect(uses, ['signature', 'authentication'])) > 0 AS f FROM used),
threat AS (SELECT *, CASE WHEN reason IS NOT NULL THEN ['classical'] WHEN pq_status <> 'vulnerable' THEN ['not-applicable'] WHEN h AND NOT f THEN ['harvest-now'] WHEN f AND NOT h THEN ['forge-later'] ELSE ['harvest-now', 'forge-later'] END AS threats FROM judged)"""
_PROFILES = "profile AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {float(h)}, {s})" for c, h, s, _ in dims.DATA_CLASSES) + ") AS p(data_class, horizon, sensitivity) CROSS JOIN (VALUES " + ", ".join(f"({y})" for y in dims.CRQC_YEARS) + ") AS y(crqc))"
_VERDICT = """
verdict AS (SELECT *, CASE WHEN threat = 'classical' THEN 'act-now' WHEN complete IS NULL THEN 'not-applicable' WHEN threat = 'harvest-now' AND complete < 0 OR threat = 'forge-later' AND complete <= 0 THEN 'exposed' WHEN start < 0 THEN 'overdue' ELSE 'on-track' END AS status
  FROM (SELECT *, CASE threat WHEN 'classical' THEN 0.0 WHEN 'harvest-now' THEN complete - 3.0 WHEN 'forge-later' THEN complete - 5.0 END AS start
    FROM (SELECT *, CASE WHEN threat = 'classical' THEN 0.0 WHEN threat = 'harvest-now' AND horizon > 0 THEN crqc - 2026.0 - horizon WHEN threat = 'forge-later' THEN crqc - 2026.0 END AS complete FROM pairs)))"""
_ASSETS = f"""
, {_THREATS}, {_PROFILES},
keyed AS (SELECT *, CASE WHEN category = 'tls' AND host IS NOT NULL AND list_contains(threats, 'harvest-now') THEN concat('tls/key-establishment@', host, ':', port) ELSE concat_ws(':', rule_id, algorithm) END AS asset, context IS NOT NULL AS nonprod,
  coalesce({_CNSA}, CASE WHEN pq_status = 'vulnerable' AND len(list_intersect(uses, ['key-establishment', 'signature', 'authentication'])) > 0 THEN false END) AS own FROM threat),
whole AS (SELECT target, nonprod, asset, min({_SEV}) AS sev, min({_PQ}) AS pq, min(CAST(own AS INT)) AS cnsa2 FROM keyed GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT target, nonprod, asset, threat, min(ord) AS ord FROM (SELECT *, unnest(threats) AS threat FROM keyed) GROUP BY ALL) CROSS JOIN profile), {_VERDICT},
assets AS (SELECT v.* EXCLUDE (ord, k), sev, pq, cnsa2 FROM (SELECT *, row_number() OVER (PARTITION BY target, data_class, crqc, nonprod, asset ORDER BY CASE status WHEN 'act-now' THEN 0 WHEN 'exposed' THEN 0 WHEN 'overdue' THEN 1 WHEN 'on-track' THEN 2 ELSE 3 END, ord, CASE threat WHEN 'harvest-now' THEN 0 ELSE 1 END) AS k FROM verdict) v JOIN whole USING (target, nonprod, asset) WHERE k = 1)
"""


@query(f", {_THREATS} SELECT target, ord, threats[1] AS threat, reason FROM threat", "findings")
def classify_threat(spark, sf_dir):
    return risk.with_threats(fixture(spark, sf_dir, "findings")).select("target", "ord", F.get("threats", F.lit(0)).alias("threat"), "reason")


@query(f", {_PROFILES}, pairs AS (SELECT * FROM profile CROSS JOIN (SELECT DISTINCT CASE WHEN pq_status = 'safe' THEN 'not-applicable' WHEN category = 'tls' THEN 'harvest-now' WHEN category = 'keys' THEN 'classical' ELSE 'forge-later' END AS threat FROM findings)), {_VERDICT} SELECT data_class, crqc, threat, status, complete, start FROM verdict", "findings")
def mosca_grid(spark, sf_dir):
    threat = F.when(F.col("pq_status") == "safe", "not-applicable").when(F.col("category") == "tls", "harvest-now").when(F.col("category") == "keys", "classical").otherwise("forge-later")
    met = fixture(spark, sf_dir, "findings").select(threat.alias("threat")).distinct()
    return risk.with_verdict(met.join(F.broadcast(risk.profiles(spark)))).select("data_class", "crqc", "threat", "status", "complete", "start")


def _assets(spark, sf_dir):
    return risk.assets(fixture(spark, sf_dir, "findings"), risk.profiles(spark))


@query(_ASSETS + "SELECT target, data_class, crqc, nonprod, asset, threat, status, complete, start, sev, pq, cnsa2 FROM assets", "findings")
def risk_assets(spark, sf_dir):
    return _assets(spark, sf_dir).drop("horizon", "sensitivity")


@query(_ASSETS + """SELECT target, data_class, crqc, count(*) FILTER (NOT nonprod) AS assets, count(*) FILTER (nonprod) AS nonprod_assets, count(*) FILTER (NOT nonprod AND threat = 'harvest-now' AND status = 'exposed') AS exposed,
  count(*) FILTER (NOT nonprod AND status = 'overdue') AS overdue, count(*) FILTER (NOT nonprod AND status = 'act-now') AS act_now, count(*) FILTER (NOT nonprod AND status = 'on-track') AS on_track,
  round(coalesce(sum(CAST(horizon * sensitivity AS DOUBLE)) FILTER (NOT nonprod AND threat = 'harvest-now' AND status = 'exposed'), 0.0), 6) AS risk_years FROM assets GROUP BY target, data_class, crqc""", "findings")  # fmt: skip
def risk_ledger(spark, sf_dir):
    return risk.ledger(_assets(spark, sf_dir))


_BOUND = "bound AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{o}')" for c, _, _, own in dims.DATA_CLASSES for o in own) + ") AS b(data_class, obligation))"


@query(_ASSETS + f", {_BOUND} SELECT target, data_class, crqc, obligation, count(*) FILTER (NOT nonprod AND (obligation = 'cnsa-2.0' AND coalesce(cnsa2 = 0, false) OR status IN ('exposed', 'overdue', 'act-now') AND (threat = 'harvest-now' OR threat = 'forge-later' AND obligation = 'cnsa-2.0' OR threat = 'classical' AND obligation IN ('aba-1.6c', 'hipaa')))) AS breaches FROM assets JOIN bound USING (data_class) GROUP BY ALL", "findings")
def obligation_counts(spark, sf_dir):
    return risk.obligation_counts(_assets(spark, sf_dir))


@query(_ASSETS + "SELECT target, asset, status, start FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY start, asset) AS place FROM assets WHERE data_class = 'general' AND crqc = 2035 AND NOT nonprod AND status IN ('exposed', 'overdue', 'act-now')) WHERE place <= 6", "findings")
def urgent_assets(spark, sf_dir):
    rows = risk.assets(fixture(spark, sf_dir, "findings"), risk.profiles(spark).where("data_class = 'general' and crqc = 2035")).where(~F.col("nonprod") & F.col("status").isin("exposed", "overdue", "act-now"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("start", "asset"))
    return rows.withColumn("place", place).where("place <= 6").select("target", "asset", "status", "start")


@query(_ASSETS + f", {_BOUND} SELECT DISTINCT concat('system:', target) AS src, concat('class:', data_class) AS dst, 'classified-as' AS rel FROM assets UNION SELECT concat('class:', data_class), concat('obligation:', obligation), 'bound-by' FROM bound UNION SELECT DISTINCT concat('system:', target), concat('asset:', asset), 'uses' FROM assets", "findings")
def graph_edges(spark, sf_dir):
    rows = risk.asset_threats(fixture(spark, sf_dir, "findings"))
    classes = spark.createDataFrame([(c, o) for c, _, _, own in dims.DATA_CLASSES for o in own or (None,)], "data_class string, obligation string")
    edge = lambda a, b, rel: (F.concat(*a).alias("src"), F.concat(*b).alias("dst"), F.lit(rel).alias("rel"))
    system, kind = (F.lit("system:"), "target"), (F.lit("class:"), "data_class")
    out = rows.select("target").distinct().join(F.broadcast(classes.select("data_class").distinct())).select(*edge(system, kind, "classified-as"))
    out = out.unionByName(classes.where("obligation is not null").select(*edge(kind, (F.lit("obligation:"), "obligation"), "bound-by")))
    return out.unionByName(rows.select("target", "asset").distinct().select(*edge(system, (F.lit("asset:"), "asset"), "uses")))


_LANG = "CASE WHEN regexp_matches(lower(path), '\\.[cm]?[jt]sx?$') THEN 'javascript' WHEN regexp_matches(lower(path), '\\.(?:py|pyw|pyi)$') THEN 'python' WHEN lower(path) LIKE '%.go' THEN 'go' WHEN regexp_matches(lower(path), '\\.(?:java|kt|kts|scala|groovy)$') THEN 'java' ELSE 'other' END"


@query(f"SELECT target, path, {_LANG} AS language, CASE WHEN regexp_matches(lower(path), '\\.(md|mdx|markdown|rst|txt|adoc)$|(^|/)docs?/') THEN 'docs' WHEN regexp_matches(lower(path), '(^|/)tests?/') THEN 'test' ELSE 'source' END AS context, strlen(content) > 2000000 AS too_large, false AS is_binary FROM files", "files")
def file_classes(spark, sf_dir):
    return source.file_classes(fixture(spark, sf_dir, "files"))


@query("SELECT target, count(*) AS files, count(*) FILTER (path NOT LIKE 'vendor/%' AND path NOT LIKE '.venv/%') AS kept FROM files GROUP BY target", "files")
def skip_dirs(spark, sf_dir):
    files = fixture(spark, sf_dir, "files").select("target", "path")
    return files.groupBy("target").agg(F.count("*").alias("files")).join(source.kept(files).groupBy("target").agg(F.count("*").alias("kept")), "target")


@query("SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY string_split(path, '/')) AS place FROM files", "files")
def walk_order(spark, sf_dir):
    return source.walk_order(fixture(spark, sf_dir, "files"))


@query("SELECT target, path, size, place, total FROM (SELECT target, path, strlen(content) AS size, count(*) OVER w AS place, CAST(sum(strlen(content)) OVER w AS BIGINT) AS total FROM files WINDOW w AS (PARTITION BY target ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING)) WHERE place <= 30 AND total <= 60000", "files")
def budget_prefix(spark, sf_dir):
    return source.budget_prefix(fixture(spark, sf_dir, "files"), 30, 60_000)


@query(f"SELECT target, language, count(*) AS files, concat(array_to_string(list_sort(list(path))[1:10], ', '), CASE WHEN count(*) > 10 THEN concat(' and ', count(*) - 10, ' more') ELSE '' END) AS sample FROM (SELECT *, {_LANG} AS language FROM files) GROUP BY target, language", "files")
def coverage_samples(spark, sf_dir):
    return source.coverage_samples(fixture(spark, sf_dir, "files"))


# The oracle places the snippets' uses, listed by hand, in the files: it knows no pattern.
_PLACED = "strpos(code, needle) - 1 + CASE needle WHEN 'k = RSA.generate' THEN 4 ELSE 0 END"


def _hits_sql(columns: str, *languages: str) -> str:
    own = f" WHERE {_LANG} IN ({', '.join(map(repr, languages))})" if languages else ""
    return f"SELECT target, path, rule, algorithm, {columns} FROM (SELECT *, CAST(length(text) + 1 + ({_PLACED}) AS INT) AS at, concat(text, chr(10), left(code, CAST({_PLACED} AS INT))) AS head FROM file_hits{own})"


_LINE = "CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line"


def _matches(*languages: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source.match(fixture(spark, sf_dir, "files"), languages).drop("after", "context", "literal")

    run.__name__ = f"match_{languages[0]}"
    return query(_hits_sql(f'"at", {_LINE}', *languages), "file_hits")(run)


for _language in (("python",), ("javascript", "other"), ("go",), ("java",)):
    _matches(*_language)

_EVERY = ("javascript", "python", "go", "java", "other")


@query(_hits_sql(f'"at", {_LINE}', *_EVERY), "file_hits")
def match_all(spark, sf_dir):
    return source.match(fixture(spark, sf_dir, "files"), _EVERY).drop("after", "context", "literal")


@query(
    _hits_sql('"at", ' + "severity, 'vulnerable' AS pq_status, CAST(nullif(bits, '') AS INT) AS bits, CASE WHEN rule LIKE '%/weak-hash' THEN 'hashing' WHEN rule LIKE '%/weak-cipher' THEN 'encryption' WHEN rule LIKE '%/keygen-rsa' THEN '' "
              "WHEN rule LIKE '%/dh' OR rule LIKE '%/xdh' OR rule LIKE '%/key-agreement' THEN 'key-establishment' ELSE 'signature' END AS usage, CASE WHEN CAST(nullif(bits, '') AS INT) < 2048 THEN concat('a key of ', bits, ' bits is below 2048') WHEN rule = 'source/node-crypto/signature' AND severity = 'high' THEN 'a signature over RSA-SHA1' END AS reason", *_EVERY),
    "file_hits",
)
def assess_hits(spark, sf_dir):
    return source.assessed(source.match(fixture(spark, sf_dir, "files"), _EVERY)).select("target", "path", "rule", "algorithm", "at", "severity", "pq_status", "bits", "usage", "reason")


_PARTS = "list_resize(list_transform(string_split(regexp_extract({0}, '([0-9]+(?:\\.[0-9]+)*)', 1), '.'), lambda x: CAST(x AS INT)), 4, 0)"
_RANGE = f"""
, ranged AS (SELECT *, {_PARTS.format("version")} AS v, CASE left(version, 1) WHEN '^' THEN '^' WHEN '~' THEN '~' WHEN '<' THEN '<' WHEN '>' THEN '>' ELSE '=' END AS op FROM declared),
tops AS (SELECT *, CASE op WHEN '^' THEN CASE WHEN v[1] > 0 THEN [v[1] + 1, 0, 0, 0] WHEN v[2] > 0 THEN [0, v[2] + 1, 0, 0] ELSE [0, 0, v[3] + 1, 0] END WHEN '~' THEN [v[1], v[2] + 1, 0, 0] WHEN '<' THEN v END AS top, CASE op WHEN '<' THEN [0, 0, 0, 0] ELSE v END AS low FROM ranged)
"""
_JUDGE = "CASE WHEN fixed IS NULL THEN NULL WHEN op = '=' AND v < fixed OR top <= fixed THEN 'below' WHEN low >= fixed THEN 'at-or-above' ELSE 'either' END"


@query(_RANGE + f"SELECT version, {_JUDGE} AS verdict, count(*) AS n FROM (SELECT *, [10, 3, 0, 0] AS fixed FROM tops) GROUP BY ALL", "declared")
def judge_range(spark, sf_dir):
    counts = fixture(spark, sf_dir, "declared").groupBy("version").agg(F.count("*").alias("n"))
    return counts.withColumn("verdict", estate.judged_range(F.col("version"), F.array(*map(F.lit, (10, 3, 0, 0)))))


_REGISTRY = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in dims.REGISTRY) + ") AS r(ecosystem, canon, severity, pq_status, fixed_in)"


@query(_RANGE + f""", cargo AS (SELECT * REPLACE (CASE WHEN ecosystem = 'crates' AND op = '=' THEN '^' ELSE op END AS op, CASE WHEN ecosystem = 'crates' AND op = '=' THEN CASE WHEN v[1] > 0 THEN [v[1] + 1, 0, 0, 0] WHEN v[2] > 0 THEN [0, v[2] + 1, 0, 0] ELSE [0, 0, v[3] + 1, 0] END ELSE top END AS top) FROM tops), joined AS (SELECT *, CASE WHEN fixed_in IS NOT NULL THEN {_PARTS.format("fixed_in")} END AS fixed FROM (SELECT *, CASE ecosystem WHEN 'pypi' THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) WHEN 'crates' THEN lower(replace(name, '_', '-')) ELSE name END AS canon FROM cargo) JOIN {_REGISTRY} USING (ecosystem, canon)),
 seen AS (SELECT *, {_JUDGE} AS verdict FROM joined)
 SELECT DISTINCT target, concat('deps/', ecosystem, '-', canon) AS rule_id, concat(manifest, ':', name, '@', version) AS evidence, coalesce(verdict, 'none') AS verdict, CASE WHEN verdict = 'at-or-above' THEN 'info' ELSE severity END AS severity,
 CASE WHEN verdict = 'at-or-above' THEN 'transitional' ELSE pq_status END AS pq_status, CASE WHEN fixed_in IS NULL THEN 'medium' WHEN verdict = 'either' THEN 'low' ELSE 'high' END AS confidence FROM seen""", "declared")  # fmt: skip
def match_deps(spark, sf_dir):
    return estate.match_deps(fixture(spark, sf_dir, "declared"))


@query("SELECT target, ecosystem, name, version, array_to_string(list_sort(list(DISTINCT id))[1:5], ',') AS ids FROM declared JOIN advisories USING (ecosystem, name, version) WHERE version SIMILAR TO '[0-9].*' AND ecosystem <> 'crates' GROUP BY ALL", "declared", "advisories")
def advisories_join(spark, sf_dir):
    return estate.advisories(fixture(spark, sf_dir, "declared"), fixture(spark, sf_dir, "advisories")).select("target", "ecosystem", "name", "version", "ids")


@query("SELECT host, CASE protocol WHEN 'TLSv1' THEN '1.0' ELSE substr(protocol, 5) END AS version, CASE protocol WHEN 'TLSv1.3' THEN 'info' WHEN 'TLSv1.2' THEN 'medium' ELSE 'high' END AS severity, CASE protocol WHEN 'TLSv1.3' THEN 'unknown' ELSE 'vulnerable' END AS pq_status FROM handshakes", "handshakes")
def tls_protocol(spark, sf_dir):
    return estate.tls_protocol(fixture(spark, sf_dir, "handshakes"))


@query("""SELECT host, kex, coalesce((kex LIKE 'DHE%' OR kex LIKE 'FFDHE%') AND bits < 2048, false) AS weak FROM (SELECT *, CASE WHEN protocol <> 'TLSv1.3' AND regexp_matches(cipher, '^(AES|DES)') THEN 'static-RSA-key-exchange'
  WHEN protocol <> 'TLSv1.3' AND cipher LIKE 'DHE-%' THEN concat_ws('-', 'DHE', bits) WHEN grp IS NOT NULL AND grp NOT LIKE '%MLKEM%' THEN concat('ECDHE-', CASE grp WHEN 'prime256v1' THEN 'P-256' ELSE grp END)
  WHEN protocol <> 'TLSv1.3' AND cipher LIKE 'ECDHE-%' THEN 'ECDHE' WHEN protocol = 'TLSv1.3' AND bits IS NOT NULL THEN concat_ws('-', 'FFDHE', bits) END AS kex FROM handshakes)""", "handshakes")  # fmt: skip
def tls_kex(spark, sf_dir):
    return estate.tls_kex(fixture(spark, sf_dir, "handshakes"))


@query("SELECT host, port, CASE WHEN bool_or(outcome = 'accepted') THEN 'supported' WHEN bool_or(outcome IN ('inconclusive', 'untestable')) THEN 'unknown' ELSE 'unsupported' END AS verdict, coalesce(string_agg(grp, ',' ORDER BY idx) FILTER (outcome = 'accepted'), '') AS accepted FROM probes GROUP BY host, port", "probes")
def tls_probe_summary(spark, sf_dir):
    return estate.tls_probe_summary(fixture(spark, sf_dir, "probes"))


@query("SELECT host, port, grp FROM probes WHERE outcome <> 'rejected'", "probes")
def tls_untried_groups(spark, sf_dir):
    return estate.tls_untried_groups(fixture(spark, sf_dir, "handshakes"), fixture(spark, sf_dir, "probes"))


_POSTURE = "CASE WHEN key_type IN ('rsa', 'ec', 'ed25519') THEN 'vulnerable' WHEN key_type = 'ml-dsa-87' THEN 'safe' ELSE 'unknown' END"


@query(f"SELECT key_type, key_bits, curve, {_POSTURE} AS pq_status, CASE WHEN key_type IN ('ml-dsa-87', 'unknown') THEN 'info' WHEN key_bits < 1024 THEN 'critical' WHEN key_bits < 2048 OR curve = 'secp192r1' THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM certs GROUP BY ALL", "certs")
def key_posture(spark, sf_dir):
    return estate.key_posture(fixture(spark, sf_dir, "certs")).groupBy("key_type", "key_bits", "curve", "pq_status", "severity").agg(F.count("*").alias("n"))


_SIGNED = "CASE WHEN signature_algorithm IS NULL OR signature_algorithm = '1.2.3.4' THEN 'unknown' WHEN signature_algorithm = 'ML-DSA-65' THEN 'safe' ELSE 'vulnerable' END"


@query(f"""SELECT host, port, classical, post_quantum, n - classical - post_quantum AS unknown, CASE WHEN post_quantum = n THEN 'info' ELSE 'medium' END AS severity, CASE WHEN classical > 0 THEN 'vulnerable' WHEN post_quantum < n THEN 'unknown' ELSE 'safe' END AS pq_status,
  CASE WHEN classical + post_quantum = n THEN 'confirmed' ELSE 'high' END AS confidence, CASE WHEN outside > 0 THEN false END AS cnsa2
  FROM (SELECT host, port, count(*) AS n, count(*) FILTER (p = 'vulnerable' OR g = 'vulnerable') AS classical, count(*) FILTER (p = 'safe' AND g = 'safe') AS post_quantum, count(*) FILTER (p = 'vulnerable' OR g <> 'unknown') AS outside
    FROM (SELECT *, {_POSTURE} AS p, {_SIGNED} AS g FROM certs WHERE chain_pos > 1 AND NOT self_signed) GROUP BY host, port)""", "certs")  # fmt: skip
def tls_chain(spark, sf_dir):
    return estate.tls_chain(fixture(spark, sf_dir, "certs"))


@query(f"SELECT host, valid_to, CAST(date_diff('day', DATE '{TODAY}', valid_to) AS INT) AS days_left, CASE WHEN valid_to < DATE '{TODAY}' THEN 'high' ELSE 'low' END AS severity FROM certs WHERE chain_pos = 1 AND date_diff('day', DATE '{TODAY}', valid_to) < 30", "certs")
def tls_validity(spark, sf_dir):
    return estate.tls_validity(fixture(spark, sf_dir, "certs"), TODAY)


_BLOCKED = " OR ".join(f"value BETWEEN {a} AND {b}" for a, b in map(dims.cidr_bounds, dims.BLOCKED_IPV4))


@query(f"SELECT event_id, ip, value, NOT ({_BLOCKED}) AS allowed FROM (SELECT *, CASE WHEN CAST(string_split(ip, '.')[4] AS INT) <= 255 THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END AS value FROM addresses)", "addresses")
def address_policy(spark, sf_dir):
    return estate.address_policy(fixture(spark, sf_dir, "addresses"))


@query("""SELECT raw, kind, CASE WHEN kind = 'host' THEN CASE WHEN raw LIKE '%:8443' THEN 8443 ELSE 443 END END AS port FROM (SELECT raw, CASE WHEN raw LIKE './%' OR raw LIKE '/%' THEN 'path' WHEN raw LIKE 'https://github.com/%' OR raw LIKE 'https://www.github.com/%' THEN 'github'
  WHEN raw LIKE '%.git' THEN 'remote' WHEN raw LIKE '%://%' OR raw LIKE '[%' THEN 'host' WHEN raw LIKE '%/%' THEN 'github' WHEN raw LIKE '% %' THEN 'invalid' ELSE 'host' END AS kind FROM scan_targets)""", "scan_targets")  # fmt: skip
def classify_targets(spark, sf_dir):
    return estate.classify_targets(fixture(spark, sf_dir, "scan_targets"))
