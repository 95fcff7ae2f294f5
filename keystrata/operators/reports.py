"""Findings as rows of reports. Every report is one row for each finding, written by the
caller with ``partitionBy("target")``, so that no target has to fit in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import dims

# Result levels by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
# Scores of severities that code scanning reads, and the schema of a log.
SCORES = {"critical": "9.5", "high": "8.0", "medium": "5.0", "low": "3.0", "info": "0.0"}
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"


def json_rows(findings: DataFrame) -> DataFrame:
    """(target, ord, line): a finding as one line of JSON, nulls written out."""
    body = F.struct("rule_id", "category", "severity", "pq_status", "algorithm", "context")
    return findings.select("target", "ord", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(target, ord, line): a finding as a row of a Markdown table, its text escaped."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\`*_\[\]<>|~&]", r"\\$0")
    return findings.select("target", "ord", F.concat(F.lit("| "), F.upper("severity"), F.lit(" | "), safe("rule_id"), F.lit(" | "), safe("algorithm"), F.lit(" |")).alias("line"))


def _by_severity(values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for severity in dims.SEVERITIES:
        out = F.when(F.col("severity") == severity, values[severity]).otherwise(out)
    return out


def _rules(findings: DataFrame) -> DataFrame:
    """(target, rule_id, rule_index): rules are made distinct before they are ranked."""
    rules = findings.select("target", "rule_id").distinct()
    return rules.withColumn("rule_index", F.row_number().over(Window.partitionBy("target").orderBy("rule_id")) - 1)


def results(findings: DataFrame) -> DataFrame:
    """(target, ord, rule_index, level): results against the index of their rule."""
    return findings.join(_rules(findings), ["target", "rule_id"]).select("target", "ord", "rule_index", _by_severity(LEVELS).alias("level"))


def pascal(text: Column) -> Column:
    """The words of an identifier with capitals, put together."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def sarif_lines(findings: DataFrame, tool: str = "keystrata") -> DataFrame:
    """(target, part, ord, line): a SARIF log in lines. A target's lines by part, ord and, for equal ord, line descending are its log.

    No target is put together in a task: the caller writes the lines sorted within ``target``.
    Rows without target, rule_id or ord are left out, as a log cannot hold them; equal rows are
    results of their own.
    """
    findings = findings.dropna(subset=["target", "rule_id", "ord"])
    rules = _rules(findings)
    targets = findings.groupBy("target").agg(F.min("ord").alias("least"))
    comma = lambda first: F.when(first, "").otherwise(",")
    score = _by_severity(SCORES)
    host = F.when(F.contains("host", F.lit(":")), F.concat(F.lit("["), "host", F.lit("]"))).otherwise(F.col("host"))
    at = F.concat(host, F.when(F.col("port").isNotNull(), F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise(""))
    endpoint = F.struct(
        F.struct(F.struct(F.concat(F.lit("tls://"), at).alias("uri")).alias("artifactLocation")).alias("physicalLocation"),
        F.array(F.struct(at.alias("name"), F.lit("resource").alias("kind"), at.alias("fullyQualifiedName"))).alias("logicalLocations"),
    )
    body = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), _by_severity(LEVELS).alias("level"), (score.cast("double") * 10).cast("int").alias("rank"),
        F.struct(F.concat_ws(": ", "rule_id", "algorithm").alias("text")).alias("message"), F.when(F.col("host").isNotNull(), F.array(endpoint)).alias("locations"),
        F.struct("severity", score.alias("security-severity"), "pq_status").alias("properties"),
    )
    # Only the least line of the least ord goes without a comma.
    own = findings.join(rules, ["target", "rule_id"]).select("target", "ord", F.to_json(body).alias("line"))
    place = F.row_number().over(Window.partitionBy("target", "ord").orderBy("line"))
    marked = own.withColumn("k", place).join(targets, "target").withColumn("first", (F.col("ord") == F.col("least")) & (F.col("k") == 1))
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[')
    none = F.lit(0).cast("long")
    parts = (
        targets.select("target", F.lit(0).alias("part"), none.alias("ord"), head.alias("line")),
        rules.select("target", F.lit(1), F.col("rule_index").cast("long"), F.concat(comma(F.col("rule_index") == 0), F.to_json(F.struct(F.col("rule_id").alias("id"), pascal(F.col("rule_id")).alias("name"))))),
        targets.select("target", F.lit(2), none, F.lit(']}},"results":[')),
        marked.select("target", F.lit(3), F.col("ord").cast("long"), F.concat(comma(F.col("first")), "line")),
        targets.select("target", F.lit(4), none, F.concat(F.lit('],"properties":'), F.to_json(F.struct("target")), F.lit("}]}"))),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
