"""Findings to threats, assets, ledger and obligations.

Findings are reduced to assets first; profiles (data class and quantum date) meet the
reduced rows only, so a what-if grid does not multiply the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import dims, vocabulary
from keystrata.functions.vocabulary import cnsa2_standing
from keystrata.operators.once import judged_once


def rank_of(values, column: str) -> Column:
    out = F.lit(len(values))
    for k, v in enumerate(values):
        out = F.when(F.col(column) == v, k).otherwise(out)
    return out


def by_label(findings: DataFrame) -> DataFrame:
    """``findings`` with what their label alone tells: broken (why its use is broken today), weak (below minimum strength) and standing (CNSA 2.0)."""
    own = F.col("algorithm")
    return judged_once(findings, "algorithm", {"broken": vocabulary.broken(own), "weak": vocabulary.below_strength(own), "standing": cnsa2_standing(own)})


def uses_told() -> Column:
    """What a finding's algorithm is used for, as it says itself or else as its rule tells; empty where neither does."""
    usage = F.when(F.col("usage") != "", F.split("usage", ","))
    for rule, uses in dims.USAGE_BY_RULE.items():
        usage = F.coalesce(usage, F.when(F.col("rule_id") == rule, F.array(*map(F.lit, uses))))
    return F.coalesce(usage, F.when(F.col("rule_id").rlike("^keys/(?:[a-z0-9-]*-)?private-key"), F.array(F.lit("secret-material"))), F.when(F.startswith("rule_id", F.lit("jwt/")), F.array(F.lit("authentication"))), F.array().cast("array<string>"))


def with_threats(findings: DataFrame) -> DataFrame:
    """Adds uses (array), reason (classical break), threats (array in order of urgency) and the columns of ``by_label``."""
    rows = by_label(findings).withColumn("uses", uses_told())
    broken, weak = F.col("broken"), F.when(F.col("weak"), "below minimum strength")
    reason = F.coalesce(F.when(F.array_contains("uses", "secret-material"), "secret material"), F.col("classical_break"), F.when(F.col("pq_status") == "vulnerable", F.coalesce(broken, weak)))
    rows = rows.withColumn("reason", reason)
    harvest = F.arrays_overlap("uses", F.array(*map(F.lit, dims.HARVEST)))
    forge = F.arrays_overlap("uses", F.array(*map(F.lit, dims.FORGE)))
    quantum = F.array_compact(F.array(F.when(harvest | ~forge, "harvest-now"), F.when(forge | ~harvest, "forge-later")))
    threats = F.when(F.col("reason").isNotNull(), F.array(F.lit("classical"))).when(F.col("pq_status") == "vulnerable", quantum).otherwise(F.array(F.lit("not-applicable")))
    return rows.withColumn("threats", threats)


def profiles(spark: SparkSession, years=dims.CRQC_YEARS, today: float = 2026.0) -> DataFrame:
    rows = [(c, float(h), s, y) for c, h, s, _ in dims.DATA_CLASSES for y in years]
    return spark.createDataFrame(rows, "data_class string, horizon double, sensitivity double, crqc int").withColumn("z", F.col("crqc") - F.lit(today))


def with_verdict(rows: DataFrame) -> DataFrame:
    """Adds status, complete and start (years) to rows with threat, horizon and z."""
    t, x, z = F.col("threat"), F.col("horizon"), F.col("z")
    years = F.when(t == "harvest-now", 3.0).otherwise(5.0)
    complete = F.when(t == "classical", 0.0).when((t == "harvest-now") & (x > 0), z - x).when(t == "forge-later", z)
    start = F.when(t == "classical", 0.0).otherwise(complete - years)
    late = F.when(t == "harvest-now", complete < 0).otherwise(complete <= 0)
    status = F.when(t == "classical", "act-now").when(complete.isNull(), "not-applicable").when(late, "exposed").when(start < 0, "overdue").otherwise("on-track")
    return rows.withColumns({"status": status, "complete": complete, "start": start})


def asset_threats(findings: DataFrame) -> DataFrame:
    """A row for each target, asset and threat, with the asset's own columns repeated."""
    rows = with_threats(findings)
    endpoint = (F.col("category") == "tls") & F.col("host").isNotNull() & F.array_contains("threats", "harvest-now")
    key = F.when(endpoint, F.format_string("tls/key-establishment@%s:%d", "host", "port")).otherwise(F.concat_ws(":", "rule_id", "algorithm"))
    own = F.when(F.exists("uses", lambda u: u.isin("key-establishment", "signature", "authentication")) & (F.col("pq_status") == "vulnerable"), False)
    rows = rows.withColumns({"asset": key, "nonprod": F.col("context").isNotNull(), "cnsa2": F.coalesce(F.col("standing"), own), "sev": rank_of(dims.SEVERITIES, "severity"), "pq": rank_of(dims.PQ_STATUSES, "pq_status")})
    each = rows.withColumn("threat", F.explode("threats")).groupBy("target", "nonprod", "asset", "threat").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min("sev").alias("sev"), F.min("pq").alias("pq"), F.bool_and("cnsa2").alias("cnsa2"))
    whole = Window.partitionBy("target", "nonprod", "asset")
    return each.withColumns({"sev": F.min("sev").over(whole), "pq": F.min("pq").over(whole), "cnsa2": F.min(F.col("cnsa2").cast("int")).over(whole)})


def assets(findings: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for each target, profile and asset, with its most urgent verdict; ties keep the first finding, then harvest-now."""
    rows = with_verdict(asset_threats(findings).join(F.broadcast(grid)))
    urgency = F.when(F.col("status").isin("act-now", "exposed"), 0).when(F.col("status") == "overdue", 1).when(F.col("status") == "on-track", 2).otherwise(3)
    order = F.when(F.col("threat") == "harvest-now", 0).otherwise(1)
    best = F.min_by(F.struct("threat", "status", "complete", "start"), F.struct(urgency, F.col("ord"), order))
    out = rows.groupBy("target", "data_class", "crqc", "horizon", "sensitivity", "nonprod", "asset").agg(best.alias("best"), F.min("sev").alias("sev"), F.min("pq").alias("pq"), F.min("cnsa2").alias("cnsa2"))
    return out.select("target", "data_class", "crqc", "horizon", "sensitivity", "nonprod", "asset", "best.*", "sev", "pq", "cnsa2")


def ledger(rows: DataFrame) -> DataFrame:
    prod = ~F.col("nonprod")
    exposed = prod & (F.col("threat") == "harvest-now") & (F.col("status") == "exposed")
    count = lambda c: F.count_if(prod & (F.col("status") == c))
    return rows.groupBy("target", "data_class", "crqc").agg(
        F.count_if(prod).alias("assets"), F.count_if("nonprod").alias("nonprod_assets"), F.count_if(exposed).alias("exposed"), count("overdue").alias("overdue"),
        count("act-now").alias("act_now"), count("on-track").alias("on_track"), F.round(F.coalesce(F.sum(F.when(exposed, F.col("horizon") * F.col("sensitivity"))), F.lit(0.0)), 6).alias("risk_years"),
    )


def obligation_counts(rows: DataFrame) -> DataFrame:
    """Production assets in breach of each obligation of the profile's data class; obligations without any count 0."""
    spark = rows.sparkSession
    bound = spark.createDataFrame([(c, o) for c, _, _, own in dims.DATA_CLASSES for o in own], "data_class string, obligation string")
    scopes = spark.createDataFrame([(o, list(s)) for o, s in dims.OBLIGATIONS], "obligation string, scopes array<string>")
    scope = F.when(F.col("threat") == "harvest-now", "confidentiality").when(F.col("threat") == "forge-later", "identity").when(F.col("threat") == "classical", "classical-strength")
    joined = rows.join(F.broadcast(bound), "data_class").join(F.broadcast(scopes), "obligation")
    off = F.col("status").isin("exposed", "overdue", "act-now") & F.array_contains("scopes", scope)
    breach = off | (F.array_contains("scopes", "cnsa2-algorithms") & (F.col("cnsa2") == 0))
    return joined.groupBy("target", "data_class", "crqc", "obligation").agg(F.count_if(~F.col("nonprod") & F.coalesce(breach, F.lit(False))).alias("breaches"))
