"""Findings of an endpoint: its key exchange, its trust, and all of them in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.operators import estate


def key_exchange(shakes: DataFrame, probes: DataFrame) -> DataFrame:
    """What each endpoint's session and probes tell of its key exchange: severity, pq_status, confidence, algorithm, cnsa2.

    A group that the session used counts as accepted. Probes are reduced to one row an endpoint before the session meets them."""
    groups = shakes.sparkSession.createDataFrame([(k, g.lower(), g, kem == "ML-KEM-1024", hybrid) for k, (g, kem, hybrid) in enumerate(dims.PQ_GROUPS)], "pref int, low string, name string, large boolean, hybrid boolean")
    used = shakes.select("host", "port", F.lower("grp").alias("low"), F.lit("accepted").alias("outcome"), F.lit(0).alias("probed")).where("low is not null")
    tried = used.unionByName(probes.select("host", "port", F.lower("grp").alias("low"), "outcome", F.lit(1).alias("probed"))).join(F.broadcast(groups), "low")
    taken = F.col("outcome") == "accepted"
    told = tried.groupBy("host", "port").agg(
        F.min(F.when(taken, F.struct("pref", "name")))["name"].alias("group"), F.bool_or(taken & F.col("large")).alias("large"), F.bool_and(F.when(taken, F.col("hybrid"))).alias("hybrid"),
        F.count_distinct(F.when(F.col("outcome") == "rejected", F.col("low"))).alias("refused"), F.sum("probed").alias("probes"), F.count_if(F.col("outcome") == "untestable").alias("untested"),
    )
    session = estate.tls_kex(shakes.withColumn("host", F.struct("host", "port", "protocol"))).select("host.*", "kex", "weak")
    rows = session.join(told, ["host", "port"], "left")
    old, pq, refused, kex = F.col("protocol") != "TLSv1.3", F.col("group").isNotNull(), F.coalesce("refused", F.lit(0)), F.col("kex")
    case = F.when(old, "old").when(pq, "accepted").when(refused > 0, "refused").when((F.col("probes") > 0) & (F.col("untested") == F.col("probes")), "untested").when(kex.isNotNull(), "classical").otherwise("open")
    rows = rows.withColumn("case", case)
    is_ = lambda *names: F.col("case").isin(*names)
    return rows.select(
        "host", "port", "case", F.when(is_("old") & (F.col("weak") | F.coalesce(kex == "static-RSA-key-exchange", F.lit(False))), "high").when(is_("old", "refused", "classical"), "medium").otherwise("info").alias("severity"),
        F.when(is_("old", "refused", "classical"), "vulnerable").when(is_("accepted"), F.when(F.col("hybrid"), "transitional").otherwise("safe")).otherwise("unknown").alias("pq_status"),
        F.when(is_("old", "accepted"), "confirmed").when(is_("refused") & (refused == len(dims.PQ_GROUPS)), "high").when(is_("refused", "classical"), "medium").otherwise("low").alias("confidence"),
        F.when(is_("accepted"), F.col("group")).when(is_("old", "refused", "classical"), kex).alias("algorithm"), F.when(is_("accepted"), F.col("large")).when(is_("old", "refused", "classical"), F.lit(False)).alias("cnsa2"),
    )


def trust(errors: DataFrame) -> DataFrame:
    """Endpoints whose chain did not validate, and those that refused every handshake."""
    failed = errors.where("authorization_error is not null").select("host", "port", F.lit("tls/chain-untrusted").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("unknown").alias("pq_status"), F.col("authorization_error").alias("evidence"))
    refused = errors.where("handshake_refused is not null").select("host", "port", F.lit("tls/handshake-refused").alias("rule_id"), F.lit("info").alias("severity"), F.lit("unknown").alias("pq_status"), F.col("handshake_refused").alias("evidence"))
    return failed.unionByName(refused)


def findings(shakes: DataFrame, probes: DataFrame, certs: DataFrame, errors: DataFrame, today: str) -> DataFrame:
    """(host, port, rule_id, severity, pq_status) of every finding of the endpoints."""
    said = lambda rows, rule, status="pq_status": rows.select("host", "port", F.lit(rule).alias("rule_id") if isinstance(rule, str) else rule.alias("rule_id"), "severity", F.col(status) if status == "pq_status" else F.lit(status).alias("pq_status"))
    signatures = F.when(F.col("chain_pos") == 1, "tls/leaf-signature").otherwise("tls/intermediate-signature")
    ports = certs.where("chain_pos = 1").select("host", "port", "chain_pos", "valid_to")
    parts = [
        said(estate.tls_leaf_keys(certs), "tls/leaf-public-key"), said(estate.tls_signatures(certs), signatures), said(estate.tls_chain(certs), "tls/chain-classical"), said(key_exchange(shakes, probes), "tls/hybrid-kex"),
        said(estate.tls_without_leaf(shakes, certs).withColumn("severity", F.lit("info")), "tls/no-leaf", "unknown"), trust(errors).drop("evidence"),
        said(estate.tls_validity(ports.withColumn("host", F.struct("host", "port")), today).select("host.*", "severity"), F.when(F.col("severity") == "high", "tls/leaf-expired").otherwise("tls/leaf-expiring"), "unknown"),
        said(estate.tls_protocol(shakes.withColumn("host", F.struct("host", "port"))).select("host.*", "severity", "pq_status"), "tls/negotiated-protocol"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
