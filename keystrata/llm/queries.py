"""The registered queries opN_<name>: thin callers of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, ngram_join, periodic_runs, secret_scan, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = decontamination
    return op.digest(op.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as op

    docs = table(spark, sf_dir, "documents")
    model = op.fit(docs.where(remainder(3) != 1))
    return op.predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = ngram_join
    return op.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts as op

    return op.digest(op.token_counts(table(spark, sf_dir, "documents")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = fingerprints
    return op.digest(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = secret_scan
    return op.digest(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as op

    return op.pack(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = substring_dedup
    return op.deduplicate(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = url_filter
    return op.judge(table(spark, sf_dir, "pages"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality as op

    docs = table(spark, sf_dir, "documents")
    model = op.fit(docs.where(remainder(4) != 2), table(spark, sf_dir, "labels"))
    return op.score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= op.THRESHOLD).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as op

    docs = table(spark, sf_dir, "documents")
    model = op.fit(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return op.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= op.THRESHOLD).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic_runs as op

    return op.digest(op.find(table(spark, sf_dir, "documents"), prepare=op.looped))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_repair as op

    rows = table(spark, sf_dir, "conversations")
    return op.repair(rows, op.damaged(rows))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_ngram_jaccard, op4_token_counts, op5_spotsigs, op6_secret_scan, op7_best_fit_packing, op8_suffix_dedup, op9_url_filter, op10_quality_crf, op11_toxicity, op12_periodic_runs, op13_conversation_repair)}
#: SQL has no word for the library's tokens, trained models and packing; tests hold these against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE_SQL,
    "op3_ngram_jaccard": ngram_join.oracle_sql(4, 85, 100),
    "op5_spotsigs": fingerprints.ORACLE_SQL,
    "op6_secret_scan": secret_scan.ORACLE_SQL,
    "op8_suffix_dedup": substring_dedup.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op12_periodic_runs": periodic_runs.ORACLE_SQL,
}
