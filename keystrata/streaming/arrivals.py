"""Observations judged as they arrive: the per-row jobs run unchanged on a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.shared import shared_folder


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files at ``path``, with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # a stream wants a pattern; this one fits the path alone


def judged_once(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Runs ``job`` over all that has arrived, appends its rows to a table in the shared folder and reads them."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = job(rows)
    run = out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def per_hour(findings: DataFrame, seen: str = "seen_at", late: str = "1 hour") -> DataFrame:
    """Findings an hour by severity; rows later than ``late`` are left out of windows already given."""
    return findings.withWatermark(seen, late).groupBy(F.window(seen, "1 hour").alias("hour"), "severity").agg(F.count("*").alias("findings"))
