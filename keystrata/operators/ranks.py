"""Ranks and running sums within groups, of which one may hold most of all rows.

Rows are dealt out by range of group and order, so a large group lies in many neighbouring
parts. Totals of the parts, a few rows a group, give what stands before each; rows are
counted within their part only. Parts are written once, as their bounds come from a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.sources.shared import saved


def ranked(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None, place: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in their group, and for each name in ``sums`` the running total of that column, own row included.

    ``order`` has to tell rows of a group apart, or equal ones are placed as they come; nulls of ``by`` are a group.
    """
    sums = sums or {}
    orders = {f"_o{i}": c for i, c in enumerate(order)}
    parts = saved(rows.withColumns(orders).repartitionByRange(*by, *orders).withColumn("_part", F.spark_partition_id()), "ranks")
    totals = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_b_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in ("_n", *(f"_s_{name}" for name in sums))])
    inside = Window.partitionBy(*by, "_part").orderBy(*orders)
    counted = parts.withColumns({place: F.row_number().over(inside)} | {name: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for name, c in sums.items()})
    same = (F.col("_part") == F.col("_b_part"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    met = counted.join(before, same, "left")
    added = {place: F.col(place) + F.col("_b_n")} | {name: F.col(name) + F.col(f"_b_s_{name}") for name in sums}
    return met.withColumns(added).select(*rows.columns, *[c for c in (place, *sums) if c not in rows.columns])
