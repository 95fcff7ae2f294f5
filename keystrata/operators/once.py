"""Work that hangs on few different values of a column, done once for each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many different values are judged once and sent to every task; beyond that every row's value is judged where it is.
MOST_VALUES = 100_000


def judged_once(rows: DataFrame, key: str, judged: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``judged``, which depend on the column ``key`` (null included) alone."""
    values = rows.select(key).distinct().limit(MOST_VALUES + 1).collect()
    if len(values) > MOST_VALUES:
        return rows.withColumns(judged)
    known = rows.sparkSession.createDataFrame(values, rows.select(key).schema).withColumns(judged).withColumnRenamed(key, f"_{key}")
    return rows.join(F.broadcast(known), F.col(key).eqNullSafe(F.col(f"_{key}")), "left").drop(f"_{key}")
