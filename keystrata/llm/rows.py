"""Keeping or dropping rows of a table of documents, with all their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many keys (16 bytes each) go to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A model tells apart at most so many values of its label, the most frequent ones.
MOST_LABELS = 1000


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Name of a row by what it holds, doc_id and text, nulls told from empty ones: 128 bits."""
    parts = (F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.unhex(F.md5(F.concat_ws(" ", *parts)))


def bounded(keys: DataFrame, most: int | None = None) -> DataFrame:
    """``keys``, marked for a broadcast if there are few of them."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if most is None else most) else keys


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` whose key is ("left_semi") or is not ("left_anti") among ``keys`` (column key)."""
    own = free_name(docs, "_own")
    keys = bounded(keys.select(F.col("key").alias(free_name(docs, "_key"))).distinct())
    return docs.withColumn(own, key()).join(keys, F.col(own) == keys[keys.columns[0]], how).select(*docs.columns)


def bounded_sample(rows: DataFrame, by: str, most: int, name: Column, total: int | None = None) -> DataFrame:
    """About ``most`` rows for each value of ``by``, those with the smallest hashes of ``name``; the same at every run.

    A value with more rows keeps each row whose hash lies in the share that ``most`` is of
    them, so nothing is ranked and no value meets in one task. The number kept strays from
    ``most`` by its square root; rows with the same name count once. With ``total``, all
    values together get about so many rows. Values beyond the MOST_LABELS most frequent get none.
    """
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_by").limit(MOST_LABELS)
    kinds = max(1, counts.count()) if total else 1
    wanted = min(most, -(-total // kinds)) if total else most
    named = rows.select(F.col(by).alias("_by"), name.alias("_name"), F.struct(*rows.columns).alias("_row"))
    share = F.pmod(F.col("_name"), F.lit(1 << 40)) / float(1 << 40)
    near = named.join(F.broadcast(counts), "_by").where(share * F.col("_n") <= wanted)
    return near.groupBy("_by", "_name").agg(F.first("_row").alias("_row")).select("_row.*")
