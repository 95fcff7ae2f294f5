"""Best-two-fit packing of tokenised documents into sequences.

Token counts lie between 1 and the sequence length, so what a plan needs to know of the
corpus is how many pieces there are of each length: a histogram of at most 2,048 rows
whatever the corpus. The plan is made on it: a bin is filled greedily, longest fitting
piece first; then its smallest piece is replaced by two unpacked pieces that fill its
expanded gap more tightly, if there are such. The same filling is repeated as often as
the counts allow, so the plan has some thousands of patterns for any number of bins.

The tasks then deal pieces out to the plan: the r-th piece of a length goes to the r-th
slot of that length. Ranks are counts of (length, bucket) plus the rank in the bucket, so
no task sees all pieces of a common length.

A null or empty text is the single id 0. Equal rows are packed each on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .token_counts import default_path, held, text_blocks

LENGTH = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def pieces(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, block_rows: int = 500) -> DataFrame:
    """The id sequences of the documents, cut at ``length``: place, length and CRC of each piece."""

    def cut(batches):
        known, end = held(path or default_path()), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            for a, texts in text_blocks(batch, block_rows):
                flat, ends = known.of(texts)
                flat, rows, s = flat.astype("<u4", copy=False), [], 0
                for doc_id, e in zip(batch.column(0).slice(a, len(texts)).to_pylist(), ends.tolist(), strict=True):
                    ids, s = flat[s:e].tobytes() + end, e
                    n, tie = len(ids) // 4, zlib.crc32(ids)
                    rows += [(doc_id, k, at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), tie) for k, at in enumerate(range(0, n, length))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def best_two_fit(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(how often, piece lengths) of each pattern; in all they use up the histogram."""
    left = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    patterns: list[tuple[int, list[int]]] = []

    def longest(most: int, own: list[int]) -> int:
        for k in np.flatnonzero(left[: most + 1])[::-1]:
            if left[k] > own.count(k):
                return int(k)
        return 0

    def two(gap: int, over: int, own: list[int]) -> tuple[int, int] | None:
        """The two unpacked pieces with the largest sum above ``over`` that fit the gap."""
        free = [int(k) for k in np.flatnonzero(left[: gap + 1]) if left[k] > own.count(int(k))]
        best, a, b = None, 0, len(free) - 1
        while a <= b:
            s = free[a] + free[b]
            if s > gap or (a == b and left[free[a]] - own.count(free[a]) < 2):
                b -= 1
            else:
                if s > over:
                    best, over = (free[b], free[a]), s
                a += 1
            if over == gap:
                break
        return best

    while left.any():
        own = [int(np.flatnonzero(left)[-1])]
        gap = length - own[0]
        while gap and (k := longest(gap, own)):
            own.append(k)
            gap -= k
        if gap and len(own) > 1 and (pair := two(gap + own[-1], own[-1], own[:-1])):
            own = [*own[:-1], *pair]
        kinds, uses = np.unique(own, return_counts=True)
        times = int((left[kinds] // uses).min())
        left[kinds] -= times * uses
        patterns.append((times, sorted(own, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, uses in a bin, first bin and first offset of its runs of slots."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, own in patterns:
        offset = 0
        for k in dict.fromkeys(own):
            uses = own.count(k)
            runs.setdefault(k, []).append((ranks.get(k, 0), uses, first, offset))
            ranks[k] = ranks.get(k, 0) + times * uses
            offset += k * uses
        first += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for k, r in runs.items()}


def ranked(rows: DataFrame, *, bucket_rows: int = 20_000) -> DataFrame:
    """Rank from 0 of each row among those of its length."""
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "tie")) - 1
    ahead = counts.select("length", "bucket", before.alias("before"))
    return rows.join(ahead, ["length", "bucket"]).withColumn("rank", F.col("before") + within).drop("bucket", "before")


def pack(docs: DataFrame, path: str | None = None, *, length: int = LENGTH) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    made = Scratch(spark, "packing").save(pieces(docs, path, length=length), "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(best_two_fit(histogram, length)))

    def deal(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for k in np.unique(lengths):
                own = lengths == k
                first, uses, base, start = plan.value[int(k)]
                run = np.searchsorted(first, ranks[own], "right") - 1
                at = ranks[own] - first[run]
                bins[own] = base[run] + at // uses[run]
                offsets[own] = start[run] + k * (at % uses[run])
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(made).mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
