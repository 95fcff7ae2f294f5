"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of a file that a round writes, once the number of edges is known.
FILE_ROWS = 50_000


def _star(rows: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): ties u's neighbours, the larger ones or all of them, to the least of u and its neighbours.

    The least neighbour is a minimum, combined before the shuffle, and comes to the edges by
    a join whose partitions Spark splits where a node has very many edges; no task has to
    see all neighbours of a node.
    """
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m") if large else F.min("v").alias("m"))
    met = rows.join(least, "u")
    if large:
        return met.where("v > u").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).where("a < b")
    return met.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _stars(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    once = _star(edges.select(both).select("e.u", "e.v"), True)
    return _star(once.select(F.col("b").alias("u"), F.col("a").alias("v")), False).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root): the least node of its component, for every node that has an edge.

    ``edges`` has long columns a and b; loops and repeats are allowed. Every round is written
    to the scratch folder, so that the lineage stays short; it ends when no edge changes.
    From the second on it writes as many files as the edges of the round before need: for
    each file of a local folder Spark starts processes that for a moment share all of the
    executor's memory, and a file for each of very many partitions makes thousands of them.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    before, r = None, 0
    while True:
        e = _stars(e)
        e = scratch.save(e if before is None else e.coalesce(1 + before[0] // FILE_ROWS), f"{name}-{r}")
        seen = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())
        if r:
            scratch.drop(f"{name}-{r - 1}")
        if seen == before:
            break
        before, r = seen, r + 1
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
