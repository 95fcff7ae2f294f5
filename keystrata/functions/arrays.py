"""Array and text expressions that Spark has no function for; each takes time in proportion to its input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step, width: int = 32) -> Column:
    """For each of an array's whole numbers what an associative ``step`` makes of 0 and those before it.

    The array is folded in groups of ``width``, the results again, three times; each number
    then takes what stands before its group and the few before it in the group.
    """
    fold = lambda own: F.aggregate(own, F.lit(0), step)
    group = lambda i: F.floor(i / width).cast("int")

    def folded(own):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / width).cast("int") - 1, F.lit(0))), lambda i: fold(F.slice(own, i * width + 1, F.lit(width))))

    def before(own, above):
        return let(above, lambda up: F.transform(own, lambda _, i: step(F.get(up, group(i)), fold(F.slice(own, group(i) * width + 1, i % width)))))

    def top(own):
        return F.transform(own, lambda _, i: fold(F.slice(own, F.lit(1), i)))

    return let(values, lambda v0: let(folded(v0), lambda v1: let(folded(v1), lambda v2: let(folded(v2), lambda v3: before(v0, before(v1, before(v2, top(v3))))))))


def running_totals(sizes: Column) -> Column:
    """For each of an array's whole numbers the sum of those before it."""
    return running(sizes, lambda at, x: at + x)


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK characters, of which ``cut`` takes parts without reading from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, a: Column, b: Column) -> Column:
    """Characters [a, b) of a text in ``chunks``."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    first = F.substring(piece(i), a % CHUNK + 1, F.when(i == j, b - a).otherwise(F.lit(CHUNK)))
    rest = F.concat(F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), b % CHUNK))
    return F.concat(first, F.when(i < j, rest).otherwise(F.lit("")))
