"""Runs of repeated words, by the dictionary of basic factors.

A run is a maximal stretch of words with smallest period q, at least ``least`` words and
``power`` times q long. For every power of two L the factors of L words are named: names
of length 2L come from pairs of names of length L. Where a factor's next two occurrences
in its text follow at one distance d, with L/2 < d <= L, the three form an arithmetic
progression and propose the period d: inside a run of period q <= L a factor of L words
comes back after q words and not before, as a primitive root differs from its rotations.
Positions in progression are joined to stretches, extended while the words agree, and
deduplicated. Only positions whose factor stands elsewhere in the same text go on to the
next length, so plain prose is left after few of them; a text of n words takes log n sorts.

A null or empty text has no words and no runs. Rows are judged one by one: equal rows each
give their row, whatever their doc_id, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LEAST, POWER = 6, 4
BLOCK_BYTES = 1 << 20
KIND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def runs_of(names: np.ndarray, doc: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """First place, length and period of every run, in order of place and period; ``doc`` rises along the words."""
    n = len(names)
    if not n or power < 4:
        if power < 4:
            raise ValueError("three occurrences of a factor of up to twice the period fit into four periods or more")
        return np.zeros((0, 3), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    words = np.repeat(np.diff(edge), np.diff(edge))  # of the text that a word stands in
    full = np.full(n, -1, np.int64)
    at, key, size, found = np.arange(n), names.astype(np.int64), 1, []
    while len(at):
        order = np.argsort(key, kind="stable")
        place, sorted_key = at[order], key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        again = ~fresh[1:] & (doc[place[1:]] == doc[place[:-1]])
        gap = np.diff(place)
        near = again & (gap <= size) & (2 * gap > size)
        three = near[:-1] & near[1:] & (gap[:-1] == gap[1:])
        found.append(_stretches(names, doc, place[:-2][three], gap[:-1][three], size))
        full[:] = -1
        twice = np.zeros(len(at), bool)
        twice[1:] |= again
        twice[:-1] |= again
        full[place[twice]] = (np.cumsum(fresh) - 1)[twice]
        at = np.sort(place[twice])
        at = at[(at + size < n) & (words[at] >= power * (size + 1))]  # periods above ``size`` are left to look for
        at = at[(full[np.minimum(at + size, n - 1)] >= 0) & (doc[at] == doc[np.minimum(at + size, n - 1)])]
        key = full[at] * n + full[np.minimum(at + size, n - 1)]
        size *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[runs[:, 1] >= np.maximum(least, power * runs[:, 2])]


def _stretches(names, doc, start, period, size) -> np.ndarray:
    """Stretches of consecutive places in progression at one distance, with all words that go on with the period."""
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    head = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(period) != 0) | (doc[start[1:]] != doc[start[:-1]])])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(start) - 1)
    a, q = start[head], period[head]
    b = start[last] + 2 * q + size
    for side in (-1, 1):
        open_ = np.arange(len(a))
        while len(open_):
            i = (a if side < 0 else b - q)[open_] + min(side, 0)  # the word that would be compared with the one a period on
            j = i + q[open_]
            ok = (i >= 0) & (j < len(names))
            open_, i, j = open_[ok], i[ok], j[ok]
            ok = (names[i] == names[j]) & (doc[i] == doc[j]) & (doc[i] == doc[a[open_]])
            open_ = open_[ok]
            if side < 0:
                a[open_] -= 1
            else:
                b[open_] += 1
    return np.stack([a, b - a, q], 1)


def find(docs: DataFrame, *, least: int = LEAST, power: int = POWER, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, number of words, runs (by start and period) and the text without repeats of each document.

    A word is dropped from ``collapsed`` if some run holds it after its first ``period``
    words; the others are joined by one space. ``prepare`` may give other words for a row.
    """

    def turn(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in B.texts(batch.column(1), BLOCK_BYTES):
                raw = data.tobytes()
                texts = [raw[offsets[i] : offsets[i + 1]].split() for i in range(end - first)]  # at the six bytes of white space
                if prepare:
                    texts = [prepare(ids[first + i], words) for i, words in enumerate(texts)]
                size = np.array([len(words) for words in texts], np.int64)
                known: dict[bytes, int] = {}
                number = count()
                names = np.fromiter((known.setdefault(w, k) for w, k in zip((w for words in texts for w in words), number)), np.int64, int(size.sum()))
                doc, base = np.repeat(np.arange(len(texts)), size), np.concatenate([[0], np.cumsum(size)])
                runs = runs_of(names, doc, least, power)
                own = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
                cover = np.zeros(len(names) + 1, np.int64)
                np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
                stay = np.cumsum(cover[:-1]) == 0
                collapsed = [b" ".join(words if stay[a:b].all() else [words[k] for k in np.flatnonzero(stay[a:b])]) for words, a, b in zip(texts, base, base[1:])]
                parts = pa.StructArray.from_arrays([pa.array(runs[:, 0] - base[own]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                offset = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
                columns = [batch.column(0).slice(first, end - first), pa.array(size), pa.ListArray.from_arrays(offset, parts), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(turn, KIND)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: from a chosen word on, one document in ten repeats itself. A null doc_id counts as the empty text."""
    h, n = crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    loop = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + list(islice(loop * ((n - a) // len(loop) + 1), n - a))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), hashes of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("_top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("_top.length"), -F.col("_top.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("_top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.when(F.col("_top").isNotNull(), F.floor(1000 * length / period)).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: crc32 of a text by its definition, bit by bit; ``{}`` is an expression without the lambda names used here.
SQL_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({0}))::BIGINT), lambda p: (ascii(substr({0}, (p + 1)::BIGINT, 1)))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))"""

#: Every pair of words a period apart is compared; stretches of equal pairs make the runs. A stretch's smallest period counts.
ORACLE_SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w0, coalesce(doc_id::VARCHAR, '') AS name FROM documents),
h AS (SELECT *, len(w0) AS n, {SQL_CRC32.format("name")} AS h FROM raw),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM p),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM d),
named AS (SELECT r, i, dense_rank() OVER (ORDER BY word) AS word FROM words),
ids AS (SELECT r, list(word ORDER BY i) AS w, count(*) AS n FROM named GROUP BY r),
periods AS (SELECT r, w, n, unnest(range(1, n // 4 + 1)) AS q FROM ids),
equal AS (SELECT r, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM periods),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS m FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, m, min(q) AS q FROM stretches GROUP BY r, s, m),
best AS (SELECT r, count(*) AS n_runs, arg_max([s, m, q], [m, -s, -q]) AS top, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period, (1000 * top[2]) // top[3] AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def brute_force(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by comparing all pairs of words."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                out.setdefault((i, j + q - i), q)  # a smaller period of the same stretch came first
            i = max(j, i + 1)
    return sorted((a, m, q) for (a, m), q in out.items())
