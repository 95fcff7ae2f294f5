"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is 13 consecutive words of an item (a shorter item is one window). A window is a
set of three-word shingles ordered by rarity in the corpus. As a document must hold the
whole window, containment 1, the necessary prefix is the rarest shingle alone: documents
are joined with windows on it. A candidate then has to pass the positional bound (the
shingle's place in the window fixes where the window would start), the length bound (the
document must be long enough there) and, last, equality of all the words.

The corpus is read twice, however many windows there are. The first pass counts shingles
in a sketch of fixed size, merged over all tasks; it only decides which shingle of a window
is joined on, so its errors cost time, never results. The second pass sends on the places
of shingles that may be a prefix (a Bloom filter of all prefixes, 16 bits each and at most
2^30), each with the words about it, to the join with the windows; Spark broadcasts the
windows if their table is small, and deals a common shingle out over SALTS tasks if not.

A row of ``docs`` is known by its doc_id and text (128 bits); every row gives its row,
also equal ones, those without doc_id and those that share one. Nulls and empty texts have
no words: no hit, not contaminated. Items without words, or with a null text, are passed
over; a null item_id too.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .rows import bounded, free_name, key
from .scratch import Scratch
from .sketch import Sketch, bloom_filter, bloom_has, bloom_sized, merged, sent_sketch

WINDOW = 13
SHINGLE = 3
SALTS = 16


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows, as their lower-cased words joined by spaces, each with its items."""

    def windows(batches):
        for batch in batches:
            ids, keys, names = batch.column(0).to_pylist(), [], []
            for a, b, data, offsets in B.texts(batch.column(1)):
                data = B.LOWER[data]
                starts, stops, row = B.word_spans(data, offsets, B.ALNUM)
                words = [data[s:e].tobytes() for s, e in zip(starts, stops, strict=True)]
                at = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    own = words[at[i] : at[i + 1]]
                    for j in range(max(1, len(own) - size + 1) if own else 0):
                        keys.append(b" ".join(own[j : j + size]))
                        names.append(ids[a + i])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(names, pa.string())], ["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return items.mapInArrow(windows, "window binary, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _grams(h: np.ndarray, row: np.ndarray, lengths=range(1, SHINGLE + 1)):
    """(k, shingles of k words, whether each lies in one row) of a block."""
    for k in lengths:
        g = B.chained(h, k)
        yield k, g, row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)


def corpus_sketch(docs: DataFrame) -> Sketch:
    """Counters of the corpus's shingles of one to SHINGLE words."""

    def grams(batches):
        for batch in batches:
            for _, _, data, offsets in B.texts(batch.column(0)):
                data = B.LOWER[data]
                starts, stops, row = B.word_spans(data, offsets, B.ALNUM)
                for _, g, own in _grams(B.span_hashes(data, starts, stops), row):
                    yield g[own]

    return merged(docs.select("text").mapInArrow(lambda batches: sent_sketch(grams(batches)), "part int, counts binary"))


def prefixes(windows: DataFrame, sketch: Sketch) -> DataFrame:
    """(shingle, place, n, window, items): each window by its rarest shingle, the place of that in it and its words."""
    sent = windows.sparkSession.sparkContext.broadcast(sketch)

    def pick(batches):
        for batch in batches:
            counts = sent.value.counts()
            shingle, place, n = [], [], []
            for window in batch.column(0).to_pylist():
                data = np.frombuffer(window, np.uint8)
                starts, stops, _ = B.word_spans(data, np.array([0, len(data)]), B.ALNUM)
                h = B.span_hashes(data, starts, stops)
                g = B.chained(h, min(SHINGLE, len(h)))
                j = int(np.lexsort((g, counts[(g % np.uint64(len(counts))).astype(np.int64)]))[0])
                shingle.append(g[j])
                place.append(j)
                n.append(len(h))
            yield pa.RecordBatch.from_arrays([B.as_long(np.array(shingle, np.uint64)), pa.array(place, pa.int32()), pa.array(n, pa.int32()), batch.column(0), batch.column(1)], ["shingle", "place", "n", "window", "items"])

    return windows.select("window", "items").mapInArrow(pick, "shingle long, place int, n int, window binary, items array<string>")


def places(docs: DataFrame, bloom: np.ndarray, size: int = WINDOW) -> DataFrame:
    """A row for each document (row, doc_id, n_words) and a row for each place where a shingle may be a prefix.

    A place has the shingle, its word's number ``at``, and ``near``: the words from ``size`` - 1
    before it on to as many behind, joined by spaces; ``before`` tells how many stand before it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    names = ["row", "doc_id", "n_words", "shingle", "at", "before", "near"]

    def scan(batches):
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(2)):
                data = B.LOWER[data]
                starts, stops, row = B.word_spans(data, offsets, B.ALNUM)
                first = np.searchsorted(row, np.arange(b - a + 1))
                none = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first)), *(none.cast(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)
                keys = batch.column(0).slice(a, b - a)
                for _, g, own in _grams(B.span_hashes(data, starts, stops), row):
                    p = np.flatnonzero(bloom_has(sent.value, g) & own)
                    for q in (p[i : i + 50_000] for i in range(0, len(p), 50_000)):
                        lo, hi = np.maximum(q - size + 1, first[row[q]]), np.minimum(q + size, first[row[q] + 1])
                        near = [b" ".join(data[s:e].tobytes() for s, e in zip(starts[i:j], stops[i:j], strict=True)) for i, j in zip(lo, hi, strict=True)]
                        none = pa.nulls(len(q), pa.int64())
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[q])), none, none, B.as_long(g[q]), pa.array((q - first[row[q]]).astype(np.int32)), pa.array((q - lo).astype(np.int32)), pa.array(near, pa.binary())], names)

    kinds = "row binary, doc_id long, n_words long, shingle long, at int, before int, near binary"
    return docs.select(key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, kinds)


def hits(found: DataFrame, known: DataFrame) -> DataFrame:
    """(row, start, stop, items): the verified occurrences of windows; a common shingle is dealt out by row."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    each = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = found.withColumn("salt", salt).join(each, ["shingle", "salt"])
    start = F.col("before") - F.col("place")
    own = F.slice(F.split(F.col("near").cast("string"), " "), F.greatest(start, F.lit(0)) + 1, F.col("n"))
    same = F.array_join(own, " ").cast("binary") == F.col("window")
    at = F.col("at") - F.col("place")
    return met.where((start >= 0) & same).select("row", at.alias("start"), (at + F.col("n")).alias("stop"), "items")


def _united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def by_document(occurrences: DataFrame) -> DataFrame:
    """(row, n_hit, items, starts, stops) of each document with hits; its lists are no longer than its text."""

    def unite(batches):
        for batch in batches:
            d = batch.to_pydict()
            spans = [_united((x["start"], x["stop"]) for x in own) for own in d["spans"]]
            columns = [pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([sorted(x) for x in d["items"]], pa.list_(pa.string()))]
            columns += [pa.array([[y[k] for y in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n_hit", "items", "starts", "stops"])

    spans = occurrences.groupBy("row", "start", "stop").agg(F.first("items").alias("items"))
    each = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return each.mapInArrow(unite, "row binary, n_hit long, items array<string>, starts array<int>, stops array<int>")


def _found(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the documents, and what is found in those with hits."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = item_windows(benchmark, size)
    known = scratch.save(prefixes(windows, corpus_sketch(docs)), "windows")
    bloom = bloom_filter(known.select("shingle"), bloom_sized(known.count()))
    scanned = scratch.save(places(docs, bloom, size), "places")
    found = scratch.save(by_document(hits(scanned.where("shingle is not null").select("row", "shingle", "at", "before", "near"), known)), "found")
    return scanned.where("shingle is null").select("row", "doc_id", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, starts and stops (ranges of words that are hit) of every row of ``docs``."""
    rows, found = _found(docs, benchmark, size)
    out = rows.join(bounded(found), "row", "left")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none("string")).alias("items"), F.coalesce("starts", none("int")).alias("starts"), F.coalesce("stops", none("int")).alias("stops"))


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    rows, found = _found(docs, benchmark, size)
    gone = rows.join(bounded(found), "row").where("20 * n_hit >= n_words").select(F.col("row").alias(free_name(docs, "_row"))).distinct()
    own = free_name(docs, "_own")
    return docs.withColumn(own, key()).join(bounded(gone), F.col(own) == gone[gone.columns[0]], "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for name, text in items:
        own = words(text)
        for j in range(max(1, len(own) - size + 1) if own and name is not None else 0):
            windows[tuple(own[j : j + size])].add(str(name))
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(own) - n + 1):
                if found := windows.get(tuple(own[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out.append((doc_id, len(own), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS j FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN sizes ON len(w) >= n)),
met AS (SELECT rid, places.n, p, item FROM places JOIN windows USING (n, t)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM met)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
