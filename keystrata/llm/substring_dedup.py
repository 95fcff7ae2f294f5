"""Suffix-array deduplication of repeated byte strings, by external induced sorting.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. As in
induced sorting, only sampled suffixes are sorted and the others follow from them:

* Recursion in a text. A suffix is kept while it is least among its neighbours in suffix
  order, over a distance that doubles in each round until it reaches ``radius``; suffixes are
  compared by their first eight bytes. Whether a suffix stays depends on 32 bytes around it
  only, so both copies of a string keep the same ones.
* Suffix tuples. Every ``length``-byte string belongs to the first kept suffix in its inner
  part (or to its own middle, if there is none). The strings of one kept suffix that start
  within ``widths[0]`` bytes are one tuple: the hash of the bytes that all of them share
  (their common prefix about the suffix), and the hash of all their bytes.
* Disk-backed priority queues. Tuples are dealt out by common part and sorted within the
  task by Spark's external sorter, which merges spilled runs through a priority queue; a
  scan then holds one tuple at a time. Equal tuples that occur twice prove all their strings
  repeated. A common part with different tuples is settled by induction: one tuple of each
  kind goes down to the next width, until each tuple is a single string.

Null and empty texts, and all shorter than ``length``, lose nothing. Equal rows are copies
of each other, so both go if long enough. The key of a row is a hash of its doc_id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .rows import bounded
from .scratch import Scratch

LENGTH = 200
RADIUS = 24
WIDTHS = (73, 9, 1)

TUPLES = "common long, whole long, key long, place long, weight int"
FOUND = "key long, place long, weight int, state int"
REPEATED, OPEN = 1, 2
#: Weight of a member whose tuple is known to be repeated; 1 is a single tuple, 2 stands for several.
PROVED = 3


def kept_suffixes(data: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places whose suffix is least within ``radius`` on either side; ties are all kept. Worked out piece by piece."""
    n, found = len(data), [np.zeros(0, np.int64)]
    for a in range(0, n, B.PIECE_BYTES):
        b, low = min(n, a + B.PIECE_BYTES), max(0, a - radius)
        high = min(n, b + radius)
        k = np.concatenate([data[low : min(n, high + 8)], np.zeros(8, np.uint8)]).astype(np.uint64)
        for bits in (8, 16, 32):
            k = (k[: -(bits // 8)] << np.uint64(bits)) | k[bits // 8 :]
        k = k[: high - low]
        edge = np.full(radius, ~np.uint64(0))
        least, reach = np.concatenate([edge, k, edge]), 1
        while 2 * reach <= 2 * radius + 1:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if rest := 2 * radius + 1 - reach:
            least = np.minimum(least[:-rest], least[rest:])
        at = np.flatnonzero(k == least) + low
        found.append(at[(at >= a) & (at < b)])
    return np.concatenate(found)


def _packed(base, lo, hi):
    """Start of the tuple's strings if none is cut off at an end of the text, first and last start."""
    return (lo << 20) | ((lo - base) << 10) | (hi - lo)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 20
    return lo - ((place >> 10) & 1023), lo, lo + (place & 1023)


def first_tuples(data: np.ndarray, length: int = LENGTH, radius: int = RADIUS, width: int = WIDTHS[0]) -> tuple[np.ndarray, ...]:
    """(base, lo, hi, width, tag) of the tuples of a text; each start of a string is in just one."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    near, far = radius, length - radius - 8
    x = kept_suffixes(data, radius)
    x = x[(x >= near) & (x <= n - radius - 8)]
    before = np.concatenate([[-1], x[:-1] - near]) if len(x) else none
    parts = []
    for tag, d in enumerate(range(near, far + 1, width)):
        w = min(width, far + 1 - d)
        base = x - d - w + 1
        lo, hi = np.maximum(np.maximum(base, before + 1), 0), np.minimum(x - d, n - length)
        own = lo <= hi
        parts.append((base[own], lo[own], hi[own], np.full(own.sum(), w), np.full(own.sum(), tag)))
    after = np.concatenate([[-1], x - near])  # starts up to here belong to kept suffixes
    until = np.concatenate([x - far, [n - length + 1]])
    gaps = [np.arange(a + 1, min(b, n - length + 1)) for a, b in zip(after, until, strict=True) if b > a + 1]
    loose = np.concatenate([none, *gaps])
    parts.append((loose, loose, loose, np.ones(len(loose), np.int64), np.full(len(loose), 99)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _hashed(text: bytes, base, lo, hi, width, tag, length: int) -> tuple[list[int], list[int]]:
    from xxhash import xxh3_64_intdigest as digest

    common, whole = [], []
    for b, s, e, w, t in zip(base.tolist(), lo.tolist(), hi.tolist(), width.tolist(), tag.tolist(), strict=True):
        common.append(digest(text[b + w - 1 : b + length], t * 1024 + w) - (1 << 63))
        whole.append(digest(text[s : e + length], ((s - b) * 1024 + e - b) * 1024 + w) - (1 << 63))
    return common, whole


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.cast("binary").alias("text"))


def sorted_tuples(docs: DataFrame, length: int = LENGTH, radius: int = RADIUS, width: int = WIDTHS[0]) -> DataFrame:
    """The suffix tuples of all texts of ``keyed`` rows."""

    def scan(batches):
        for batch in batches:
            out = [[], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, lo, hi, w, tag = first_tuples(np.frombuffer(text, np.uint8), length, radius, width)
                if len(lo):
                    common, whole = _hashed(text, base, lo, hi, w, tag, length)
                    out[0] += common
                    out[1] += whole
                    out[2].append(np.full(len(lo), key, np.int64))
                    out[3].append(_packed(base, lo, hi))
                if len(out[0]) > 100_000:
                    yield _rows(out)
                    out = [[], [], [], []]
            yield _rows(out)

    return docs.select("key", "text").where(F.octet_length("text") >= length).mapInArrow(scan, TUPLES)


def _rows(out, weight=None) -> pa.RecordBatch:
    """The tuples of a run of texts, those that are equal combined.

    Equal tuples within the run are proved repeated here: one of them stays as the tuple's
    representative, and the members go by a place of their own with weight PROVED, so that
    a very common string does not meet in one task member by member.
    """
    join = lambda x, kind=np.int64: np.concatenate([np.zeros(0, kind), *x])
    common, whole, key, place = np.array(out[0], np.int64), np.array(out[1], np.int64), join(out[2]), join(out[3])
    weight = np.ones(len(common), np.int32) if weight is None else join(weight, np.int32)
    order = np.lexsort((whole, common))
    common, whole, key, place, weight = (c[order] for c in (common, whole, key, place, weight))
    first = np.ones(len(common), bool)
    first[1:] = (common[1:] != common[:-1]) | (whole[1:] != whole[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(first)))
    several = np.repeat(size > 1, size)
    members = several & (weight < 2)
    own = B.mix((key ^ (place << 1)).view(np.uint64)).view(np.int64)
    kept = first | ~several
    weights = np.concatenate([np.where(several, 2, weight)[kept], np.full(int(members.sum()), PROVED)]).astype(np.int32)
    columns = [np.concatenate([c[kept], m[members]]) for c, m in ((common, own), (whole, whole), (key, key), (place, place))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(weights)], ["common", "whole", "key", "place", "weight"])


def settle(tuples: DataFrame) -> DataFrame:
    """REPEATED for each member of a tuple that occurs twice or more; OPEN for one of each tuple whose common part has others."""

    def scan(batches):
        held, mixed = None, False  # one row of the last tuple; whether its common part has had others
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([[h], r]) for h, r in zip(held, rows, strict=True)]
            common, whole, key, place, weight = rows
            n = len(common)
            group = np.concatenate([[True], common[1:] != common[:-1]])
            run = np.concatenate([[True], whole[1:] != whole[:-1]]) | group
            starts = np.flatnonzero(run)
            runs = np.cumsum(run) - 1
            total = np.add.reduceat(weight, starts)
            groups = (np.cumsum(group) - 1)[starts]
            several = np.bincount(groups) > 1
            several[0] |= mixed
            proved = ((total[runs] >= 2) & (weight < 2)) | (weight == PROVED)
            last = len(starts) - 1
            opened = starts[:last][several[groups[:last]]]
            mixed = bool(several[groups[last]])
            held = tuple(c[starts[last]] for c in (common, whole, key, place)) + (np.int32(min(2, total[last])),)
            at = np.concatenate([np.flatnonzero(proved), opened])
            states = np.repeat([REPEATED, OPEN], [int(proved.sum()), len(opened)]).astype(np.int32)
            weights = np.minimum(total[runs[at]], 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(place[at]), pa.array(weights), pa.array(states)], ["key", "place", "weight", "state"])
        if held is not None and mixed:
            yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int64()), pa.array([held[4]], pa.int32()), pa.array([OPEN], pa.int32())], ["key", "place", "weight", "state"])

    return tuples.repartition("common").sortWithinPartitions("common", "whole", "key", "place").mapInArrow(scan, FOUND)


def induced_tuples(docs: DataFrame, open_: DataFrame, width: int, length: int = LENGTH) -> DataFrame:
    """The tuples of ``open_`` divided into ones of at most ``width`` strings each."""
    asked = open_.groupBy("key").agg(F.collect_list("place").alias("places"), F.collect_list("weight").alias("weights"))

    def scan(batches):
        for batch in batches:
            out, weights = [[], [], [], []], []
            for key, text, places, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, lo, hi = unpacked(np.array(places, np.int64))
                own = np.array(own, np.int32)
                for tag in range(-(-(int((hi - base).max()) + 1) // width)):
                    b = base + tag * width
                    s, e = np.maximum(lo, b), np.minimum(hi, b + width - 1)
                    some = s <= e
                    common, whole = _hashed(text, b[some], s[some], e[some], np.full(some.sum(), width), np.full(some.sum(), tag), length)
                    out[0] += common
                    out[1] += whole
                    out[2].append(np.full(some.sum(), key, np.int64))
                    out[3].append(_packed(b, s, e)[some])
                    weights.append(own[some])
                if len(out[0]) > 100_000:
                    yield _rows(out, weights)
                    out, weights = [[], [], [], []], []
            yield _rows(out, weights)

    texts = docs.join(bounded(asked.select("key")), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    return texts.join(asked, "key").select("key", "text", "places", "weights").mapInArrow(scan, TUPLES)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, radius: int = RADIUS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(key, starts, stops): byte ranges covered by repeated strings, by row of ``keyed``; ranges may overlap."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    spans, open_ = None, None
    for level, width in enumerate(widths):
        tuples = sorted_tuples(docs, length, radius, width) if open_ is None else induced_tuples(docs, open_, width, length)
        found = scratch.save(settle(tuples), f"level-{level}")
        own = found.where(F.col("state") == REPEATED).select("key", "place")
        spans = own if spans is None else spans.unionByName(own)
        open_ = found.where(F.col("state") == OPEN)
        if level and open_.isEmpty():
            break
    lo = F.shiftright("place", 20)
    hi = lo + F.col("place").bitwiseAND(F.lit(1023))
    return spans.select("key", F.struct(lo.alias("s"), (hi + length).alias("e")).alias("span")).groupBy("key").agg(F.collect_list("span").alias("spans"))


def deduplicate(docs: DataFrame, *, length: int = LENGTH, radius: int = RADIUS, widths: tuple[int, ...] = WIDTHS, kept_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; ``kept_too`` adds the remaining bytes."""
    from hashlib import sha256

    docs = keyed(docs)
    spans = Scratch(docs.sparkSession, "substring-dedup").save(repeated_spans(docs, length=length, radius=radius, widths=widths), "spans")
    keys = bounded(spans.select("key"))
    # Texts that lose nothing are not shuffled to learn it.
    whole = docs.join(keys, "key", "left_anti").select("doc_id", "text", *(F.lit(None).cast("array<bigint>").alias(c) for c in "se"))
    joined = docs.join(keys, "key", "left_semi").join(spans, "key").select("doc_id", "text", "spans.s", "spans.e").unionByName(whole)

    def cut(batches):
        for batch in batches:
            rows = []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n, parts, at, removed, runs = len(text), [], 0, 0, 0
                for s, e in sorted(set(zip(starts, stops, strict=True))) if starts else ():
                    if s > at or not runs:
                        parts.append(text[at:s])
                        runs += 1
                        removed += e - s
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                kept = b"".join([*parts, text[at:]])
                rows.append((n, removed, runs, sha256(kept).hexdigest(), kept if kept_too else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            both = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(both[: 5 + kept_too], names[: 5 + kept_too])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_too)


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract by plain loops, for tests."""
    from collections import Counter
    from hashlib import sha256

    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]]))[: len(t)].sum()) if len(t) else 0
        out.append((doc_id, len(t), int(gone.sum()), runs, sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return out


_POSITIONS = "(SELECT rid, unnest(range(1, octet_length(b) - {n} + 2)) AS p, b FROM d WHERE octet_length(b) >= {n})"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, p, md5(array_slice(b, p, p + {LENGTH - 1})) AS h FROM {_POSITIONS.format(n=LENGTH)}),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
marked AS (SELECT rid, p, CASE WHEN p > coalesce(max(p) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {LENGTH}, 0) THEN 1 ELSE 0 END AS new FROM r),
runs AS (SELECT rid, min(p) AS s, max(p) + {LENGTH} AS e FROM (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM marked) GROUP BY rid, run),
gone AS (SELECT rid, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY rid),
parts AS (SELECT doc_id, b, n_removed, n_spans, list_concat([1], es) AS starts, list_concat(ss, [octet_length(b) + 1]) AS stops FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(list_reduce(list_transform(range(1, len(starts) + 1), lambda i: CASE WHEN stops[i] > starts[i] THEN array_slice(b, starts[i], stops[i] - 1) ELSE ''::BLOB END), lambda x, y: x || y)) END AS kept_sha256 FROM parts
"""
