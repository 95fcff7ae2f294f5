"""Counters and filters of fixed size over all hashes that the tasks meet, merged by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COUNTERS = 1 << 22
_PARTS = 64
#: Counters of words, where a sketch has them: their parts come after the others.
WORD_COUNTERS = 1 << 18
WORDS_FROM = _PARTS
_HASHES = 4
#: Hashes that a task holds before it counts them.
_HELD = 1 << 19
#: Bits of a Bloom filter for each value, and at most.
BLOOM_BITS, MOST_BITS = 16, 1 << 30


class Counts:
    """A task's counters: a value counts at its hash modulo their number."""

    def __init__(self, size: int = COUNTERS):
        self.counts, self.held, self.n = np.zeros(size, np.int32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.n += len(h)
        if self.n > _HELD:
            self._count()

    def _count(self) -> None:
        for h in self.held:
            for a in range(0, len(h), _HELD):
                np.add.at(self.counts, (h[a : a + _HELD] % np.uint64(len(self.counts))).view(np.int64), np.int32(1))
        self.held, self.n = [], 0

    def parts(self, first: int = 0) -> tuple[pa.Array, pa.Array]:
        """(part, compressed counters) of the parts that are not all zero, numbered from ``first`` on."""
        self._count()
        own = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(self.counts.reshape(-1, COUNTERS // _PARTS), first) if c.any()]
        return pa.array([k for k, _ in own], pa.int32()), pa.array([c for _, c in own], pa.binary())


def sent_sketch(hashes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's counters of all the hashes, as (part, counts) rows."""
    counts = Counts()
    for h in hashes:
        counts.add(h)
    yield pa.RecordBatch.from_arrays(list(counts.parts()), ["part", "counts"])


class Sketch:
    """The counters over all tasks, COUNTERS numbers however large the corpus, packed by parts; a task's process unpacks them once."""

    def __init__(self, parts: dict[int, bytes]):
        self.parts, self._counts, self._words = parts, None, None

    def _unpacked(self, first: int, size: int) -> np.ndarray:
        out = np.zeros((size // (COUNTERS // _PARTS), COUNTERS // _PARTS), np.int32)
        for k in range(len(out)):
            if packed := self.parts.get(first + k):
                out[k] = np.frombuffer(zlib.decompress(packed), np.int32)
        return out.ravel()

    def counts(self) -> np.ndarray:
        if self._counts is None:
            self._counts = self._unpacked(0, COUNTERS)
        return self._counts

    def words(self) -> np.ndarray:
        """The counters of words."""
        if self._words is None:
            self._words = self._unpacked(WORDS_FROM, WORD_COUNTERS)
        return self._words


def merged(rows: DataFrame) -> Sketch:
    """The sketch from the rows of all tasks; the driver passes it on packed."""

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        most = np.iinfo(np.int32).max
        packed = [zlib.compress(np.minimum(s, most).astype(np.int32).tobytes(), 1) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    return Sketch({r["part"]: bytes(r["counts"]) for r in rows.select("part", "counts").repartition("part").mapInArrow(merge, "part int, counts binary").collect()})


def bloom_sized(n: int) -> int:
    """Bits of the filter for n values: a power of two."""
    return min(MOST_BITS, 1 << max(16, (BLOOM_BITS * max(1, n) - 1).bit_length()))


def _bits(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of each hash in a filter of ``size`` bits."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(_HASHES):
        yield ((h + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(size - 1)


def bloom_filter(values: DataFrame, size: int) -> np.ndarray:
    """The filter, 8 bits a byte, of a column of long hashes; its parts are put together by Spark."""
    part_bits = max(1 << 13, size // 128)

    def own(batches):
        bits = np.zeros(size, bool) if size <= 1 << 26 else None
        held = []
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in _bits(h, size):
                if bits is not None:
                    bits[at.astype(np.int64)] = True
                else:
                    held.append(np.unique(at))
        if bits is None:
            at = np.unique(np.concatenate([np.zeros(0, np.uint64), *held])).astype(np.int64)
        else:
            at = np.flatnonzero(bits)
        part = at // part_bits
        for p in np.unique(part):
            one = np.zeros(part_bits, bool)
            one[at[part == p] - p * part_bits] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(np.packbits(one, bitorder="little").tobytes(), 1)], pa.binary())], ["part", "bits"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, np.uint8(0)) | np.frombuffer(zlib.decompress(bits), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((size // part_bits, part_bits // 8), np.uint8)
    for r in values.mapInArrow(own, "part int, bits binary").repartition("part").mapInArrow(merge, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def bloom_has(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    found = np.ones(len(h), bool)
    for at in _bits(h, 8 * len(bloom)):
        own = np.flatnonzero(found)
        place = at[own].astype(np.int64)
        found[own] = (bloom[place >> 3] >> (place & 7).astype(np.uint8)) & 1
    return found
