"""Vectorised views of Arrow text columns: bytes, words, word hashes and shingle hashes.

A batch is walked in blocks of a few MB, so that the numpy arrays beside a block stay
small whatever the batch holds. One text is never divided between blocks; what takes many
bytes for each byte of text is worked out piece by piece within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Words end at white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, small letters and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_TABLE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` rows [a, b) and ``limit`` bytes, or a single longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        yield a, b
        a = b


def texts(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block of a text column."""
    data, offsets = flat(column)
    for a, b in blocks(offsets, limit, rows):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``inside`` bytes within a row."""
    w = inside[data]
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = w[edges]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = w[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def span_groups(starts: np.ndarray, stops: np.ndarray, limit: int, most: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most ``most`` ordered, disjoint spans that reach over ``limit`` bytes, or a single longer span."""
    i, n = 0, len(starts)
    while i < n:
        j = min(i + most, max(i + 1, int(np.searchsorted(stops, starts[i] + limit, "right"))))
        yield i, j
        i = j


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("up", len(data) + 1)[: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each of the ordered, disjoint spans; equal for equal bytes wherever they stand."""
    h = np.zeros(len(starts), np.uint64)
    for i, j in span_groups(starts, stops, PIECE_BYTES):
        a, b = int(starts[i]), int(stops[j - 1])
        if b - a > PIECE_BYTES:  # one long span: the sum of its pieces, each at its distance
            whole = sum(int(_sums(data[p : min(b, p + PIECE_BYTES)])[-1]) * pow(_BASE, p - a, 1 << 64) for p in range(a, b, PIECE_BYTES))
            h[i] = whole & _MASK
        else:
            sums = _sums(data[a:b])
            h[i:j] = (sums[stops[i:j] - a] - sums[starts[i:j] - a]) * _power("down", b - a + 1)[starts[i:j] - a]
    return mix(h + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] + np.uint64(k)
    for j in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : j + n])
    return mix(out)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence, as ``chained`` gives it for k = its length."""
    return int(chained(h, len(h))[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of each row the place of its first one; the last place is their number."""
    starts, stops, row = word_spans(data, offsets, inside)
    return span_hashes(data, starts, stops), np.searchsorted(row, np.arange(len(offsets)))


def sets_of(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row of words; of a shorter row, its whole sequence."""
    grams = chained(h, k)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(chained(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def summed_sets(h: np.ndarray, at: np.ndarray, k: int, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of ``sets_of``, each with the sum of the whole-numbered weights of the words of every shingle."""
    grams = chained(h, k)
    sums = np.concatenate([[0], np.cumsum(weights)])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s, first = np.unique(grams[a : b - k + 1], return_index=True)
            yield s, sums[a + k + first] - sums[a + first]
        elif b > a:
            yield chained(h[a:b], b - a), sums[[b]] - sums[[a]]
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; of a shorter row, its whole sequence."""
    return sets_of(*word_hashes(data, offsets, inside), k)


def as_long(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark has."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
