"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. A line's features are shares of byte classes and of
pairs of them, word and line shape, and repetition, of the line itself and of the lines
before and after it; a 2 x 2 transition matrix ties neighbouring labels. Forward-backward
marginals of "good", weighted by the bytes of the lines, make the document's score.

The field is fitted by full-batch gradient steps on a bounded sample of labelled rows: for
each label about ``per_label`` documents of at most ``most_bytes`` bytes and ``most_lines``
lines, those with the smallest hash of doc_id. Labels are known of documents only. A field
without transitions is fitted first, every line bearing its document's label; a line on
which it is sure of the other label then bears that, so that both kinds of lines meet in
a document and the transitions have something to learn. The likelihood is one: the mean over
documents of a document's log-likelihood divided by its lines.

Scoring takes every whole text. Lines are turned into features in groups of bounded size
and reduced at once to three numbers a line (its share in its own logit and in its
neighbours'), and a long document's chain is cut into segments that are passed side by side,
so memory and time stay in proportion to the lines. A null or empty text is one empty line.
If nothing was learned, or only one label, all scores are 0.5, or that label. Equal rows
each give their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .rows import bounded_sample

PER_LABEL = 1500
MOST_BYTES = 20_000
MOST_LINES = 300
THRESHOLD = 0.7
#: A line bears the other label than its document's if the first field gives its own a lower probability.
SURE = 0.05
#: Lines and bytes of a group whose features are held at once.
GROUP_LINES, GROUP_BYTES = 4096, 1 << 18

_KINDS = 9
_KIND = np.zeros(256, np.uint8)  # control
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x20, 0x09]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"-"]] = 5
_KIND[[ord(c) for c in "()[]{}<>/\\|"]] = 6
_KIND[[ord(c) for c in "#$%&*+=@^_`~"]] = 7
_KIND[0x80:] = 8
LOCAL = _KINDS + _KINDS * _KINDS + 11
FEATURES = 3 * LOCAL + 1
_BREAK = np.ones(256, bool)
_BREAK[0x0A] = False


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line that holds a byte; a row without any gives one empty line."""
    starts, stops, row = B.word_spans(data, offsets, _BREAK)
    bare = np.setdiff1d(np.arange(len(offsets) - 1), row)
    starts, stops, row = np.concatenate([starts, offsets[bare]]), np.concatenate([stops, offsets[bare]]), np.concatenate([row, bare])
    order = np.lexsort((starts, row))
    return starts[order], stops[order], row[order]


def _byte_shares(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Counts of the byte classes of each line and of their pairs."""
    n = len(starts)
    out = np.zeros((n, _KINDS + _KINDS**2))
    for i, j in B.span_groups(starts, stops, GROUP_BYTES):
        for a in range(int(starts[i]), max(int(stops[j - 1]), int(starts[i]) + 1), GROUP_BYTES):  # a long line takes several turns
            b = min(int(stops[j - 1]), a + GROUP_BYTES)
            kind = _KIND[data[a : min(b + 1, int(stops[j - 1]))]].astype(np.int64)
            line = np.searchsorted(starts[i:j], np.arange(a, a + len(kind)), "right") - 1
            inside = np.arange(a, a + len(kind)) < stops[i:j][line]
            own = inside[: b - a]
            out[i:j, :_KINDS] += np.bincount(line[: b - a][own] * _KINDS + kind[: b - a][own], minlength=(j - i) * _KINDS).reshape(j - i, -1)
            both = inside[:-1] & inside[1:] & (line[:-1] == line[1:])
            pair = line[:-1] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:]
            out[i:j, _KINDS:] += np.bincount(pair[both], minlength=(j - i) * _KINDS**2).reshape(j - i, -1)
    return out


def line_features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, old: np.ndarray) -> np.ndarray:
    """LOCAL features of each of the lines, which come in order; ``old`` tells those that stood in their document before."""
    n, size = len(starts), np.maximum(stops - starts, 1)
    out = np.zeros((n, LOCAL), np.float32)
    out[:, : _KINDS + _KINDS**2] = _byte_shares(data, starts, stops) / size[:, None]
    more = out[:, _KINDS + _KINDS**2 :]
    more[:, 0] = np.log1p(size) / 8
    if n:
        a = int(starts[0])
        ws, we, _ = B.word_spans(data[a : int(stops[-1])], np.append(starts, stops[-1]) - a, B.SPACED)  # texts follow each other without a break
        own = np.searchsorted(starts, ws + a, "right") - 1
        h = B.span_hashes(data[a : int(stops[-1])], ws, we)
        words = np.bincount(own, minlength=n)
        many = np.maximum(words, 1)
        more[:, 1] = np.log1p(words) / 6
        length = we - ws
        more[:, 2] = np.minimum(np.bincount(own, length, n) / many, 40) / 10
        more[:, 3] = np.bincount(own, length <= 2, n) / many
        more[:, 4] = np.bincount(own, length >= 14, n) / many
        for j, lag in enumerate((1, 2, 3)):
            if len(h) > lag:
                again = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])
                more[:, 5 + j] = np.bincount(own[lag:], again, n) / many
        if len(h):
            order = np.lexsort((h, own))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
            more[:, 8] = np.bincount(own[order], new, n) / many
    more[:, 9] = old
    more[:, 10] = stops == starts
    return out


def line_groups(data: np.ndarray, offsets: np.ndarray):
    """The lines of a block of texts: bytes and row of each, and an iterator of (i, j, features of the lines [i, j))."""
    starts, stops, row = lines(data, offsets)
    whole = B.span_hashes(data, starts, stops)
    old = np.zeros(len(starts), bool)
    if len(starts):
        order = np.lexsort((whole, row))
        old[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (row[order][1:] == row[order][:-1])
    groups = ((i, j, line_features(data, starts[i:j], stops[i:j], old[i:j])) for i, j in B.span_groups(starts, stops, GROUP_BYTES, GROUP_LINES))
    return np.maximum(stops - starts, 1), row, groups


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The features of each line beside those of the line before and after it in its document."""
    out = np.zeros((len(x), FEATURES), np.float32)
    out[:, :LOCAL] = x
    out[:, -1] = 1
    if len(x) > 1:
        same = row[1:] == row[:-1]
        out[1:, LOCAL : 2 * LOCAL][same] = x[:-1][same]
        out[:-1, 2 * LOCAL : 3 * LOCAL][same] = x[1:][same]
    return out


class Chain:
    """Forward-backward over many documents at once.

    A document's lines are cut into segments of at most ``most`` lines (by default about the
    root of the longest document's). All segments of all documents are passed side by side;
    what enters a segment from either end comes from products of the 2 x 2 steps of the
    segments beyond it.
    """

    def __init__(self, row: np.ndarray, most: int | None = None):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(row)))
        self.same = np.flatnonzero(row[1:] == row[:-1])
        self.weight = np.repeat(1.0 / np.maximum(size, 1), size) / max(1, len(size))  # every document counts alike
        most = most or max(64, int(np.sqrt(size.max())) + 1 if len(size) else 1)
        parts = -(-size // most)
        self.head = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)  # first segment of each document
        self.place = np.arange(parts.sum()) - np.repeat(self.head, parts)  # which segment of its document
        self.start = np.repeat(first, parts) + most * self.place
        self.size = np.minimum(np.repeat(size, parts) - most * self.place, most)
        self.parts = parts
        order = np.argsort(-self.size, kind="stable")
        self.live = [order[: int(np.searchsorted(-self.size[order], -t, "left"))] for t in range(int(self.size.max()) if len(order) else 0)]

    def _ends(self, good: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What enters each segment from the left (before the step into it) and from the right."""
        into, back = np.full((len(self.start), 2), 0.5), np.full((len(self.start), 2), 0.5)
        if len(self.parts) and self.parts.max() > 1:
            product = np.broadcast_to(np.eye(2), (len(self.start), 2, 2)).copy()
            for t, own in enumerate(self.live):
                p = product[own]
                if t or (self.place[own] > 0).any():
                    p = np.where(((t > 0) | (self.place[own] > 0))[:, None, None], p @ step, p)
                q = good[self.start[own] + t]
                p = p * np.stack([1 - q, q], 1)[:, None, :]
                product[own] = p / p.sum((1, 2), keepdims=True)
            docs = np.argsort(-self.parts, kind="stable")
            for k in range(1, int(self.parts.max())):
                own = docs[: int(np.searchsorted(-self.parts[docs], -k, "left"))]
                v = np.einsum("ni,nij->nj", into[self.head[own] + k - 1], product[self.head[own] + k - 1])
                into[self.head[own] + k] = v / v.sum(1, keepdims=True)
            for k in range(int(self.parts.max()) - 1, 0, -1):
                own = docs[: int(np.searchsorted(-self.parts[docs], -k, "left"))]
                v = np.einsum("nij,nj->ni", product[self.head[own] + k], back[self.head[own] + k])
                back[self.head[own] + k - 1] = v / v.sum(1, keepdims=True)
        return into, back

    def marginals(self, logit: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """P(good) of every line; with weights of the lines, the weighted expected number of each transition."""
        good = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))  # emissions (1 - good, good), up to a factor
        a, b = np.zeros_like(good), np.full_like(good, 0.5)  # the share of "good" in either message
        step = np.exp(move - move.max())
        into, back = self._ends(good, step)
        for t, own in enumerate(self.live):
            at = self.start[own] + t
            if t:
                old = a[at - 1]
                u, v = (1 - old) * step[0, 0] + old * step[1, 0], (1 - old) * step[0, 1] + old * step[1, 1]
            else:
                m = np.where((self.place[own] > 0)[:, None], into[own] @ step, 1.0)
                u, v = m[:, 0], m[:, 1]
            v = good[at] * v
            a[at] = v / ((1 - good[at]) * u + v)
        b[self.start + self.size - 1] = back[:, 1] / back.sum(1) if len(back) else back[:, 1]
        for t in range(len(self.live) - 1, 0, -1):
            at = self.start[self.live[t]] + t
            u, v = (1 - good[at]) * (1 - b[at]), good[at] * b[at]
            x, y = step[0, 0] * u + step[0, 1] * v, step[1, 0] * u + step[1, 1] * v
            b[at - 1] = y / (x + y)
        both = None
        if weight is not None:
            i, j = self.same, self.same + 1
            left, right = np.stack([1 - a[i], a[i]], 1), np.stack([(1 - good[j]) * (1 - b[j]), good[j] * b[j]], 1)
            joint = left[:, :, None] * step * right[:, None, :]
            both = (joint * (weight[i] / joint.sum((1, 2)))[:, None, None]).sum(0)
        p = a * b
        return p / np.maximum(p + (1 - a) * (1 - b), 1e-30), both


def gradient(z: np.ndarray, chain: Chain, good: np.ndarray, w: np.ndarray, move: np.ndarray, tied: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean over documents of -log P(labels | lines) / lines, by the weights of the features and by the transitions; untied, lines stand alone."""
    weight = chain.weight
    if not tied:
        return z.T @ ((1 / (1 + np.exp(-np.clip(z @ w, -60, 60))) - good) * weight), np.zeros((2, 2))
    p, both = chain.marginals(z @ w, move, weight)
    i = chain.same
    seen = np.bincount((2 * good[i] + good[i + 1]).astype(int), weight[i], 4).reshape(2, 2)
    return z.T @ ((p - good) * weight), both - seen


class Field:
    """Weights of the lines' features and of the transitions."""

    def __init__(self, x: np.ndarray, row: np.ndarray, good: np.ndarray, *, rounds: int = 250, tied_rounds: int = 80, rate: float = 0.05, penalty: float = 3e-4):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.scale[-1] = 0, 1
        z = ((x - self.mean) / self.scale).astype(np.float64)
        chain, self.w, self.move = Chain(row), np.zeros(z.shape[1]), np.zeros((2, 2))
        self._descend(z, chain, good, rounds, rate, penalty, False)
        alone = 1 / (1 + np.exp(-np.clip(z @ self.w, -60, 60)))
        lines = np.where(good > 0, alone >= SURE, alone > 1 - SURE).astype(float)
        self._descend(z, chain, lines, tied_rounds, rate, penalty, True)

    def _descend(self, z, chain, good, rounds, rate, penalty, tied):
        pace = [np.zeros_like(v) for v in (self.w, self.w, self.move, self.move)]
        for r in range(1, rounds + 1):
            gw, gm = gradient(z, chain, good, self.w, self.move, tied)
            for k, v, g in ((0, self.w, gw + penalty * self.w), (2, self.move, gm + 10 * penalty * self.move)):
                pace[k] = 0.9 * pace[k] + 0.1 * g
                pace[k + 1] = 0.99 * pace[k + 1] + 0.01 * g * g
                v -= rate * (pace[k] / (1 - 0.9**r)) / (np.sqrt(pace[k + 1] / (1 - 0.99**r)) + 1e-8)

    def parts(self) -> tuple[np.ndarray, float]:
        """The weights of a line's own features in its logit, in that of the line after it and in that of the line before it; the rest of a logit."""
        w = self.w / self.scale
        return w[:-1].reshape(3, LOCAL).T.astype(np.float32), float(self.w[-1] - (self.mean[:-1] * w[:-1]).sum())

    def line_scores(self, n: int, row: np.ndarray, groups) -> np.ndarray:
        """P(good) of each of n lines from the groups of their features."""
        weights, rest = self.parts()
        u = np.zeros((n, 3), np.float32)
        for i, j, x in groups:
            u[i:j] = x @ weights
        logit = u[:, 0] + np.float32(rest)
        if n > 1:
            same = row[1:] == row[:-1]
            logit[1:][same] += u[:-1, 1][same]
            logit[:-1][same] += u[1:, 2][same]
        return Chain(row).marginals(logit, self.move.astype(np.float32))[0]


def judged(column: pa.Array, model: Field | float):
    """(first row, rows, scores, P(good) of the lines, their rows) of each block of a text column."""
    for a, b, data, offsets in B.texts(column, GROUP_BYTES):
        size, row, groups = line_groups(data, offsets)
        p = np.full(len(row), model) if isinstance(model, float) else model.line_scores(len(row), row, groups)
        yield a, b - a, np.clip(np.bincount(row, p * size, b - a) / np.bincount(row, size, b - a), 0, 1), p, row


def sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> DataFrame:
    """The bounded sample: text and label, the same at every run."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = bounded_sample(own, "label", 2 * per_label, F.xxhash64("doc_id"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    short = docs.where((F.octet_length("text") <= most_bytes) & (breaks < most_lines)).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return bounded_sample(short, "label", per_label, F.xxhash64("doc_id", "text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES, most_lines: int = MOST_LINES) -> Field | float:
    """The field fitted on labelled rows; a plain score if there is but one label, or none."""

    def turn(batches):
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(0), GROUP_BYTES):
                _, row, groups = line_groups(data, offsets)
                x = np.concatenate([g for _, _, g in groups]).astype(np.float16)
                at = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "label"])

    rows = sample(docs, labels, label=label, per_label=per_label, most_bytes=most_bytes, most_lines=most_lines).mapInArrow(turn, "x binary, label int").collect()
    known = sorted({r["label"] for r in rows})
    if len(known) < 2:
        return float(known[0]) if known else 0.5
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = [np.frombuffer(bytes(r["x"]), np.float16).reshape(-1, LOCAL).astype(np.float32) for r in rows]
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    good = np.repeat([float(r["label"] > 0) for r in rows], [len(v) for v in x])
    return Field(with_neighbours(np.concatenate(x), row), row, good)


def score(docs: DataFrame, model: Field | float, *, lines_too: bool = False) -> DataFrame:
    """doc_id and score of every whole text; ``lines_too`` adds P(good) of each line."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for a, n, total, p, row in judged(batch.column(1), sent.value):
                columns = [batch.column(0).slice(a, n), pa.array(total)]
                if lines_too:
                    at = np.searchsorted(row, np.arange(n + 1))
                    columns.append(pa.array([p[at[i] : at[i + 1]].astype(np.float64) for i in range(n)], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "lines"][: len(columns)])

    kinds = "doc_id long, score double" + ", lines array<double>" * lines_too
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, kinds)


def keep(docs: DataFrame, model: Field | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def pick(batches):
        for batch in batches:
            good = [np.zeros(0, bool), *(total >= threshold for _, _, total, _, _ in judged(batch.column(at), sent.value))]
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(pick, docs.schema)
