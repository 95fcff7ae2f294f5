"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector
machines separate the languages within it. Both work on the 1-, 2- and 3-byte sequences of
the lower-cased whole text (ASCII that is no letter counts as space), hashed into fixed
tables; a feature is the square root of a sequence's share in the text, so texts of any
length are alike in scale.

Models are fitted on a bounded sample: about ``per_language`` labelled rows of a language
and MOST_ROWS in all, those with the smallest hash of doc_id and text, for the 1,000 most
frequent languages at most. Only text and label are used. The family
model is a set of one-versus-rest machines; margins become probabilities by a logistic
curve fitted on the sample. The score is the probability of the family times that of the
language within it.

``und`` with score 0 is the answer for null texts, texts without a letter, and if nothing
was learned. A language whose code is in no known family forms a family of its own. Equal
margins go to the language that sorts first. Equal rows each give their row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .rows import bounded_sample

PER_LANGUAGE = 800
#: Rows of the sample over all languages: 10 KB each are held by the driver.
MOST_ROWS = 12_000
#: Rows of a block: features take 20 KB each, however short the texts.
BLOCK_ROWS = 256
UNDETERMINED = "und"

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "br", "gd"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
}

_SIZES = (256, 1024, 4096)
_STARTS = (0, 256, 1280)
FEATURES = sum(_SIZES)

_FOLD = B.LOWER.copy()
_FOLD[:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _counts(data: np.ndarray, offsets: np.ndarray, k: int, size: int) -> np.ndarray:
    """How often each hashed sequence of k bytes stands in each text."""
    rows, n = len(offsets) - 1, len(data) - k + 1
    if n <= 0:
        return np.zeros((rows, size))
    c = _FOLD[data].astype(np.uint32)
    g = c[:n]
    for j in range(1, k):
        g = g * np.uint32(0x01000193) ^ c[j : j + n]
    at = ((g * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(size) if k > 1 else g
    if rows == 1:
        return np.bincount(at, minlength=size).reshape(1, size)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    same = row[:n] == row[k - 1 :]
    return np.bincount(row[:n][same] * size + at[same], minlength=rows * size).reshape(rows, size)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES values for each text of a block; a long text is counted piece by piece."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for k, (size, start) in enumerate(zip(_SIZES, _STARTS, strict=True), 1):
        if len(offsets) == 2:
            n = sum((_counts(data[a : a + B.PIECE_BYTES + k - 1], offsets, k, size) for a in range(0, len(data), B.PIECE_BYTES)), np.zeros((1, size)))
        else:
            n = _counts(data, offsets, k, size)
        out[:, start : start + size] = np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = np.zeros(len(offsets) - 1, bool)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        found[full] = np.logical_or.reduceat(_LETTER[data], offsets[full])
    for i in full[~found[full]]:
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def svm(x: np.ndarray, y: np.ndarray, *, c: float = 4.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine by dual coordinate descent; y is 1 or -1."""
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x.astype(np.float64) ** 2).sum(1) + 1e-9
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(a[i] - g / q[i], 0), weight[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def slope(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve from margins to probabilities, fitted with softened targets."""
    p, n = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = s - t, np.maximum(s * (1 - s), 1e-9)
        m = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"={lang}")


class Hierarchy:
    """The fitted models; ``predict`` gives language and score for feature rows."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        y, f = np.array(langs), np.array([family_of(v) for v in langs])
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        self.top = [self._fit(x, np.where(f == v, 1, -1)) for v in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for family in self.families:
            for a, b in combinations([v for v in self.langs if family_of(v) == family], 2):
                own = (y == a) | (y == b)
                self.pairs[a, b] = self._fit(x[own], np.where(y[own] == a, 1, -1))

    @staticmethod
    def _fit(x, y):
        w = svm(x, y)
        return w.astype(np.float32), *slope(x @ w, y)

    @staticmethod
    def _probability(x, model):
        w, a, b = model
        return 1 / (1 + np.exp(-np.clip(a * (x @ w) + b, -30, 30)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        n = len(x)
        top = np.stack([self._probability(x, m) for m in self.top], 1) if self.top else np.ones((n, 1))
        family = top.argmax(1)
        sure = top[np.arange(n), family] / np.maximum(top.sum(1), 1e-12)
        names, scores = np.empty(n, object), np.zeros(n)
        for k, name in enumerate(self.families):
            own = np.flatnonzero(family == k)
            members = [v for v in self.langs if family_of(v) == name]
            votes = np.zeros((len(own), len(members)))
            for i, j in combinations(range(len(members)), 2):
                p = self._probability(x[own], self.pairs[members[i], members[j]])
                votes[:, i] += p
                votes[:, j] += 1 - p
            if len(members) > 1:
                votes /= len(members) - 1
            else:
                votes[:] = 1
            best = votes.argmax(1)
            names[own] = np.array(members, object)[best]
            scores[own] = sure[own] * votes[np.arange(len(own)), best]
        return names, np.clip(scores, 0, 1)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The bounded sample: text and lang of labelled rows, the same at every run."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    return bounded_sample(labelled, "lang", per_language, F.xxhash64("doc_id", "text"), MOST_ROWS).select("text", "lang")


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Fitted on the rows of ``docs`` (doc_id, text, lang); None if none has a label."""

    def turn(batches):
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(0), rows=BLOCK_ROWS):
                rows = [x.astype(np.float16).tobytes() for x in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(a, b - a)], ["x", "lang"])

    rows = sample(docs, per_language).mapInArrow(turn, "x binary, lang string").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Hierarchy(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(1), rows=BLOCK_ROWS):
                names, scores = np.full(b - a, UNDETERMINED, object), np.zeros(b - a)
                own = has_letter(data, offsets)
                if sent.value is not None and own.any():
                    found, sure = sent.value.predict(features(data, offsets))
                    names[own], scores[own] = found[own], sure[own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
