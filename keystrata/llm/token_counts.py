"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries: ASCII white space, and before a full stop or comma
that ends such a piece after a small letter. Whether a vocabulary drops white space and
parts words from points, so that the tokens of a text are the tokens of its pieces, is read
from the file's normaliser and pre-tokeniser; a file that does not say so gets whole texts.
Where it folds case, case is folded before the library does only where its
normaliser, which composes first, gives the same. A worker numbers the pieces it has met and keeps their ids
in one array (beyond ``CACHE_PIECES`` it starts anew, which changes no result). New ones are handed to
the library many at a time, as one text with a mark behind each, since a call's cost lies in its
texts: the ids between two marks are the piece's, and if the marks found are not as many as
the pieces, these are encoded one by one. The tokenizer's own rules hold within a
piece: its normaliser, its special strings, its splits.

``whole`` switches the splitting off for any vocabulary.
Null and empty texts have no bytes and no tokens; equal rows each give their row.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
BATCH_BYTES = 1 << 20
CACHE_PIECES = 600_000
#: Pieces and characters that are handed to the library as one text, and what may stand between them.
JOINED, JOINED_BYTES, MARKS = 100, 1 << 14, "\x01~^0"
#: A capital that a mark may follow (U+0300 or above): the library composes the two before it folds case.
MARKED = re.compile(rb"[A-Z][\xcc-\xff]")


def load(path: str):
    """The tokenizers file at ``path``, as delivered but without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def batches(pieces: list[str], limit: int, most: int = 1 << 62) -> Iterator[list[str]]:
    """Runs of at most ``most`` pieces and about ``limit`` characters."""
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece)
        size += len(piece) + 16
        if size >= limit or len(batch) >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _steps(spec: dict | None) -> list[dict]:
    """The steps of a normaliser or pre-tokeniser, in order."""
    return [] if not spec else [s for own in spec[next(k for k in ("normalizers", "pretokenizers") if k in spec)] for s in _steps(own)] if spec["type"] == "Sequence" else [spec]


def drops_space(spec: dict) -> bool:
    """Whether a tokenizers file surely splits at white space, drops it and never joins a letter and a full stop or comma."""
    import regex

    words = next((s for s in _steps(spec.get("pre_tokenizer")) if s["type"] in ("Split", "BertPreTokenizer", "Whitespace")), None)
    kept = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer", "Replace"}
    plain = all(s["type"] in kept and (s["type"] != "Replace" or (s["pattern"].get("Regex") == r"\s+" and s["content"] == " ")) for s in _steps(spec.get("normalizer")))
    if words is None or not plain or any(not t["content"].strip() or set(t["content"]) & set(" \t\n") for t in spec.get("added_tokens", ())):
        return False
    if words["type"] != "Split":
        return True
    pattern = regex.compile(words["pattern"].get("Regex") or regex.escape(words["pattern"]["String"]))
    # A pattern that keeps matches only and finds none with white space in what surrounds it by letters, digits and points.
    probes = [f"{a}{c}{b}" for a in ("", "a", "1", ".", "'s", "\u00e9") for b in ("", "a", "1", ",", "'s", "\u00e9") for c in " \t\n\x0b\x0c\r"]
    apart = all(m.group() in ("x", p) for p in ".," for m in pattern.finditer(f"x{p}"))
    return words["behavior"] == "Removed" and words["invert"] and apart and not any(set(m.group()) & set(" \t\n\x0b\x0c\r") for p in probes for m in pattern.finditer(p))


def folds_case(spec: dict) -> bool:
    return any(s["type"] == "Lowercase" or s["type"] == "BertNormalizer" and s.get("lowercase") for s in _steps(spec.get("normalizer")))


class Known(dict):
    """Numbers of the pieces met so far; a new one gets the next number and waits in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class Pieces:
    """The library's ids of each piece, one behind the other: those of piece k lie at [ends[k - 1], ends[k])."""

    def __init__(self, path: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        self.whole, self.folds = whole or not drops_space(spec), folds_case(spec)
        self.special = [t["content"].encode().lower() for t in spec.get("added_tokens", ())]
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.mark = None if self.whole else self._mark()
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.ends = Known(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _mark(self) -> tuple[str, int] | None:
        """A character, and its id, that stays a token of its own between pieces."""
        for c in MARKS:
            alone, x, both = (f.ids for f in self.encode([c, "x", f"{c} x {c}"], add_special_tokens=False))
            if len(alone) == 1 and both == [*alone, *x, *alone]:
                return c, alone[0]
        return None

    def split(self, text: bytes) -> list[bytes]:
        if self.whole:
            return [text]
        low = text.lower() if self.folds else text
        if not self.folds or any(s in low for s in self.special):  # folded, a piece could become a special string
            return text.split()
        if text.isascii() or not MARKED.search(text):
            return low.split()
        return [p.lower() if p.isascii() else p for p in text.split()]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the pieces and how many each has, every piece encoded by itself."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for batch in batches(pieces, BATCH_BYTES):
            for f in self.encode(batch, add_special_tokens=False):
                ids.append(np.array(f.ids, np.uint32))
                sizes.append(len(ids[-1]))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, but many pieces are handed over as one text, a mark behind each."""
        if self.mark is None:
            return self._each(pieces)
        c, own = self.mark
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = batches(pieces, JOINED_BYTES, JOINED)
        while some := list(islice(groups, 16)):
            for group, f in zip(some, self.encode([f" {c} ".join([*g, ""]) for g in some], add_special_tokens=False), strict=True):
                found = np.array(f.ids, np.uint32)
                at = np.flatnonzero(found == own)
                if len(at) == len(group):
                    found, n = found[found != own], np.diff(at, prepend=-1) - 1
                else:  # a piece has the mark's id too
                    found, n = self._each(group)
                ids.append(found)
                sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self) -> None:
        """Gives the new pieces their ids, in the order of their numbers."""
        known, new = self.known, self.known.new
        ended = np.array([not self.whole and p[-1] in b".," and len(p) > 1 and 97 <= p[-2] <= 122 for p in new], bool)
        parts = np.array([(known[new[k][:-1]], known[new[k][-1:]]) for k in np.flatnonzero(ended)], np.int64).ravel()  # these become known with them
        ended = np.append(ended, np.zeros(len(new) - len(ended), bool))
        first, sizes = len(self.ends), np.zeros(len(new), np.int64)
        plain = np.flatnonzero(~ended)
        ids, sizes[plain] = self._encoded([new[k].decode() for k in plain])
        # First as if the ended ones had none, then in two parts.
        flat, ends = np.concatenate([self.flat, ids]), np.append(self.ends, np.cumsum(sizes) + len(self.flat))
        more, n = taken(flat, ends, parts)
        sizes[ended] = n.reshape(-1, 2).sum(1)
        own = np.zeros(int(sizes.sum()), np.uint32)
        long = np.repeat(ended, sizes)
        own[long], own[~long] = more, ids
        self.flat, self.ends = np.concatenate([self.flat, own]), np.append(self.ends[:first], np.cumsum(sizes) + len(self.flat))
        known.new = []

    def of(self, texts: list[bytes], ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """The ids of all the texts, one behind the other (or None), and where each text's ids end."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self._forget()
        last = np.cumsum([0, *map(len, split)])
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(last[-1]))
        if self.known.new:
            self._learn()
        flat, n = taken(self.flat, self.ends, numbers, ids)
        return flat, np.append(0, np.cumsum(n))[last][1:]


def taken(flat: np.ndarray, ends: np.ndarray, k: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """What ``flat`` holds for each of ``k``, one behind the other (or None), and how much for each."""
    start = np.append(0, ends)[k]
    n = ends[k] - start
    if not ids:
        return None, n
    before = np.cumsum(n) - n
    return flat[np.repeat(start - before, n) + np.arange(int(n.sum()))], n


_held: dict[tuple, Pieces] = {}


def held(path: str, whole: bool = False) -> Pieces:
    """The worker's pieces for one file, kept from task to task."""
    if (key := (path, whole)) not in _held:
        _held[key] = Pieces(path, whole)
    return _held[key]


def text_blocks(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts of column 1) of runs of at most ``rows`` rows and about BATCH_BYTES bytes, or a single longer row."""
    for a in range(0, batch.num_rows, rows):
        own: list[bytes] = []
        size = 0
        for k, t in enumerate(batch.column(1).slice(a, rows)):
            t = t.as_py() or b""
            if own and size + len(t) > BATCH_BYTES:
                yield a + k - len(own), own
                own, size = [], 0
            own.append(t)
            size += len(t)
        yield min(a + rows, batch.num_rows) - len(own), own


def token_counts(docs: DataFrame, path: str | None = None, *, whole: bool = False, block_rows: int = 500) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text."""

    def count(batches):
        pieces = held(path or default_path(), whole)
        for batch in batches:
            for a, texts in text_blocks(batch, block_rows):
                _, ends = pieces.of(texts, ids=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(map(len, texts), pa.int64()), pa.array(np.diff(ends, prepend=0))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def digest(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
