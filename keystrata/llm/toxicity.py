"""Toxicity by a learned lexicon: Levenshtein automata of the words met with a trie of terms.

The lexicon is learned from labelled documents: whole words and word beginnings (stems) that
toxic documents share and clean ones lack, beyond what chance explains among all candidates.
Its terms form one trie. A batch's distinct words are run through it together: a node holds,
for the words still alive, the states of their automata (a band of the edit table, with swaps
of neighbours as one edit), and a word leaves as soon as no term below can be near enough.
Terms of five letters take one edit, of eight two; digits that stand for letters cost none.

Every term has its own weights of evidence, smoothed, by distance and by whether the text has it
often: a distance at which clean documents have words too counts for little, and a stem that
they have now and then counts where a text is full of it. The words around an exact match, quotation
marks and other matches near it give a context score, learned from the same labels on top of
a prior that quotations are milder; it scales the match's evidence, down to nothing. A document
sums, over the terms it holds, the best evidence of each.

The fit takes a bounded sample: about ``per_label`` documents a label of at most ``most_bytes``
bytes, near copies (equal least shingle) as one. Scoring takes every whole text. A null or
empty text has no words and the score of a document without matches. If only one label or
none was learned, all scores are that label, or 0. Equal rows each give their row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .quality import sample
from .scratch import Scratch

PER_LABEL = 10_000
MOST_BYTES = 20_000
THRESHOLD = 0.5
#: Terms of the lexicon, letters of a term, letters of a stem at least, documents a term stands in at least.
MOST_TERMS, LONGEST, SHORTEST_STEM, LEAST_DOCS = 5000, 20, 4, 3
#: A term's share of clean documents, against its share of toxic ones, at most: of those that hold it, of those that hold it often. A branch
#: holding so much of a stem's documents replaces it.
CLEAN_SHARE, BRANCH_SHARE = (0.01, 0.03), 0.9
#: A term stands often in a text with two or more of it that make up one word in a hundred.
OFTEN, RATE = 2, 0.01
#: Edits a term takes by its letters; a stem needs one letter more.
EDITS = ((8, 2), (5, 1), (0, 0))
BAND = 2
#: Toxic documents supposed at each distance besides those seen, clean ones likewise.
SUPPOSED, SUPPOSED_CLEAN = (0.5, 0.7, 0.5), 0.5
#: Words of context on either side; tokens that it knows; the limits of a token's and of a window's score; how many windows the prior of no effect weighs.
WINDOW, MOST_TOKENS, TOKEN_LIMITS, LIMITS, INERTIA = 5, 2000, {"": 1.0, "<quoted>": 3.0}, (-4.0, 1.5), 20
#: Of a hundred toxic and a hundred clean windows supposed, how many stand in quotation marks.
QUOTED = (5, 25)
QUOTE, NEAR = "<quoted>", "<near>"
BLOCK_BYTES = 1 << 19

_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 65536 else i for i in range(65536)], np.uint16)
_WORD = np.ones(65536, bool)
_WORD[:128] = False
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_FOLD = np.arange(65536, dtype=np.uint16)
for _digit, _letter in zip("013457", "oieast"):
    _FOLD[ord(_digit)] = ord(_letter)
_MARKS = np.zeros(65536, bool)
_MARKS[[ord(c) for c in "\"“”„«»‘‹›"]] = True


_COUNTS = ["toxic", "clean", "toxic_often", "clean_often"]


class Words:
    """The words of a block of texts as code points: small letters, digits of mixed words as the letters they stand for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = np.minimum(points, 65535).astype(np.uint16)
        low = _LOWER[self.raw]
        self.starts, self.stops, self.row = B.word_spans(low, lead[offsets], _WORD)
        if len(self.starts):
            digit = np.concatenate([[0], np.cumsum((low >= 0x30) & (low <= 0x39))])
            mixed = digit[self.stops] - digit[self.starts] < self.stops - self.starts
            inside = np.zeros(len(low) + 1, np.int32)
            np.add.at(inside, self.starts[mixed], 1)
            np.add.at(inside, self.stops[mixed], -1)
            low = np.where(np.cumsum(inside[:-1]) > 0, _FOLD[low], low)
        self.low = low

    def text(self) -> str:
        return self.low.astype("<u4").tobytes().decode("utf-32-le", "replace")


def edits(letters: int, stem: bool) -> int:
    return next(k for least, k in EDITS if letters - stem >= least)


class Node:
    __slots__ = ("below", "whole", "stem", "most")

    def __init__(self):
        self.below, self.whole, self.stem, self.most = {}, -1, -1, -1


class Trie:
    """The terms: whole words end in a space, stems do not."""

    def __init__(self, terms: list[str]):
        self.terms, self.root = terms, Node()
        letters = sorted({c for t in terms for c in t if c != " "})
        self.symbol = np.zeros(65536, np.uint8)  # 0: a letter of no term
        self.symbol[[ord(c) for c in letters]] = np.minimum(np.arange(1, len(letters) + 1), 254)
        self.width = max((len(t) for t in terms), default=0) + BAND
        for e, term in enumerate(terms):
            body = term.rstrip(" ")
            k, node = edits(len(body), term == body), self.root
            node.most = max(node.most, k)
            for c in body:
                node = node.below.setdefault(int(self.symbol[ord(c)]), Node())
                node.most = max(node.most, k)
            if term == body:
                node.stem = e
            else:
                node.whole = e

    def near(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest term and its distance (-1, 0 where none is near enough) of each word; ties go to the longer term, then the first."""
        n = len(chars)
        term, best = np.full(n, -1, np.int64), np.full(n, 99, np.int64)
        if not self.terms or not n:
            return term, np.zeros(n, np.int64)
        columns = np.arange(2 * BAND + 1)
        first = np.where((columns >= BAND) & (columns - BAND <= size[:, None]), columns - BAND, 9).astype(np.int8)
        stack = [(self.root, 0, np.arange(n), first, None, -1)]
        while stack:
            node, depth, alive, rows, older, last = stack.pop()
            for e, whole in ((node.whole, True), (node.stem, False)):
                if e < 0:
                    continue
                k = edits(depth, not whole)
                if whole:
                    at = size[alive] - depth + BAND
                    d = np.where((at >= 0) & (at <= 2 * BAND), rows[np.arange(len(alive)), np.clip(at, 0, 2 * BAND)], 9).astype(np.int64)
                else:
                    d = rows.min(1).astype(np.int64)
                rank = d * 1_000_000 - depth * 10_000  # nearer first, then longer
                ok = (d <= k) & ((term[alive] < 0) | (rank < best[alive]) | ((rank == best[alive]) & (e < term[alive])))
                term[alive[ok]], best[alive[ok]] = e, rank[ok]
            for symbol, child in node.below.items():
                place = depth + columns - BAND  # of the word's letter that stands under each column of the new row
                letter = np.full((len(alive), len(columns)), 255, np.uint8)
                inside = (place >= 0) & (place < chars.shape[1])
                letter[:, inside] = chars[np.ix_(alive, place[inside])]
                new = np.minimum(rows + (letter != symbol), 9).astype(np.int8)
                new[:, :-1] = np.minimum(new[:, :-1], rows[:, 1:] + 1)
                if older is not None:
                    before = np.full_like(letter, 255)
                    before[:, 1:] = letter[:, :-1]
                    if place[0] - 1 >= 0:
                        before[:, 0] = chars[alive, place[0] - 1]
                    swap = (letter == last) & (before == symbol)
                    new = np.where(swap, np.minimum(new, older + 1), new)
                new = np.where((place + 1 < 0) | (place + 1 > size[alive][:, None]), 9, np.where(place + 1 == 0, depth + 1, new)).astype(np.int8)
                for c in range(1, len(columns)):
                    new[:, c] = np.where((place[c] + 1 <= size[alive]) & (place[c] + 1 >= 0), np.minimum(new[:, c], new[:, c - 1] + 1), 9)
                live = new.min(1) <= child.most
                if live.any():
                    stack.append((child, depth + 1, alive[live], new[live], rows[live], symbol))
        return term, np.where(term >= 0, np.ceil(best / 1_000_000).astype(np.int64), 0)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, term and distance of every word of the block that is near a term."""
        long = np.flatnonzero(words.stops - words.starts >= min((len(t) for t in self.terms), default=99) - BAND - 1)
        none = np.zeros(0, np.int64)
        if not len(long) or not self.terms:
            return none, none, none
        place = words.starts[long][:, None] + np.arange(self.width)
        inside = place < words.stops[long][:, None]
        chars = np.where(inside, self.symbol[words.low[np.minimum(place, len(words.low) - 1)]], 255).astype(np.uint8)
        size = np.minimum(words.stops - words.starts, self.width)[long]
        key = (chars.astype(np.uint64) * B._TABLE[np.arange(self.width) % 256]).sum(1, dtype=np.uint64)
        _, at, back = np.unique(B.mix(key), return_index=True, return_inverse=True)
        term, d = self.near(chars[at], size[at])
        hit = np.flatnonzero(term[back] >= 0)
        return long[hit], term[back[hit]], d[back[hit]]


@dataclass
class Model:
    """Terms, their weights of evidence (held seldom or often, by distance), context scores of tokens, and the log odds of a document with and without matches."""

    trie: Trie
    weights: np.ndarray
    context: dict[str, float] = field(default_factory=dict)
    odds: float = -5.0
    bare: float = -5.0

    def score_context(self, words: Words, hits: np.ndarray, text: str) -> np.ndarray:
        out = np.zeros(len(hits))
        for k, tokens in enumerate(windows(words, hits, text)):
            out[k] = np.clip(sum(self.context.get(t, 0.0) for t in tokens), *LIMITS)
        return out


def windows(words: Words, hits: np.ndarray, text: str):
    """The set of tokens around each match: words, and marks for quotation and for matches near it."""
    marks = np.flatnonzero(_MARKS[words.raw])
    known = set(hits.tolist())
    for h in hits.tolist():
        lo, hi = h, h
        while lo > 0 and h - lo < WINDOW and words.row[lo - 1] == words.row[h]:
            lo -= 1
        while hi + 1 < len(words.row) and hi - h < WINDOW and words.row[hi + 1] == words.row[h]:
            hi += 1
        tokens = {text[words.starts[i] : min(words.stops[i], words.starts[i] + LONGEST)] for i in range(lo, hi + 1) if i not in known}
        if any(i in known for i in range(lo, hi + 1) if i != h):
            tokens.add(NEAR)
        left = np.searchsorted(marks, [max(words.starts[lo] - 1, 0), words.starts[h]])
        right = np.searchsorted(marks, [words.stops[h], words.stops[hi] + 1])
        if left[1] > left[0] and right[1] > right[0]:
            tokens.add(QUOTE)
        yield tokens


def candidates(rows: DataFrame) -> DataFrame:
    """Documents of either label that hold each word (ended by a space) and each beginning of a word: toxic and clean ones, then those that hold it often."""

    def count(batches):
        total: list[Counter[str]] = [Counter() for _ in range(4)]
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(0), BLOCK_BYTES):
                words = Words(data, offsets)
                text = words.text()
                at = np.searchsorted(words.row, np.arange(b - a + 1))
                for i, label in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    own = Counter(text[s : min(e, s + LONGEST + 1)] for s, e in zip(words.starts[at[i] : at[i + 1]].tolist(), words.stops[at[i] : at[i + 1]].tolist()))
                    terms: Counter[str] = Counter()
                    for w, n in own.items():
                        for k in range(1, min(len(w), LONGEST) + 1):
                            terms[w[:k]] += n
                        if SHORTEST_STEM <= len(w) <= LONGEST:
                            terms[w + " "] += n
                    least = max(OFTEN, RATE * (at[i + 1] - at[i]))
                    total[0 if label else 1].update(terms.keys())
                    total[2 if label else 3].update(w for w, n in terms.items() if n >= least)
        names = list(total[0] | total[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in total)], ["term", *_COUNTS])

    rows = rows.mapInArrow(count, f"term string, {', '.join(f'{c} long' for c in _COUNTS)}").groupBy("term")
    return rows.agg(*[F.sum(c).alias(c) for c in _COUNTS])


def choose(found: list[tuple[str, int, int, int, int]], toxic: int, clean: int, tried: int) -> list[str]:
    """The terms among ``found`` (rows of ``candidates``), of ``tried`` ones.

    Going down from the first letter, a stem that clean documents lack is taken unless one
    branch holds nearly all of its documents; then, and where clean documents have it, its
    branches are looked at.
    """
    rate = toxic / (toxic + clean)

    def unlikely(t: int, c: int) -> bool:
        p = t / max(t + c, 1)
        return p > rate and (t + c) * (p * log(p / rate) + ((1 - p) * log((1 - p) / (1 - rate)) if p < 1 else 0.0)) > log(max(tried, 2))

    counts = {term: n for term, *n in found}
    below: dict[str, list[str]] = {}
    for term in counts:
        below.setdefault(term[:-1], []).append(term)
    out, open_ = [], sorted(term for term in counts if term[:-1] not in counts)  # others come below their beginnings
    while open_:
        term = open_.pop()
        ways = [(t, c) for t, c, share in zip(counts[term][::2], counts[term][1::2], CLEAN_SHARE) if c / clean <= share * t / toxic and unlikely(t, c)]
        pure = bool(ways)
        way = counts[term].index(ways[0][0]) if pure else 0  # by documents that hold it, else by those that hold it often
        if term.endswith(" "):
            out += [term] * pure
            continue
        branches = sorted(below.get(term, []))
        if pure and len(term) >= SHORTEST_STEM and max((counts[b][way] for b in branches), default=0) < BRANCH_SHARE * ways[0][0]:
            out.append(term)
        else:
            open_ += branches
    return sorted(sorted(out, key=lambda term: (-counts[term][0], term))[:MOST_TERMS])


def levels(words: Words, hits: np.ndarray, term: np.ndarray, d: np.ndarray, texts: int) -> np.ndarray:
    """1 for matches of a term and distance that their text has often, else 0."""
    if not len(hits):
        return hits
    doc = words.row[hits]
    _, back, n = np.unique((doc * (MOST_TERMS + 1) + term) * (BAND + 1) + d, return_inverse=True, return_counts=True)
    return (n[back] >= np.maximum(OFTEN, RATE * np.bincount(words.row, minlength=texts)[doc])).astype(np.int64)


def seen(rows: DataFrame, trie: Trie, rare: np.ndarray) -> DataFrame:
    """Counts by label: documents with a term, often or not, at a distance, windows with a token, documents without matches.

    Windows are those of exact matches of terms that clean texts lack (``rare``): others stand there by chance and quote nothing.
    """
    sent = rows.sparkSession.sparkContext.broadcast(trie)

    def count(batches):
        total: Counter[tuple[str, str, int]] = Counter()
        for batch in batches:
            for a, b, data, offsets in B.texts(batch.column(0), BLOCK_BYTES):
                words, labels = Words(data, offsets), np.asarray(batch.column(1).slice(a, b - a))
                hits, term, d = sent.value.matches(words)
                often = levels(words, hits, term, d, b - a)
                for doc, e, o, k in {*zip(words.row[hits].tolist(), term.tolist(), often.tolist(), d.tolist())}:
                    total["match", f"{e}:{o}:{k}", int(labels[doc])] += 1
                exact = hits[d == 0]
                told = hits[(d == 0) & rare[term]]
                for h, tokens in zip(told.tolist(), windows(words, told, words.text() if len(told) else "")):
                    label = int(labels[words.row[h]])
                    total["window", "", label] += 1
                    for t in tokens:
                        total["token", t, label] += 1
                for doc in set(range(b - a)) - set(words.row[exact].tolist()):
                    total["bare", "", int(labels[doc])] += 1
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in names], pa.int64() if k == 2 else pa.string()) for k in range(3)] + [pa.array(list(total.values()), pa.int64())], ["kind", "name", "label", "n"])

    rows = rows.mapInArrow(count, "kind string, name string, label long, n long").groupBy("kind", "name")
    return rows.agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") != 0, F.col("n")).otherwise(0)).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES) -> Model | float:
    """The model fitted on labelled rows; a plain score if there is but one label, or none."""

    def sketch(batches):
        for batch in batches:
            least = [int(s.min()) if len(s) else 0 for _, _, data, offsets in B.texts(batch.column(0)) for s in B.shingle_sets(data, offsets, B.SPACED, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, B.as_long(np.array(least, np.uint64))], ["text", "label", "sketch"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = sample(docs, labels, label=label, per_label=per_label, most_bytes=most_bytes, most_lines=1 << 30)
    drawn = drawn.select("text", (F.col("label") > 0).cast("int").alias("label")).mapInArrow(sketch, "text string, label int, sketch long")
    rows = scratch.save(drawn.groupBy("label", "sketch").agg(F.min("text").alias("text")).select("text", "label"), "sample")
    have = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        return 1.0 if toxic else 0.0
    found = scratch.save(candidates(rows).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS), "candidates")
    more = [(F.col(t) >= LEAST_DOCS) & (F.col(t) * clean > F.col(c) * toxic) for t, c in (_COUNTS[:2], _COUNTS[2:])]  # more common in toxic documents
    wanted = found.where(more[0] | more[1])
    likely = [tuple(r) for r in wanted.collect()]
    trie = Trie(choose(likely, toxic, clean, found.count()))
    rare = {term for term, t, c, *_ in likely if c / clean <= CLEAN_SHARE[0] * t / toxic}
    model = Model(trie, np.zeros((len(trie.terms), 2, BAND + 1)), odds=log(toxic / clean))
    counts = seen(rows, trie, np.array([term in rare for term in trie.terms], bool)).where((F.col("kind") != "token") | (F.col("clean") + F.col("toxic") >= LEAST_DOCS)).orderBy(F.desc(F.col("clean") + F.col("toxic")), "name")
    known = {(r["kind"], r["name"]): (r["toxic"], r["clean"]) for k in ("match", "window", "bare", "token") for r in (counts.where(F.col("kind") == k).limit(MOST_TOKENS) if k == "token" else counts.where(F.col("kind") == k)).collect()}
    scratch.drop("sample", "candidates")
    for e in range(len(trie.terms)):
        for often, d in ((o, d) for o in (0, 1) for d in range(BAND + 1)):
            t, c = known.get(("match", f"{e}:{often}:{d}"), (0, 0))
            model.weights[e, often, d] = log((t + SUPPOSED[d]) / (toxic + 1)) - log((c + SUPPOSED_CLEAN) / (clean + 1))
    model.weights[:, 1] = model.weights.max(1)  # where holding a term at all tells enough, holding it often tells no less
    t, c = known.get(("bare", ""), (0, 0))
    model.bare = min(model.odds, log(t + 0.5) - log(c + 0.5))
    many = known.get(("window", ""), (0, 0))
    for (kind, name), (t, c) in {("token", QUOTE): (0, 0), **known}.items():
        if kind == "token":
            prior = (QUOTED[0] / 100, QUOTED[1] / 100) if name == QUOTE else (((t + c + 1) / (sum(many) + 2)),) * 2
            high = (t + INERTIA * prior[0]) / (many[0] + INERTIA), (c + INERTIA * prior[1]) / (many[1] + INERTIA)
            value = log(high[0] / high[1])
            most = TOKEN_LIMITS.get(name, TOKEN_LIMITS[""])
            model.context[name] = float(np.clip(value, -most, most))
    return model


def judged(column: pa.Array, model: Model | float):
    """(first row, rows, scores, matches) of each block; a match is its document, first and end code point, term, distance and evidence."""
    for a, b, data, offsets in B.texts(column, BLOCK_BYTES):
        if isinstance(model, float):
            yield a, b - a, np.full(b - a, model), []
            continue
        words = Words(data, offsets)
        hits, term, d = model.trie.matches(words)
        score, found = np.full(b - a, 1 / (1 + exp(-model.bare))), []
        if len(hits):
            value = model.weights[term, levels(words, hits, term, d, b - a), d]
            use = np.flatnonzero(value > 0)
            hits, term, d, value = hits[use], term[use], d[use], value[use]
        if len(hits):
            value = value * 2 / (1 + np.exp(-model.score_context(words, hits, words.text())))
            doc = words.row[hits]
            order = np.lexsort((-value, term, doc))
            one = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (term[order][1:] != term[order][:-1])])
            total = np.bincount(doc[order][one], value[order][one], b - a)
            own = np.unique(doc[value > 0])
            score[own] = 1 / (1 + np.exp(-np.clip(model.odds + total[own], -60, 60)))
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            found = list(zip(doc.tolist(), (words.starts[hits] - lead[doc]).tolist(), (words.stops[hits] - lead[doc]).tolist(), [model.trie.terms[e].strip() for e in term.tolist()], d.tolist(), value.tolist()))
        yield a, b - a, score, found


def score(docs: DataFrame, model: Model | float, *, matches_too: bool = False) -> DataFrame:
    """doc_id and score of every whole text; ``matches_too`` adds the matches with their evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("distance", pa.int64()), ("evidence", pa.float64())])

    def judge(batches):
        for batch in batches:
            for a, n, total, found in judged(batch.column(1), sent.value):
                columns = [batch.column(0).slice(a, n), pa.array(total)]
                if matches_too:
                    own: list[list] = [[] for _ in range(n)]
                    for doc, *rest in found:
                        own[doc].append(dict(zip(("start", "end", "term", "distance", "evidence"), rest)))
                    columns.append(pa.array(own, pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "matches"][: len(columns)])

    kinds = "doc_id long, score double" + ", matches array<struct<start:long,end:long,term:string,distance:long,evidence:double>>" * matches_too
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, kinds)
