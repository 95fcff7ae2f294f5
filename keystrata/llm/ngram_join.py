"""N-gram Jaccard join: exact set-similarity self-join by T-occurrence search.

Documents with equal shingle sets form one class; classes are joined, copies are not. The
work has four passes, each over whole texts:

1. Sets are hashed to class ids, and count sketches of all shingles and of all words (fixed
   size, merged over all rows) give every shingle its rarity: how often it was met, if that
   stands out from the shingles that share its counter, then how often its words let expect
   it. The counters of shingles crowd as the corpus grows, those of words do not.
2. A class that reaches the threshold with another must share one of its rarest shingles
   (s - ceil(t s) + 1 of s). Inverted lists are built of these only; neighbours in a list
   whose sizes can reach the threshold tie classes into candidate groups. A list is
   streamed in sorted order, never held.
3. Each group's full sets go to one task, which runs T-occurrence search: the overlap T
   follows from the sizes; of a class's inverted lists the L longest are set aside
   (DivideSkip), the short ones are merged, classes met T - L times are kept, and the
   long lists are probed for these by binary search. Groups over ``group_tokens`` shingles
   are dealt out to pairs of blocks, so that a task holds two blocks at most and every
   pair still meets in exactly one task.
4. Links are tied into components.

The sketches only order shingles; errors in them change costs, not results. Null texts and
texts without words have empty sets and link with nothing; shorter texts than a shingle are
one shingle. Null doc_ids take part but never name a component unless it has no other.
Nothing but the sketches goes through the driver: sets meet their group by a join, which
sends the candidates' names to all tasks while they are few (``rows.BROADCAST_KEYS``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import connected_components
from .rows import bounded, free_name, key
from .scratch import Scratch
from .sketch import COUNTERS, WORD_COUNTERS, WORDS_FROM, Counts, Sketch, merged

GROUP_TOKENS = 10_000_000
#: Classes that a task remembers to give their set but once; forgetting them changes no result.
REMEMBERED = 500_000
#: Rows of a list that a task holds; longer lists count as so long.
LISTED = 1_000_000


def _class_id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _words(batches):
    """(batch, first row, hashes of words, first word of each row) of each block of a (doc_id, text) stream."""
    for batch in batches:
        for a, _, data, offsets in B.texts(batch.column(1)):
            yield batch, a, *B.word_hashes(B.LOWER[data], offsets, B.SPACED)


def _sets(batches, k: int):
    """(batch, first row, sets) of each block of a (doc_id, text) stream."""
    for batch, a, h, at in _words(batches):
        yield batch, a, B.sets_of(h, at, k)


class Rarity:
    """Places of shingles in an order by rarity, which depends on nothing but the shingle; a task's process works it out once."""

    def __init__(self, sketch: Sketch):
        self.sketch, self._met, self._weights = sketch, None, None

    def of_words(self, h: np.ndarray) -> np.ndarray:
        """How rare each word is; what adds up over a shingle."""
        if self._weights is None:
            words = self.sketch.words().astype(np.float64)
            self._weights = np.round(16 * np.log2((words.sum() + 1) / (words + 1))).astype(np.int64)
        return self._weights[(h % np.uint64(WORD_COUNTERS)).astype(np.int64)]

    def places(self, s: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The rarest come first; ``rare`` is the sum over the words of each."""
        if self._met is None:
            self._met = self.sketch.counts()
            usual = float(np.median(self._met))
            self._met[self._met <= usual + 4 * usual**0.5] = 0
        return (self._met[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.int64) << 20) - rare


def classes_and_sketch(docs: DataFrame, k: int, named: bool = False) -> DataFrame:
    """A row (doc_id, n, sid, row) for each document, and each task's counters of shingles and words as (part, counts) rows; row is null unless ``named``."""

    def scan(batches):
        counts, words, names = Counts(), Counts(WORD_COUNTERS), ["doc_id", "n", "sid", "row", "part", "counts"]
        for batch, a, h, at in _words(batches):
            words.add(h)
            sets = B.sets_of(h, at, k)
            n = len(sets)
            for s in sets:
                counts.add(s)
            sids = pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64())
            own = batch.column(2).slice(a, n) if named else pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(map(len, sets), pa.int64()), sids, own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        part, own = map(pa.concat_arrays, zip(counts.parts(), words.parts(WORDS_FROM), strict=True))
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(part), pa.binary()), part, own], names)

    rows = docs.select("doc_id", "text", *[key().alias("row")] * named)
    return rows.mapInArrow(scan, "doc_id long, n long, sid long, row binary, part int, counts binary")


def _least(n, num: int, den: int):
    """Shingles that a class of n shares at least with one that it is linked with, which is also the least size of such a class."""
    return (num * n + den - 1) // den


def _spare(n, num: int, den: int):
    """Shingles that a class of n lists beyond its prefix: two linked classes share one more than the smaller of them has to spare."""
    least = _least(n, num, den)
    return np.minimum(n - least + 1, least - 1)


def prefix_rows(docs: DataFrame, sketch: Sketch, k: int, num: int, den: int) -> DataFrame:
    """(token, sid, size): the rarest shingles of each class, its prefix and as many to spare; of copies a task gives one."""
    sent = docs.sparkSession.sparkContext.broadcast(Rarity(sketch))

    def scan(batches):
        given: set[int] = set()
        order = sent.value
        for _, _, h, at in _words(batches):
            tokens, sids, sizes = [], [], []
            for s, words in B.summed_sets(h, at, k, order.of_words(h)):
                n = len(s)
                if not n or (sid := _class_id(s)) in given:
                    continue
                given.add(sid)
                p = n - _least(n, num, den) + 1 + int(_spare(n, num, den))
                rare = np.lexsort((s, order.places(s, words)))[:p]
                tokens.append(s[rare])
                sids.append(np.full(p, sid, np.int64))
                sizes.append(np.full(p, n, np.int32))
            if len(given) > REMEMBERED:
                given.clear()  # then a copy is given again, which the lists pass over
            if tokens:
                yield pa.RecordBatch.from_arrays([B.as_long(np.concatenate(tokens)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes))], ["token", "sid", "size"])

    return docs.select("doc_id", "text").mapInArrow(scan, "token long, sid long, size int")


def _runs(batches):
    """Sorted batches cut anew, so that rows with the same first value stay together: (columns, False). More than LISTED such rows come in parts: (columns, True)."""
    held, long = None, None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            columns, held = [np.concatenate(x) for x in zip(held, columns, strict=True)], None
        if long is not None:
            rest = int(np.searchsorted(columns[0], long, "right"))
            if rest:
                yield [c[:rest] for c in columns], True
            columns = [c[rest:] for c in columns]
        if not len(columns[0]):
            continue
        long, last = None, int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield [c[:last] for c in columns], False
        held = [c[last:] for c in columns]
        if len(held[0]) > LISTED:
            yield held, True
            long, held = held[0][0], None
    if held is not None:
        yield held, False


def _distinct(columns: list[np.ndarray], by: tuple[int, int]) -> list[np.ndarray]:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([columns[i][1:] != columns[i][:-1] for i in by])
    return [c[new] for c in columns]


def _lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its place in the run of equal values, and the length of the run."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    length = np.diff(np.append(starts, len(values)))
    return np.arange(len(values)) - np.repeat(starts, length), np.repeat(length, length)


def tied_rows(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``prefixes`` those rows that can tie a class to another, by the true lengths of the lists.

    A row whose list has no other class of a size that can reach the threshold ties nothing.
    Of the others a class may do without as many as its smallest partner has to spare, those
    with the longest lists: of the shingles that two linked classes share in their lists, the
    one with the shortest list has more others above it on either side than that. So a class
    that shares a few shingles by chance, or a passage, ties to nothing.
    """

    def met(batches):
        for columns, long in _runs(batches):
            t, s, n = _distinct(columns, (0, 1))
            n = n.astype(np.int64)
            tied = np.full(len(t), long)
            near = (t[1:] == t[:-1]) & (den * n[:-1] >= num * n[1:])
            tied[1:] |= near
            tied[:-1] |= near
            listed = np.full(len(t), LISTED) if long else np.minimum(_lengths(t)[1], LISTED)
            yield pa.RecordBatch.from_arrays([pa.array(c[tied]) for c in (s, listed, t, n)], ["sid", "listed", "token", "size"])

    def needed(batches):
        for columns, long in _runs(batches):
            s, _, t, n = _distinct(columns, (0, 2))
            place, length = _lengths(s)
            keep = (place < length - _spare(_least(n, num, den), num, den)) | long
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(s[keep]), pa.array(n[keep].astype(np.int32))], ["token", "sid", "size"])

    rows = prefixes.repartition("token").sortWithinPartitions("token", "size", "sid").mapInArrow(met, "sid long, listed long, token long, size long")
    return rows.repartition("sid").sortWithinPartitions("sid", "listed", "token").mapInArrow(needed, "token long, sid long, size int")


def candidate_edges(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between neighbours of a list of tied rows, by size, that can reach the threshold."""

    def scan(batches):
        last = None
        for batch in batches:
            t, s, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            if last is not None:
                t, s, n = (np.concatenate([[x], y]) for x, y in zip(last, (t, s, n), strict=True))
            last = t[-1], s[-1], n[-1]
            tied = (t[1:] == t[:-1]) & (s[1:] != s[:-1]) & (den * n[:-1].astype(np.int64) >= num * n[1:].astype(np.int64))
            a, b = np.minimum(s[1:], s[:-1])[tied], np.maximum(s[1:], s[:-1])[tied]
            e = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return tied_rows(prefixes, num, den).repartition("token").sortWithinPartitions("token", "size", "sid").mapInArrow(scan, "a long, b long").distinct()


def t_occurrence(sets: list[np.ndarray], block: np.ndarray, num: int, den: int, mu: float = 0.01):
    """All pairs (x, y) with den * |x & y| >= num * |x | y|; of pairs within one block only if all are of that block.

    ``sets`` come by size. Yields x and the array of its partners after it.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.repeat(np.arange(n), sizes)
    postings = np.sort(tokens * n + docs)  # the inverted lists, one behind the other
    length = np.bincount(tokens)
    start = np.concatenate([[0], np.cumsum(length)])
    crossed = len(np.unique(block)) > 1
    for x in range(n - 1):
        last = int(np.searchsorted(sizes, den * sizes[x] // num, "right"))  # length bound
        if last <= x + 1:
            continue
        need = -(-2 * num * int(sizes[x]) // (num + den))
        own = tokens[at[x] : at[x + 1]]
        own = own[length[own] > 1]
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        skip = min(need - 1, int(need / (mu * np.log2(max(2, length[own[-1]])) + 1)))
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        met = np.concatenate([postings[start[t] : start[t + 1]] - t * n for t in short])
        met = met[(met > x) & (met < last)]
        met.sort(kind="stable")  # merges the lists, which are sorted runs
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(met)), bool), met[1:] != met[:-1]]))
        found, times = met[new], np.diff(np.append(new, len(met)))
        keep = times >= need - skip
        if crossed:
            keep &= block[found] != block[x]
        found, times = found[keep], times[keep]
        for a in range(0, len(found), 4096):
            y, count = found[a : a + 4096], times[a : a + 4096]
            if len(long):
                keys = (long[:, None] * n + y[None, :]).ravel()
                hit = postings[np.minimum(np.searchsorted(postings, keys), len(postings) - 1)] == keys
                count = count + hit.reshape(len(long), len(y)).sum(0)
            linked = den * count >= num * (sizes[x] + sizes[y] - count)
            if linked.any():
                yield x, y[linked], count[linked]


def _search(groups: DataFrame, num: int, den: int, all_pairs: bool) -> DataFrame:
    """For each class of a group its root in the task and its number of links; or all links."""

    def solve(key, rows):
        sids = np.array([r[0] for r in rows], np.int64)
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        block = np.array([r[2] for r in rows])
        root, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        pairs = []
        for x, y, overlap in t_occurrence(sets, block, num, den):
            links[x] += len(y)
            links[y] += 1
            if all_pairs:
                pairs += [(sids[x], sids[j], int(c), len(sets[x]) + len(sets[j]) - int(c)) for j, c in zip(y, overlap, strict=True)]
            for j in y:
                root[max(find(x), find(j))] = min(find(x), find(j))
        if all_pairs:
            return pairs
        return [(sids[i], sids[find(i)], links[i]) for i in range(len(rows)) if links[i]]

    def scan(batches):
        held, own = [], None

        def done():
            alone = own[1] != own[2] and len({block for _, _, block in held}) == 1  # the other block is empty; (i, i) finds these pairs
            found = solve(own, held) if len(held) > 1 and not alone else []
            columns = list(zip(*found, strict=True)) if found else [[]] * (4 if all_pairs else 3)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "overlap", "joined"] if all_pairs else ["sid", "root", "links"])

        for batch in batches:
            for g, i, j, sid, s, block in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "sid", "shingles", "block")), strict=True):
                if (g, i, j) != own:
                    if held:
                        yield done()
                    held, own = [], (g, i, j)
                if not held or held[-1][0] != sid:
                    held.append((sid, s, block))
        if held:
            yield done()

    rows = groups.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "size", "sid")
    return rows.select("group", "i", "j", "sid", "shingles", "block").mapInArrow(scan, "a long, b long, overlap long, joined long" if all_pairs else "sid long, root long, links long")


class Join:
    """The steps of one join, with its scratch tables."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, group_tokens: int = GROUP_TOKENS, named: bool = False):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.num, self.den, self.group_tokens = k, num, den, group_tokens
        self.scratch = Scratch(docs.sparkSession, "ngram-join")
        first = self.scratch.save(classes_and_sketch(self.docs, k, named), "classes")
        self.members = first.where("part is null").select("doc_id", "n", "sid", "row")
        self.reps = self.members.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
        edges = self.scratch.save(candidate_edges(prefix_rows(self.docs, merged(first.where("part is not null")), k, num, den), num, den), "edges")
        groups = connected_components(edges, self.scratch, "groups")
        self.groups = self.scratch.save(groups.withColumnsRenamed({"node": "sid", "root": "group"}).join(self.reps, "sid"), "candidates")
        self.scratch.drop("edges")

    def _blocks(self) -> DataFrame:
        """The sets of the candidate classes, read from one document of each and dealt out to pairs of blocks of their group."""
        k = self.k
        tokens = self.groups.groupBy("group").agg(F.ceil(F.sum("n") / self.group_tokens).cast("int").alias("blocks"))
        placed = self.groups.join(tokens, "group").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        placed = self.scratch.save(placed.select("sid", "rep", "group", "blocks", "block", F.col("n").cast("int").alias("size")), "placed")
        reps = placed.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
        docs = self.docs.join(bounded(reps), "doc_id", "left_semi").unionByName(self.docs.where("doc_id is null"))

        def scan(batches):
            given: set[int] = set()
            for _, _, sets in _sets(batches, k):
                found = {sid: s for s in sets if len(s) and (sid := _class_id(s)) not in given}
                given.update(found)
                if len(given) > REMEMBERED:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["sid", "shingles"])

        rows = docs.mapInArrow(scan, "sid long, shingles binary").join(bounded(placed.drop("rep")), "sid")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        return rows.select("*", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def links(self) -> DataFrame:
        """(a, b, overlap, joined): every linked pair of classes, named by their least doc_id."""
        found = _search(self._blocks(), self.num, self.den, True)
        name = lambda c: self.reps.select(F.col("sid").alias(c), F.col("rep").alias(f"{c}_id"))
        return found.join(name("a"), "a").join(name("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "overlap", "joined")

    def _tied(self) -> tuple[DataFrame, DataFrame]:
        """(sid, root) of the classes with links, and (sid, n_links)."""
        found = self.scratch.save(_search(self._blocks(), self.num, self.den, False), "links")
        roots = connected_components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")), self.scratch, "roots")
        return roots.withColumnRenamed("node", "sid"), found.groupBy("sid").agg(F.sum("links").alias("n_links"))

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id, n_links (classes linked with) of every document."""
        roots, links = self._tied()
        named = roots.join(self.groups.select("sid", "rep"), "sid")
        least = named.groupBy("root").agg(F.min("rep").alias("component"))
        linked = named.join(least, "root").select("sid", "component").join(links, "sid")
        classes = self.scratch.save(self.reps.join(linked, "sid", "left").select("sid", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
        out = self.members.join(classes, "sid", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, with all their columns, but one for each component; of a Join that is ``named``.

        The one that stays has the least doc_id, a null one coming last; of several with that
        doc_id, the least name. Of rows that are equal in doc_id and text one stays. Rows
        without words tie to nothing, so all of them stay.
        """
        roots, _ = self._tied()
        of = self.members.where("sid is not null").join(roots, "sid", "left").select(F.coalesce("root", "sid").alias("root"), "doc_id", "row")
        each = self.scratch.save(of.groupBy("root", "doc_id", "row").agg(F.count("*").alias("copies")), "rows")
        first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row", "copies")).alias("first"))
        stay = self.scratch.save(first.select("first.row", "first.copies"), "stay")
        name, own = free_name(docs, "_row"), free_name(docs, "_own")
        gone = bounded(each.select("row").distinct().join(stay, "row", "left_anti").select(F.col("row").alias(name)))
        left = docs.withColumn(own, key()).join(gone, F.col(own) == F.col(name), "left_anti")
        again = stay.where("copies > 1").select(F.col("row").alias(name))
        if not again.isEmpty():
            again, rest = bounded(again), left
            left = rest.join(again, F.col(own) == F.col(name), "left_anti").unionByName(rest.join(again, F.col(own) == F.col(name), "left_semi").dropDuplicates([own]))
        return left.select(*docs.columns)


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of num / den or more."""
    return Join(docs, k, num, den, group_tokens).documents()


def brute_force(docs: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    """The contract by plain loops, for tests."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = [], list(range(len(docs)))
    for _, text in docs:
        w = [x.decode() for x in (text or "").translate(lower).encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    return [(d, len(s), least[r]) for (d, _), s, r in zip(docs, sets, root, strict=True)]


def oracle_sql(k: int, num: int, den: int) -> str:
    """The join by DuckDB, for tables whose doc_ids differ and are not null."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS s FROM w),
c AS (SELECT min(doc_id) AS c, len(any_value(s)) AS n, any_value(s) AS s, list(doc_id) AS members FROM d WHERE len(s) > 0 GROUP BY list_sort(s)),
g AS (SELECT c, n, unnest(s) AS g FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.g = b.g AND a.c <> b.c AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY a.c, b.c HAVING {den} * count(*) >= {num} * (any_value(a.n) + any_value(b.n) - count(*))),
r(c, m) AS (SELECT c, c FROM c UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.c WHERE r.m < l.b),
m AS (SELECT c, min(m) AS m FROM r GROUP BY c),
p AS (SELECT unnest(members) AS doc_id, c FROM c)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, CAST((SELECT count(*) FROM l WHERE l.a = p.c) AS BIGINT) AS n_links FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (c)
"""
