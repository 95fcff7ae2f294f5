"""Repair of conversations whose rows were lost, emptied, cut, repeated or given the wrong role.

Every row becomes a symbol: the initial of its role (s, u, a, else o) and its first fault
(blank, repeated: the row has to go; cut off; none). The symbols of a conversation are cut
into pieces of bounded length. Rules in the manner of Re-Pair, learned on the counted
distinct pieces of all conversations, replace frequent pairs of symbols; a round takes the
most frequent pairs that share no symbol at once, as one pair a round would cost one pass
each. Every rule has one min-plus transfer matrix over the states of the wanted order
``(s?(ua)+)?``, made bottom-up from its two parts, and every entry of it the cheapest
edits as a rope (a pair of ropes, flattened once). A piece is the product of the matrices of
its symbols, a conversation that of its pieces, so equal stretches are worked out once.

Edits are written K (keep), R (give the role user or assistant), D (delete), I (insert an empty
row of user or assistant); at one cost the least text wins. Insertions belong to the row
after them, so that texts of the same rows are never prefixes of each other and the least
of a whole is made of the least of its parts.

A null stands for one space in any column. Rows are ordered by turn (nulls first), then role,
then the hash of the text, so the order of ties does not depend on partitions; equal rows all
count. A null conv_id is one conversation. Rows of one conversation are sorted and cut into
pieces in many tasks; only its edits, and its repaired text for the hash, pass through one
task, as a stream. A table without rows gives none. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Symbols: role s, u, a or other without a fault, the same cut off, and a row that has to go.
TERMINALS = "SUAOsuaoD"
COST = {"R": 1, "D": 2, "I": 5}
CUT_OFF = 5
#: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES = 4
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_END = {0: "", 1: "II", 2: "I", 3: ""}
#: Places of the sorted rows that one piece spans at most.
PIECE_BITS = 10
#: Rounds of the grammar, new rules of one round, and how often a pair has to stand in the distinct pieces.
ROUNDS, RULES_A_ROUND, LEAST_PAIRS = 10, 64, 4
WHITE = "\\x09-\\x0D\\x20"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the contract's damage, chosen by crc32 of ``conv_id:turn``."""
    h = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    own = rows.select(F.col("conv_id"), F.col("turn"), _text("role").alias("role"), _text("text").alias("text"), h.alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row, without its text, with its place ``at`` in the order of all rows and its first fault."""
    seen = F.rtrim(F.regexp_replace("text", f"[{WHITE}]", " "))  # white space as blanks, none at the end
    small = rows.select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.unhex(F.md5("text")).alias("hash"),
        (F.length(seen) == 0).alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("tie"),
    )
    # the last key parts equal rows too, so that no value has to fit into one task
    ranged = small.repartitionByRange(F.col("conv_id"), *_order(), F.col("tie")).sortWithinPartitions("conv_id", *_order(), "tie")
    placed = scratch.save(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), "placed")
    firsts = placed.groupBy("conv_id", "role", "hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return placed.join(firsts, "at", "left").select("conv_id", "turn", "role", "hash", "at", fault.alias("fault"))


def pieces(found: DataFrame) -> DataFrame:
    """Up to 2^PIECE_BITS neighbouring rows of one conversation: their symbols and what counts need of them."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", known).otherwise(F.upper(known))
    rows = found.select("conv_id", "turn", "at", initial.alias("initial"), symbol.alias("symbol"), "fault")
    listed = F.sort_array(F.collect_list(F.struct("at", "symbol", "initial", "turn")))
    count = [F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    own = rows.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(listed.alias("l"), *count)
    pairs = F.arrays_zip(F.slice("l", 1, F.size("l") - 1).alias("a"), F.slice("l", 2, F.size("l")).alias("b"))
    legal = lambda p: F.concat(p.a.initial, p.b.initial).isin("su", "ua", "au")
    turns = F.filter("l", lambda x: x.turn.isNotNull())
    changes = F.size(F.filter(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.size("t")).alias("b")), lambda p: p.a.turn != p.b.turn))
    return own.withColumn("t", turns).select(
        "conv_id", "piece", "blank", "duplicate", "truncated", F.array_join(F.transform("l", lambda x: x.symbol), "").alias("symbols"),
        F.size(F.filter(pairs, lambda p: ~legal(p))).cast("long").alias("illegal"), F.col("l")[0].initial.alias("first"), F.element_at("l", -1).initial.alias("last"),
        F.try_element_at("t", F.lit(1)).turn.cast("long").alias("least"), F.try_element_at("t", F.lit(-1)).turn.cast("long").alias("most"), F.when(F.size("t") > 0, changes + 1).otherwise(0).cast("long").alias("turns"),
    )


class Rope:
    """A text made of two others; put together when it is first asked for."""

    __slots__ = ("parts", "text")

    def __init__(self, text: str | None = None, parts: tuple = ()):
        self.text, self.parts = text, parts

    def flat(self) -> str:
        if self.text is None:
            out, open_ = [], [self]
            while open_:
                rope = open_.pop()
                if rope.text is None:
                    open_ += reversed(rope.parts)
                else:
                    out.append(rope.text)
            self.text, self.parts = "".join(out), ()
        return self.text


# Matrices: {(state before, state after): (cost, rope)}.


def _better(a: tuple, b: tuple | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1].flat() < b[1].flat())


def terminal(symbol: str) -> dict:
    """The matrix of one row, with what is inserted before it."""
    out: dict = {}
    cut = CUT_OFF if symbol in "suao" else 0
    for before in range(STATES):
        state = before
        for inserted in range(3):
            edits = {(state, 2, "D")}
            if symbol != "D":
                edits |= {(_STEP[state, r], COST["R"] + cut, "R") for r in "ua" if (state, r) in _STEP}
                if (state, symbol.lower()) in _STEP:
                    edits.add((_STEP[state, symbol.lower()], cut, "K"))
            for after, cost, name in edits:
                way = (COST["I"] * inserted + cost, Rope("I" * inserted + name))
                if _better(way, out.get((before, after))):
                    out[before, after] = way
            state = 3 if state == 2 else 2
    return out


def product(a: dict, b: dict) -> dict:
    out: dict = {}
    for (i, k), (c, x) in a.items():
        for (m, j), (d, y) in b.items():
            if k == m and _better(way := (c + d, Rope(parts=(x, y))), out.get((i, j))):
                out[i, j] = way
    return out


class Grammar:
    """Rules over the terminals, in the order they were made, and the matrix of every symbol."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices = [terminal(t) for t in TERMINALS]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        rules = {}
        for pair in pairs:
            rules[pair] = len(self.matrices)
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        self.rounds.append(rules)

    def rewrite(self, symbols: str) -> list[int]:
        seq = [TERMINALS.index(s) for s in symbols]
        for rules in self.rounds:
            seq = self._once(seq, rules)
        return seq

    @staticmethod
    def _once(seq: list[int], rules: dict) -> list[int]:
        out, i = [], 0
        while i < len(seq):
            new = rules.get((seq[i], seq[i + 1])) if i + 1 < len(seq) else None
            out.append(seq[i] if new is None else new)
            i += 1 if new is None else 2
        return out

    def matrix(self, symbols: str) -> dict:
        """Cost and text of the edits of a piece for each pair of states."""
        row = None
        for s in self.rewrite(symbols):
            row = self.matrices[s] if row is None else product(row, self.matrices[s])
        return {k: (c, x.flat()) for k, (c, x) in (row or {}).items()}


def learn(symbols: DataFrame, *, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND, least: int = LEAST_PAIRS) -> Grammar:
    """Rules for the frequent pairs in all ``symbols``; their number is bounded, so they fit into every task."""
    distinct, grammar = symbols.groupBy("symbols").count(), Grammar()
    for _ in range(rounds):
        sent = symbols.sparkSession.sparkContext.broadcast(grammar)

        def count(batches, sent=sent):
            size = len(sent.value.matrices)
            seen: dict[int, int] = {}
            for batch in batches:
                for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seq, skip = sent.value.rewrite(text), -1
                    for i in range(len(seq) - 1):
                        pair = seq[i] * size + seq[i + 1]
                        if i == skip and seq[i] == seq[i - 1] == seq[i + 1]:
                            continue  # of three alike only one pair can be replaced
                        seen[pair], skip = seen.get(pair, 0) + n, i + 1
            left, right = np.divmod(np.array(list(seen), np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["a", "b", "n"])

        total = distinct.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        picked, used = [], set()
        for a, b, _ in total.orderBy(F.desc("n"), "a", "b").limit(4 * a_round).collect():
            if len(picked) < a_round and not {a, b} & used:
                picked.append((a, b))
                used |= {a, b}
        sent.unpersist()
        if not picked:
            break
        grammar.add(picked)
    return grammar


def judged(cut: DataFrame, grammar: Grammar) -> DataFrame:
    """The pieces with their matrices: costs (null: no way) and edits by 4 * state before + state after."""
    sent = cut.sparkSession.sparkContext.broadcast(grammar)
    names = [*cut.columns, "costs", "edits"]

    def work(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            rows = []
            for text in batch.column("symbols").to_pylist():
                if text not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[text] = sent.value.matrix(text)
                rows.append(known[text])
            places = [(i, j) for i in range(STATES) for j in range(STATES)]
            costs = pa.array([[m[p][0] if p in m else None for p in places] for m in rows], pa.list_(pa.int64()))
            edits = pa.array([[m[p][1] if p in m else None for p in places] for m in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, edits], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.mapInArrow(work, f"{kinds}, costs array<bigint>, edits array<string>")


def _least(ways: list) -> tuple[int, str] | None:
    return min((w for w in ways if w is not None), default=None)


def best(parts: DataFrame) -> DataFrame:
    """Counts, cost and edits of every conversation from its pieces, which one row of it holds in order."""
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", *[c for c in parts.columns if c not in ("conv_id", "piece", "symbols")]))).alias("l"))

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                ways: list = [(0, "")] + [None] * (STATES - 1)
                illegal = sum(p["illegal"] for p in row) + sum(p["last"] + q["first"] not in ("su", "ua", "au") for p, q in zip(row, row[1:]))
                dated = [p for p in row if p["turns"]]
                turns = sum(p["turns"] for p in dated) - sum(p["most"] == q["least"] for p, q in zip(dated, dated[1:]))
                gaps = dated[-1]["most"] - dated[0]["least"] + 1 - turns if dated else 0
                for p in row:
                    ways = [_least([None if w is None or p["costs"][4 * i + j] is None else (w[0] + p["costs"][4 * i + j], w[1] + p["edits"][4 * i + j]) for i, w in enumerate(ways)]) for j in range(STATES)]
                cost, audit = _least([w and (w[0] + COST["I"] * len(_END[i]), w[1] + _END[i]) for i, w in enumerate(ways)])
                out.append((gaps, *(sum(p[k] for p in row) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit))
            columns = [batch.column(0), *(pa.array([r[k] for r in out], pa.string() if k == 6 else pa.int64()) for k in range(7))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit"])

    return listed.mapInArrow(work, f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(originals: DataFrame, rows: DataFrame, *, texts: bool = False) -> DataFrame:
    """One row for each conv_id of ``originals``: counts, cost, edits and hash of the repaired rows of ``rows``; ``texts`` adds them.

    Both have conv_id, turn, role, text; ``rows`` are what is left of ``originals`` and has no nulls in role and text.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    cut = scratch.save(pieces(faults(rows, scratch)), "pieces")
    scratch.drop("placed")
    found = scratch.save(best(judged(cut, learn(cut.select("symbols")))), "edits")
    scratch.drop("pieces")
    # one stream a conversation: a mark that it exists, its edits, its rows in order
    blank = {"turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "hash": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")}
    counts = [*COUNTS, "audit"]
    none = {c: F.lit(None).cast(found.schema[c].dataType) for c in counts}
    marks = originals.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *[v.alias(k) for k, v in (blank | none).items()])
    edits = found.select("conv_id", F.lit(1).alias("kind"), *[v.alias(k) for k, v in blank.items()], *counts)
    lines = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("hash"), "text", *[v.alias(k) for k, v in none.items()])
    stream = marks.union(edits).union(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    own = stream.schema["conv_id"].dataType.simpleString()

    def work(batches):
        out = _Writer(texts)
        for batch in batches:
            yield from out.take(batch)
        yield from out.end()

    kinds = f"conv_id {own}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string" + ", repaired array<struct<role:string,text:string>>" * texts
    return stream.select("conv_id", "kind", *counts, "role", "text").mapInArrow(work, kinds)


class _Writer:
    """Takes the sorted stream batch by batch and writes a conversation's row when the next one begins."""

    def __init__(self, texts: bool):
        self.texts, self.now, self.rows, self.kind = texts, None, [], None

    def take(self, batch):
        kind, self.kind = np.asarray(batch.column("kind")), batch.schema.field("conv_id").type
        heads = np.flatnonzero(kind == 0)
        ids, role, text = batch.column("conv_id"), batch.column("role"), batch.column("text")
        for a, b in zip(np.concatenate([[0], heads]), np.append(heads, len(kind))):
            if a < b and kind[a] == 0:
                self.close()
                self.now = [ids[int(a)].as_py(), [0] * len(COUNTS), "", hashlib.sha256(), 0, 0, [], False]
                a += 1
            if a < b and kind[a] == 1:
                self.now[1], self.now[2] = [batch.column(c)[int(a)].as_py() for c in COUNTS], batch.column("audit")[int(a)].as_py()
                a += 1
            if a < b:
                self.pass_rows(list(zip(role.slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist())))
        if len(self.rows) > 2000:
            yield self.flush()

    def pass_rows(self, rows):
        """Edits up to the last of ``rows``; what is inserted after it waits for the next row or the end."""
        now, taken = self.now, 0
        audit, end = now[2], now[4]
        while taken < len(rows):
            taken += audit[end] != "I"
            end += 1
        self.write(audit[now[4] : end], iter(rows))
        now[4] = end

    def write(self, edits: str, rows):
        now = self.now
        for edit in edits:
            role, text = next(rows) if edit != "I" else (None, "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if now[5] == 2 else "user"
            now[5] = _STEP[now[5], role[0]]
            now[3].update((b"\n" if now[7] else b"") + f"{role}:{text}".encode())
            now[7] = True
            if self.texts:
                now[6].append({"role": role, "text": text})

    def close(self):
        if self.now is not None:
            self.write(self.now[2][self.now[4] :], iter(()))
            conv, counts, audit, sha, _, _, repaired, _ = self.now
            self.rows.append((conv, *counts, audit, sha.hexdigest(), repaired))
            self.now = None

    def flush(self):
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256", "repaired"][: len(COUNTS) + 3 + self.texts]
        kinds = [self.kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], kinds[k]) for k in range(len(names))], names)
        self.rows = []
        return out

    def end(self):
        self.close()
        if self.rows:
            yield self.flush()
