"""Repaired conversations against a search over all edits."""

import heapq
import random
import re
from hashlib import md5, sha256
from zlib import crc32

import pytest

from keystrata.llm import conversation_repair as op
from keystrata.llm import queries

KINDS = "conv_id long, turn long, role string, text string, audit string, kind int"
WHITE = " \t\n\x0b\x0c\r"


def by_hand(rows):
    """The damage, row by row."""
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        h = crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def search(rows):
    """Cheapest edits, the least text of them, and the repaired rows: Dijkstra over (rows read, initials so far)."""
    heap, done = [(0, "", 0, 0, ())], set()
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done and i < len(rows):
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        done.add((i, state))
        for full, initial in (("user", "u"), ("assistant", "a")):
            if (state, initial) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, initial], (*out, (full, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[state, role[:1]], (*out, (role, text))))
                for full, initial in (("user", "u"), ("assistant", "a")):
                    if (state, initial) in step:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, step[state, initial], (*out, (full, text))))


def expected(rows, originals):
    found = {}
    for conv in {r[0] for r in originals}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3].encode()).digest()))
        seen, judged = set(), []
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, out = search(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (conv, gaps, *(sum(j[2] == k for j in judged) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return sorted(found.values(), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], KINDS).repartition(3)


def conversations(seed, convs, longest):
    r, out = random.Random(seed), []
    for c in range(convs):
        texts = ["Hello.", "And you?", "Cut off", "", " \n", None, "Yes!", "été.", f"only {c}."] + [f"own {k}." for k in range(8)]
        usual = r.random() < 0.6
        for t in range(r.randint(1, longest)):
            role = ("user", "assistant")[t % 2] if usual and r.random() < 0.9 else r.choice(["user", "assistant", "system", "tool", None, "", "user"])
            out.append((c if c else None, r.choice([t, t, t, t + 3, None]), role, r.choice(texts)))
    return out + out[:5]


@pytest.mark.parametrize("bits", [op.PIECE_BITS, 1])
def test_repair_equals_search(spark, monkeypatch, bits):
    monkeypatch.setattr(op, "PIECE_BITS", bits)
    rows = conversations(1, 60, 9) + [(1000 + k, 0, "user", "Gone.") for k in range(40)]  # some lose their only row
    df = table(spark, rows)
    assert sorted((tuple(x) for x in op.repair(df, op.damaged(df)).collect()), key=repr) == expected(list(by_hand(rows)), rows)


def test_undamaged_rows_and_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (2, 5, "user", "No answer."), (3, 1, "tool", "")]
    df = table(spark, rows)
    got = {x.conv_id: x for x in op.repair(df, df.select("conv_id", "turn", "role", "text"), texts=True).collect()}
    assert got[3].audit == "D" and not got[3].repaired and got[3].repaired_sha256 == sha256(b"").hexdigest()
    assert got[2].audit == "D" and got[2].cost == 2
    assert (got[1].audit, [tuple(r) for r in got[1].repaired]) == ("DDD", []) or [r.role[0] for r in got[1].repaired] in (["s", "u", "a"], ["u", "a"])
    assert sorted((tuple(x)[:-1] for x in got.values()), key=repr) == expected(rows, rows)


def test_empty_table(spark):
    df = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert op.repair(df, op.damaged(df)).collect() == []


def test_one_long_conversation(spark):
    r = random.Random(7)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), f"line {t if r.random() < 0.9 else 3}{r.choice(['.', '.', ''])}") for t in range(3000)]
    df = table(spark, rows)
    assert [tuple(x) for x in op.repair(df, op.damaged(df)).collect()] == expected(list(by_hand(rows)), rows)


def test_rules_are_shared_and_exact(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("UAUAUAuaDSO") for _ in range(r.randint(1, 60))) for _ in range(200)] + ["UAUAUAUA"] * 50
    symbols = spark.createDataFrame([(t,) for t in texts], "symbols string")
    grammar = op.learn(symbols, rounds=6, a_round=5)
    assert len(grammar.matrices) > len(op.TERMINALS) + 6
    plain = op.Grammar()
    for t in texts:
        assert len(grammar.rewrite(t)) <= len(t) and grammar.matrix(t) == plain.matrix(t)
    assert len(grammar.rewrite("UAUAUAUA")) <= 2


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(x) for x in queries.op13_conversation_repair(spark, sf).collect()), key=repr)
    assert got == expected(list(by_hand(rows)), rows)
