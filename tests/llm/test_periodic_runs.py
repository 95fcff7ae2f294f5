"""Runs of words against the comparison of all pairs, on random and awkward texts."""

import random
from hashlib import sha256

import numpy as np

from keystrata.llm import periodic_runs as op
from keystrata.llm import queries


def planted(r: random.Random) -> list[int]:
    words = [r.randrange(r.randint(1, 3)) for _ in range(r.randint(0, 30))]
    at, loop = r.randrange(len(words) + 1), [r.randrange(4) for _ in range(r.randint(1, 9))]
    return words[:at] + (loop * 12)[: r.randint(0, 70)] + words[at:]


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        docs = [planted(r) for _ in range(r.randint(1, 4))]
        base = np.cumsum([0, *map(len, docs)])
        names, doc = np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), np.diff(base))
        want = sorted((a + base[i], m, q) for i, d in enumerate(docs) for a, m, q in op.brute_force(d))
        assert [tuple(x) for x in op.runs_of(names, doc).tolist()] == want


def expected(doc_id, text):
    words = op.looped(doc_id, (text or "").encode().split())
    runs = op.brute_force(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha256(lines.encode()).hexdigest(), sha256(left).hexdigest())


def test_rows_of_every_kind(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a a a\u000ba\x0ca\ra", "été été été été été été été", "x y " * 40 + "x", "a b c " * 4 + "a b c d", " ".join(map(str, planted(r)))]
    rows = [(i, t, 1) for i, t in enumerate(texts * 30)] + [(5, "a a a a a a", 2), (5, "a a a a a a", 2), (None, "b b b b b b b", 3), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "n_words").repartition(3)
    got = sorted((tuple(x) for x in op.digest(op.find(docs, prepare=op.looped)).collect()), key=repr)
    assert got == sorted((expected(d, t) for d, t, _ in rows), key=repr)
    assert op.digest(op.find(docs.limit(0))).collect() == []


def test_long_texts(spark):
    rows = [(1, "ab " * 2_000_000), (2, " ".join(map(str, range(700_000)))), (3, ("lorem ipsum dolor " * 900 + "x ") * 40)]
    got = {x.doc_id: x for x in op.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 2_000_000, 1)] and got[1].collapsed == "ab"
    assert not got[2].runs and got[2].collapsed == rows[1][1]
    assert (0, 40 * 2701, 2701) in [tuple(x) for x in got[3].runs] and got[3].collapsed == "lorem ipsum dolor x"  # the inner runs take the rest


def test_query_gives_a_row_per_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_periodic_runs(spark, sf).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(x.doc_id for x in rows) == sorted(docs)
    for x in rows:
        if len(docs[x.doc_id]) < 4000:
            assert tuple(x) == expected(x.doc_id, docs[x.doc_id])
