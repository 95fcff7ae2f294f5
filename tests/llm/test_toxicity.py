"""Toxicity: the automata against plain edit distances, the learned terms on held-out rows, awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import queries
from keystrata.llm import toxicity as op


def edit_row(a: str, b: str) -> list[int]:
    """Edits, swaps of neighbours counted as one, between ``a`` and every beginning of ``b``."""
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1]


def block(text: str) -> op.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return op.Words(data, np.array([0, len(data)]))


def test_automata_equal_edit_distances():
    r = random.Random(1)
    for _ in range(40):
        terms = sorted({"".join(r.choice("abé") for _ in range(r.randint(4, 10))) + r.choice([" ", ""]) for _ in range(8)})
        words = ["".join(r.choice("abéd") for _ in range(r.randint(1, 12))) for _ in range(200)]
        hits, term, d = op.Trie(terms).matches(block(" ".join(words)))
        got = {i: (e, k) for i, e, k in zip(hits.tolist(), term.tolist(), d.tolist())}
        for i, w in enumerate(words):
            near = []
            for e, t in enumerate(terms):
                body = t.rstrip()
                k = edit_row(body, w)[-1] if t != body else min(edit_row(body, w))
                if k <= op.edits(len(body), t == body):
                    near.append((k, -len(body), e))
            assert got.get(i) == ((min(near)[2], min(near)[0]) if near else None), (w, terms)


def test_words_are_folded():
    words = block("Idi0t ÉTÉ 2024 $cum don't")
    text = words.text()
    assert [text[a:b] for a, b in zip(words.starts, words.stops)] == ["idiot", "été", "2024", "cum", "don", "t"]


TERMS = "blockhead nincompoop numbskull".split()


def labelled(n: int):
    r = random.Random(4)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("aeioustrn") for _ in range(r.randint(2, 9))) for _ in range(60)]
        if i % 3 == 0:
            for t in TERMS:
                words[r.randrange(60)] = t
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_misspelled_and_quoted_terms(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = op.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert {t.strip() for t in model.trie.terms} >= set(TERMS)
    fill = "sat near sound iron roast tea " * 8
    cases = {1: fill + "you blokchead and nincompop " + fill, 2: fill, 3: None, 4: "", 5: fill + 'he said "blockhead" once ' + fill, 6: fill + "blockhead numbskull " + fill, 7: fill + "bl0ckhead numbskulll nincompoop", 8: "§" * 50_000}
    got = {r.doc_id: r for r in op.score(spark.createDataFrame([(i, t) for i, t in cases.items()] + [(None, fill), (2, fill)], "doc_id long, text string"), model, matches_too=True).collect()}
    assert {i: got[i].score >= op.THRESHOLD for i in cases} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False}
    assert got[5].score < got[6].score and [cases[1][m.start : m.end] for m in got[1].matches] == ["blokchead", "nincompop"]
    assert got[3].score == got[4].score == got[2].score == got[None].score


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in op.score(docs, op.fit(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert {r.score for r in op.score(docs, op.fit(docs, one)).collect()} == {1.0}
    assert op.score(docs.limit(0), 0.0).collect() == []


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_toxicity(spark, sf)
    known = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in known.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
    assert rows.agg(F.min("score") >= 0, F.max("score") <= 1, F.count("*")).first() == (True, True, spark.read.parquet(f"{sf}/documents.parquet").count())
