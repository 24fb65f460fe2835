"""Toxicity: restored readings, held-out accuracy, disguises, odd rows."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.llm import blocks, op10_toxicity as op

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    held = blocks.remainder(F.col("doc_id"), 4) == 2
    return op.fit(blocks.read(spark, SF, "documents"), blocks.read(spark, SF, "labels").where(~held))


def test_held_out(spark, model):
    docs, labels = blocks.read(spark, SF, "documents"), blocks.read(spark, SF, "labels")
    held = blocks.remainder(F.col("doc_id"), 4) == 2
    got = op.score(docs, model).join(labels, "doc_id").where(held)
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit / (hit + missed) > 0.85 and wrong / (wrong + n[(0, 0)]) < 0.02


def test_disguises_score_like_the_plain_word(spark, model):
    words = ["idiot", "1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "p4th3t1c", "$cum", "st*pid", "d-i-s-g-u-s-t-i-n-g", "looooser"]
    clean = "the and of that ererou to shre as reontioned"
    rows = [(i, f"{clean} {w}! {clean}") for i, w in enumerate(words)] + [(99, clean)]
    got = {r.doc_id: r for r in op.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].predicted == 1 for i in range(len(words))), [words[i] for i in range(len(words)) if not got[i].predicted]
    assert got[99].predicted == 0
    read = op.restore(spark.createDataFrame(rows[:3], "doc_id long, text string"), model.bits).collect()
    assert all("idiot" in r.words for r in read)


def test_spelled_words_beside_lone_letters_and_each_other(spark, model):
    clean = "the and of that ererou to shre as reontioned"
    texts = {"such a i d i o t": "idiot", "I i d i o t": "idiot", "i d i o t I": "idiot", "i d i o t s c u m": "idiot", "s c u m i d i o t": "scum", "a 1 d 1 0 t": "idiot"}
    rows = [(i, f"{clean} {x} {clean}") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = {r.doc_id: r.words for r in op.restore(df, model.bits).collect()}
    assert all(w in words[i] for i, w in enumerate(texts.values())), words
    assert all(r.predicted == 1 for r in op.score(df, model).collect())
    short = op.restore(spark.createDataFrame([(1, f"{clean} a s s {clean}"), (2, "4 5 5")], "doc_id long, text string"), model.bits).collect()
    assert "ass" in {r.doc_id: r.words for r in short}[1] and "ass" not in {r.doc_id: r.words for r in short}[2]


def brute(bits, word):
    """Cheapest reading by trying every one of a short word without repeats."""
    options = [[(c, 0.0)] if c.isalpha() else
               [(r, op.SUBSTITUTE) for r in op.LEET.get(c, "")] + [("", op.DROP_SYMBOL if c in op.LEET else op.DROP_SEPARATOR)] for c in word]
    best = None
    for path in itertools.product(*options):
        cost, a, b = sum(p[1] for p in path), 0, 0
        for r, _ in path:
            if r:
                c = ord(r) - 96
                cost, a, b = cost + bits[a][b][c], b, c
        cost += bits[a][b][0]
        if best is None or cost < best[0] - 1e-12:
            best = (cost, "".join(r for r, _ in path))
    return best[1]


def test_viterbi_is_the_cheapest_reading(model):
    decoder = op.Decoder(model.bits)
    for word in ["1d10t", "s1l3n+", "c.a.t", "b*rn", "0n1y", "h3@t"]:
        assert decoder.restore(word.encode()).decode() == brute(model.bits, word)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "   "), (4, "4 5 6 %%% ***"), (4, "4 5 6 %%% ***"), (None, "idiot"), (6, "ab1" * 40_000), (7, "a " * 50_000), (8, "é è à ù ê")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = op.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert op.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in op.score(docs, op.fit(docs, none)).collect()] == [0.0, 0.0]
    twice = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r.doc_id: r._y for r in op.labelled(docs, twice, 10).collect()} == {1: 1}


def test_rising_steps():
    got = op.rising(np.array([0, 5, 1, 9.0]), np.array([10, 10, 10, 10.0]))
    assert (np.diff(got) >= 0).all() and got[0] < 0.05 and got[-1] > 0.8


def test_only_texts_go_to_python_and_little_is_held(spark, model):
    """Rows stay beside their score, whatever else they hold, and working arrays do not grow with a batch."""
    rows = [(i, f"the and of that {w}", "x" * 100) for i, w in enumerate(["idiot", "ererou", "1d10t"])] + [(3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    left = docs.where(op.judge(spark, model)(F.col("text"))["score"] < op.THRESHOLD)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [run(text#" in plan and "MapInArrow" not in plan
    assert sorted(left.collect()) == [r for r in rows if r[0] in (1, 3)]
    texts = pa.array([("the and of that ererou to shre " * 60) + str(i) for i in range(4_000)])
    next(op.found(iter([texts.slice(0, 500)]), model))  # what a process makes once
    tracemalloc.start()
    found = next(op.found(iter([texts]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4_000 and peak < 30e6, peak


def test_features_counted_in_parts(spark, model, monkeypatch):
    docs = spark.createDataFrame([(f"word{i % 7} other{i % 3} word{i % 7}", i % 2) for i in range(200)], "text string, y int")
    want = sorted(op.feature_counts(docs, "text", "y", model.bits).collect())
    monkeypatch.setattr(op, "COUNTED", 40)
    monkeypatch.setattr(op, "TOGETHER", 100)
    assert want and sorted(op.feature_counts(docs, "text", "y", model.bits).collect()) == want
