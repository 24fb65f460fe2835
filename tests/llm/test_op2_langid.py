"""Language identification: code lengths against a plain model, held-out accuracy, odd rows."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recallspark.llm import blocks, op2_langid as op


def plain_bits(train, text, order):
    """Cost of ``text`` by the definition, byte by byte."""
    trees = defaultdict(Counter)
    for t in train:
        b = bytes(order) + t.encode()
        for i in range(order, len(b)):
            for j in range(order + 1):
                trees[b[i - j: i]][b[i]] += 1
    total, b = 0.0, bytes(order) + text.encode()
    for i in range(order, len(b)):
        for j in range(order, -1, -1):
            seen = trees.get(b[i - j: i])
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    train = {"aa": ["the cat sat on the mat", "that hat"], "bb": ["le chat est là", ""]}
    rows = [(t, code) for code, texts in train.items() for t in texts] + [(None, "aa"), ("x", None)]
    prices = op.fit(spark.createDataFrame(rows, "text string, lang string"))
    tests = ["the chat", "là", "zzz€", "t"]
    buf, offs = blocks.flat(__import__("pyarrow").array(tests))
    got = prices.bits(buf, offs)
    for i, text in enumerate(tests):
        for j, code in enumerate(prices.langs):
            assert math.isclose(got[i, j], plain_bits(train[code], text, op.ORDER), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    docs = blocks.read(spark, "/root/testdata/sf0.01", "documents")
    got = op.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    right = got.where("held_out and n >= 50").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.count() == docs.count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows(spark):
    model = op.fit(spark.createDataFrame([("abc abd", "x"), ("éèê", "y")], "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "12 .."), (4, "abc"), (4, "abc"), (None, "é"), (6, "a" * 3_000_000)]
    got = op.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "y"), (1, "und"), (2, "und"), (3, "und"), (4, "x"), (4, "x"), (6, "x")]
    assert op.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = op.fit(spark.createDataFrame([], "text string, lang string"))
    assert [(r.lang_pred, r.score) for r in op.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == [("und", 0.0)]


def test_bounded_trees_keep_parents(spark):
    rows = [("abcabcabd xyz", "x"), ("qrsqrs", "y")]
    df = spark.createDataFrame(rows, "text string, lang string")
    small = op.fit(df, max_nodes=12)
    got = op.predict(spark.createDataFrame([(1, "abc"), (2, "qrs")], "doc_id long, text string"), small).collect()
    assert all(0 <= r.score <= 1 for r in got)


def test_large_trees_price_every_context(spark):
    rows = [("the cat sat on the mat, that hat " * 50, "aa"), ("le chat est là et la chatte aussi", "bb"), ("abcabcabd xyz é", "cc")]
    df = spark.createDataFrame(rows, "text string, lang string")
    texts = ["the chatte", "là aussi", "zzz€", "xyz abd", "é 1", "the hat " * 300, "", None, "12"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "chat")], "doc_id long, text string")
    whole, stored = op.fit(df), op.fit(df, max_nodes=30)
    want, got = ({r.doc_id: r for r in op.predict(asked, m).collect()} for m in (whole, stored))
    assert got.keys() == want.keys() and len(got) == 10
    for i, r in want.items():
        assert got[i].lang_pred == r.lang_pred and math.isclose(got[i].bits, r.bits, rel_tol=1e-9) and math.isclose(got[i].score, r.score, rel_tol=1e-6)
