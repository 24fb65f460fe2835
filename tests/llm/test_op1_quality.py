"""Quality: accuracy, shrinkage against plain sums, own labels left out, odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import blocks, op1_quality as op

SF = "/root/testdata/sf0.1"


def test_tells_good_from_bad(spark):
    docs, labels = blocks.read(spark, SF, "documents"), blocks.read(spark, SF, "labels")
    held = blocks.remainder(F.col("doc_id"), 3) == 1
    got = op.score(docs, labels.where(~held), F.col("source"), F.col("lang")).join(labels.where(held), "doc_id").select("score", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert op.query(spark, SF).count() == docs.count()


def test_site_rates_by_hand(spark):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(900):
        host = f"h{i % 7}"
        rows.append((i, "some words here", host, f"p{i % 3}" if host != "h6" else None))
        if i % 4:
            marks.append((i, int(rng.random() < (0.1 if host in ("h0", "h1") else 0.8))))
    marks = [m for m in marks if rows[m[0]][2] != "h5"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r.doc_id: r for r in op.score(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    y = dict(marks)
    host_n, host_pos, n, pos = (defaultdict(int) for _ in range(4))
    for i, _, h, p in rows:
        if i in y:
            host_n[h] += 1
            host_pos[h] += y[i]
            n[h, p] += 1
            pos[h, p] += y[i]
    base = (sum(y.values()) + 0.5) / (len(y) + 1)
    k, total = len(host_n), len(y)
    m = base * (1 - base)
    between = sum(host_n[h] * (host_pos[h] / host_n[h] - base) ** 2 for h in host_n)
    spread = (between - k * m) / (total - sum(v * v for v in host_n.values()) / total)
    a = min(max(m / spread - 1, op.WEAKEST), op.STRONGEST)
    assert a < 20  # hosts differ, so their own labels weigh
    for i, _, h, p in rows:
        own, mine = int(i in y), y.get(i, 0)
        host_rate = (host_pos[h] - mine + a * base) / (host_n[h] - own + a)
        assert got[i].n_site == n[h, p] - own
        low, high = sorted((host_rate, (pos[h, p] - mine) / (n[h, p] - own) if n[h, p] > own else host_rate))
        assert low - 1e-9 <= got[i].site_rate <= high + 1e-9
        if h == "h5":
            assert got[i].site_rate == pytest.approx(base)


def test_logistic_finds_the_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(op.logistic(x, y, ridge=1e-6), [2, -1, 0.5], atol=0.15)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (3, "x " * 200_000, "a", "p"), (3, "x", "a", "p"), (None, "y", "b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")):
        got = op.score(docs, labels, F.col("host"), F.col("path")).collect()
        assert len(got) == len(rows) and all(0 < r.score < 1 and math.isfinite(r.site_rate) for r in got)
    assert op.score(docs.limit(0), none, F.col("host"), F.col("path")).count() == 0


def test_addresses(spark):
    df = spark.createDataFrame([("https://a.b.c/en/7?x#y",), ("http://q",), ("nothing",), (None,)], "u string")
    host, path = op.url_parts(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("a.b.c", "/en"), ("q", ""), ("", ""), (None, None)]
