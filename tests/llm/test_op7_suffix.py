"""Repeated byte strings: suffix arrays, and the whole operator against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import op7_suffix as op


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.choice([0, 1, 2, 5, 30, 200]), rng.choice([1, 2, 3, 20])
        t = np.array([rng.randrange(1, k + 1) for _ in range(n)] + [0], np.int16)
        order, values = op.suffix_array(t), t.tolist()
        want = sorted(range(len(values)), key=lambda i: values[i:])
        assert order.tolist() == want
        most = rng.choice([1, 3, 10, 10**6])
        shared = op.permuted_prefixes(t, order, most)
        for a, b in zip(want, want[1:]):
            q = 0
            while values[a + q] == values[b + q]:
                q += 1
            assert shared[b] == min(q, most)


def brute(rows, length):
    first, out = {}, []
    for doc, raw in sorted(rows):
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p: p + length], (doc, p))
    for doc, raw in rows:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if first[raw[p: p + length]] < (doc, p):
                gone[p: p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghijkl é"
    passages = ["".join(rng.choices(letters, k=rng.choice([90, 100, 130, 400]))) for _ in range(6)]
    rows = []
    for i in range(90):
        text = "".join(rng.choices(letters, k=rng.choice([0, 50, 99, 100, 300])))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages) + text[at:]
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
            for _ in range(rng.choice([0, 1, 3])):
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(letters) + text[at + rng.choice([0, 1]):]
        rows.append((i * 8 % 91, text))
    rows += [(200, "x" * 1000), (201, "xy" * 400), (202, "x" * 150), (203, "ab" * 2 + "x" * 99)]
    return rows


@pytest.mark.parametrize("seed, cap", [(1, op.CAP), (2, op.CAP), (4, 1)])
def test_equals_brute_force(spark, seed, cap):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, op.kept(df, digests=True, cap=cap).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute([(i, t.encode()) for i, t in rows], 100)


def test_odd_rows(spark):
    long = "0123456789" * 20
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "q" + long + "r"), (None, None), (9, "abcdefgh" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("id", F.lit(7))
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in op.kept(df).collect()]
    # Of a text of period 10 only the first 10 windows are new, and rows of one id are one document.
    assert [g[1:] for g in got if g[0] == 3] == [(200, 190, long[:10].encode())] * 2
    assert [g[1:3] for g in got if g[0] == 4] == [(202, 200)]
    assert [g for g in got if g[0] == 4][0][3] == b"qr"
    assert sorted(g[2] for g in got if g[0] is None) == [0, 200]
    assert [g[1:] for g in got if g[0] in (1, 2)] == [(0, 0, b"")] * 2
    assert op.kept(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a" * 300, "x", [1, 2]), (2, "b", "y", None)], "doc_id long, text string, `odd name` string, list array<int>")
    got = {r.doc_id: r for r in op.kept(df).collect()}
    assert got[1]["odd name"] == "x" and got[1].list == [1, 2] and (got[1].n_removed, bytes(got[1].kept)) == (299, b"a")
