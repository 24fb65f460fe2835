"""Systematic mixing: targets, counts against a plain running sum, skew and odd rows."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recallspark.llm import op6_mixing as op, ranks


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        full |= set(over)


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), ["a", "b", "c", "d", None][min(i % 11, 4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = op.mix(df).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r._source]) and r.source_size == sizes[r._source]
        assert r.copies <= 2
        taken[r._source] += r.copies * r.size
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * 23
    assert sorted(map(tuple, got)) == sorted(map(tuple, op.mix(df.repartition(3)).collect()))


def test_running_sum_by_hand(spark):
    rows = [(i, "x " * (i % 5 + 1), "s") for i in range(40)] + [(100 + i, "y", "t") for i in range(4)]
    got = {r._key: r for r in op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    u = int(hashlib.md5(b"mix:s:s").hexdigest()[:8], 16) / 2**32
    for p, (i, _, _) in enumerate(sorted(rows[:40], key=lambda r: (len(r[1]), int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % 8, r[0]))):
        rate = got[i].target / got[i].source_size
        assert got[i].copies == math.floor((p + 1) * rate + u) - math.floor(p * rate + u)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (5, " \t\n", "c"), (6, "k " * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = op.mix(df).collect()
    assert len(got) == len(rows)
    assert {r._source: r.target for r in got} == pytest.approx(plain_targets({"a": 0, "b": 100_001, "c": 0, None: 4}))
    assert op.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_positions_in_hot_groups(spark):
    rows = [(i % 2, 7, i) for i in range(3000)] + [(0, i % 50, i) for i in range(3000, 3500)] + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "g long, v long, id long").repartition(4)
    got = ranks.numbered(df, ["g"], ["v"], [F.col("id")], F.coalesce(F.col("id"), F.lit(0)), len(rows)).collect()
    for g in (0, 1, None):
        mine = sorted((r.position, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted((v for _, v in mine), key=lambda v: (v is None, v))
    assert len(got) == len(rows) and not re.search("_", ",".join(got[0].__fields__))
