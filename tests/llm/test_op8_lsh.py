"""Multiprobe search: recall against brute force, exact scores and ties, hot buckets, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.llm import blocks, op8_lsh as op


def brute(rows, asked, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in asked:
        score = (x * x[ids == i][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def ranked(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in blocks.read(spark, path, "embeddings").collect()]
    got = ranked(op.query(spark, path).collect())
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want])
    assert recall >= 0.95
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(s == exact[q, i] for q, best in got.items() for i, s in best if (q, i) in exact)
    assert all(list(v) == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_uneven_norms_and_a_hot_bucket(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 5)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 20, 40, 1000]
    got = ranked(op.nearest(df, df.where(F.col("vec_id").isin(asked)), rows_per_bin=50).collect())
    want = brute(rows, asked, 20)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and [i for i, _ in got[1000]] == [i for i, _ in want[1000]]
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in asked]) >= 0.9


def test_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v), (1, v), (2, [2.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, v), (9, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ranked(op.nearest(df, df).collect())
    assert got == {1: [(2, 4.0), (9, 0.0)], 2: [(1, 4.0), (9, -1.5)], 9: [(1, 0.0), (2, -1.5)]}
    assert op.nearest(df.limit(0), df.limit(0)).count() == 0


def test_sampled_queries_and_few_copies_of_a_large_table(spark):
    rng = np.random.default_rng(11)
    n, d = 100_000, 16
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hashed = spark.range(n).select("id").orderBy(F.xxhash64("id"), "id").limit(4096).collect()
    sampled = [r.id for r in hashed[:60]]
    others = [i for i in range(0, n, 1999) if i not in sampled]
    copied = [r.id for r in hashed[100:140]]
    for at, i in enumerate(copied):  # four copies each, some of them in any sample that takes small hashes
        for j in [hashed[200 + at].id, hashed[300 + at].id, 7 + 3 * i % 90_000, 11 + 7 * i % 90_000]:
            x[j] = x[i]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(8)
    asked = sampled + others + copied
    got = ranked(op.nearest(df, df.where(F.col("vec_id").isin(asked))).collect())
    recall = {}
    for q in asked:
        score = x @ x[q]
        score[q] = -9
        least = np.partition(score, n - 20)[n - 20]
        recall[q] = sum(s >= least - 1e-9 for _, s in got.get(q, [])) / 20
    means = [np.mean([recall[q] for q in group]) for group in (sampled, others, copied)]
    assert min(means) >= 0.95, means


def test_all_candidates_where_there_are_few(spark):
    rng = np.random.default_rng(3)
    for n in (15, 21):
        rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = ranked(op.nearest(df, df).collect())
        want = brute(rows, range(n), 20)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    stranger = spark.createDataFrame([(99, [-x for x in rows[0][1]])], "vec_id long, embedding array<double>")
    assert len(ranked(op.nearest(df.limit(19), stranger).collect())[99]) == 19


def test_a_query_with_empty_cells_meets_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.array([1.0, 0, 0, 0]) + 0.01 * rng.normal(size=4)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    far = [(500, [-1.0, 0.1, 0.0, 0.2]), (501, [1.0, 0.0, 0.0, 0.0])]
    got = ranked(op.nearest(df, spark.createDataFrame(far, "vec_id long, embedding array<double>"), rows_per_bin=100, reach=0.01).collect())
    want = brute(rows + far, [500, 501], 22)
    for q in (500, 501):
        assert len(got[q]) == 20
    assert [i for i, _ in got[500]] == [i for i, _ in want[500] if i < 500][:20]
