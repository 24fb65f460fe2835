"""Near-duplicate embeddings against brute force, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from recallspark.llm import blocks, op5_itq as op


def brute(ids, vectors, labels, threshold=0.98):
    v = np.array(vectors, np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    component = np.arange(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            a, b = component[i], component[j]
            if a != b:
                component[component == max(a, b)] = min(a, b)
    return near, component


def test_recall_against_brute_force(spark):
    given = blocks.read(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").limit(1500).collect()
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in given]
    for i in range(1500):
        v = np.array(rows[rng.integers(500)][1])
        noise = rng.normal(size=len(v))
        noise *= np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.05, 0.22)
        rows.append((100_000 + i, (v + noise).tolist(), int(rng.integers(0, 2)) if i % 9 == 0 else rows[0][2]))
    rows = [(i, v, 1 + i % 2 if i < 100_000 else l) for i, v, l in rows]
    near, component = brute([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows]))
    got = {r.vec_id: r for r in op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(r.n_links for r in got.values())
    assert near.sum() >= found >= 0.98 * near.sum() > 500
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    same = np.mean([got[r[0]].component_id == rows[component[i]][0] for i, r in enumerate(rows)])
    assert same >= 0.99


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8), rng.normal(size=8)
    f = lambda v: [float(x) for x in v]
    rows = [(i, f(a), 1) for i in range(1, 40)] + [(50, f(2 * a), 1), (51, f(a), 2), (52, f(a), None), (53, None, 1), (54, [0.0] * 8, 1),
            (55, [float("nan")] + f(a)[1:], 1), (56, [None] + f(a)[1:], 1), (57, f(a)[:7], 1), (58, [], 1), (59, f(b), 1),
            (None, f(a), 1), (60, f(b) , 3), (60, f(b), 3), (61, [float("inf")] * 8, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = op.near_vectors(df).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].n_links == 39 and by[i].component_id == 1 for i in [*range(1, 40), 50])
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61))
    assert by[None].n_links == 0
    assert op.near_vectors(df.limit(0)).count() == 0


def test_rotation_lowers_the_quantisation_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16)) * np.linspace(3, 0.2, 16)
    error = []
    for rounds in (0, 50):
        mean, p = op.learn(x, rounds=rounds)
        y = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ p
        error.append(((y - np.sign(y) * np.abs(y).mean()) ** 2).sum())
        assert np.allclose(p.T @ p, np.eye(16))
    assert error[1] < error[0]


def test_no_join_goes_through_the_driver(spark):
    """A small file of codes becomes 68 rows a code, which were all sent through the driver."""
    made = op.settle(spark.range(200).selectExpr("cast(id % 3 as int) as label", "id as rep", "id * 7919 as code"))
    plan = op.candidates(made, 64, 4, 16)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    vectors = spark.createDataFrame([(i, i % 3, [float(i % 7), 1.0, 0.001 * i]) for i in range(60)], "vec_id long, label int, embedding array<float>")
    plan = op.near_vectors(op.settle(vectors))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
