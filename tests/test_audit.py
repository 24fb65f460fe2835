import pytest
from pyspark.sql import functions as F

from recallspark.operators import audit, records
from recallspark.schema import RecallError

NOW = "2026-01-01T00:00:00Z"
EASY = audit.Policy(gates=(audit.Gate(1, 5, 0),))
RECORDS = ("project_id string, memory_id string, slug string, status string, tier int, tier_since string, "
           "tier_since_query bigint, created string, archived_at string")
USAGE = ("project_id string, memory_id string, replica_id string, surfaced bigint, surfaced_direct bigint, applied bigint, "
         "last_surfaced string, last_applied string, spread_bits bigint, spread_epoch bigint")
EDGES = "project_id string, src string, dst string, kind string"


def run(spark, rows, policy=EASY, usage=(), edges=(), queries=10):
    own = spark.createDataFrame(
        [("p", r[0], r[0], r[1] if len(r) > 1 else "active", 1, "2020-01-01T00:00:00Z", 0, None, r[2] if len(r) > 2 else None)
         for r in rows], RECORDS)
    used = spark.createDataFrame([("p", m, "r", s, d, a, None, None, b, 1000) for m, s, d, a, b in usage], USAGE)
    links = spark.createDataFrame([("p", *e) for e in edges], EDGES)
    projects = spark.createDataFrame([("p", queries)], "project_id string, queries bigint")
    found = audit.findings(own, used, links, projects, NOW, policy)
    return own, found, {r["slug"]: r for r in found.collect()}


def test_evidence_that_keeps_a_record(spark):
    _, _, got = run(spark, [(x,) for x in "abcdefg"], usage=[
        ("a", 3, 1, 0, 1), ("b", 0, 0, 1, 1), ("c", 2, 0, 0, 0b11), ("d", 9, 0, 0, 1)],
        edges=[("a", "e", "related"), ("b", "e", "related"), ("a", "f", "derived"), ("b", "f", "derived")])
    assert {k: v["verdict"] for k, v in got.items()} == {
        "a": "promote", "b": "promote", "c": "promote", "e": "promote", "d": "hold", "f": "archive", "g": "hold"}
    assert got["a"]["reason"] == "matched a query directly 1x"
    assert got["d"]["reason"] == "would archive, held back by the per-run cap of 1"
    assert got["f"]["reason"] == ("no direct match, no applied use, no spread, no incoming links "
                                  "after 10 queries and 2192 days")


@pytest.mark.parametrize("policy,archived", [
    (dict(max_actions_per_run=3, max_action_fraction=1.0), 3), (dict(max_actions_per_run=50, max_action_fraction=0.2), 2)])
def test_cap(spark, policy, archived):
    from dataclasses import replace

    _, found, got = run(spark, [(f"m{i}",) for i in range(10)], replace(EASY, **policy))
    assert sum(v["verdict"] == "archive" for v in got.values()) == archived
    row = audit.summary(found).head()
    assert (row["capped"], row["archived"], row["due"], row["examined"]) == (10 - archived, archived, archived, 10)


@pytest.mark.parametrize("size,policy,cap", [
    (10, (50, 0.2), 2), (100, (5, 0.2), 5), (1, (50, 0.1), 1), (1000, (50, 0.1), 50)])
def test_cap_values(spark, size, policy, cap):
    p = audit.Policy(max_actions_per_run=policy[0], max_action_fraction=policy[1])
    assert spark.range(1).select(p.cap(F.lit(size)).alias("c")).head()["c"] == cap


def test_deletion_needs_a_standing_successor(spark):
    from dataclasses import replace

    policy = replace(EASY, delete_superseded=True, max_action_fraction=1.0)
    link = [("new", "old", "supersedes")]
    assert run(spark, [("old", "superseded"), ("new",)], policy, edges=link)[2]["old"]["verdict"] == "delete"
    for rows, rule in [
        ([("old", "superseded"), ("new", "wrong")], policy),
        ([("old", "superseded"), ("new", "active", NOW)], policy),
        ([("old", "superseded"), ("new",)], EASY),
    ]:
        assert run(spark, rows, rule, edges=link)[2]["old"]["verdict"] != "delete"


def test_applying_twice_changes_nothing_more(spark):
    from dataclasses import replace

    policy = replace(EASY, max_action_fraction=1.0)
    own, found, _ = run(spark, [("a",), ("b",)], policy, usage=[("a", 1, 1, 0, 1)])
    after, gone = records.apply_audit(own, found, NOW)
    state = {r["slug"]: r for r in after.collect()}
    assert state["a"]["tier"] == 2 and state["a"]["tier_since_query"] == 10 and state["b"]["archived_at"] == NOW
    used = spark.createDataFrame([("p", "a", "r", 1, 1, 0, None, None, 1, 1000)], USAGE)
    again = audit.findings(after, used, spark.createDataFrame([], EDGES),
                           spark.createDataFrame([("p", 10)], "project_id string, queries bigint"), NOW, policy)
    assert {r["verdict"] for r in again.collect()} == {"hold"} and gone.isEmpty()


def test_gates():
    assert audit.gates_from(["1:5:0", "4:9:9"]) == (
        audit.Gate(1, 5, 0), audit.Gate(2, 500, 180), audit.Gate(3, 600, 365), audit.Gate(4, 9, 9))
    for bad in ("1:2", "a:1:2", "0:1:1", "1:-1:1"):
        with pytest.raises(RecallError):
            audit.gates_from([bad])
    assert audit.Policy().with_overrides(min_degree=None, min_applied=3).min_applied == 3


def test_bad_stamps_are_no_age(spark):
    from recallspark.functions.stamps import age_days, within_skew

    rows = [("2025-12-31T00:00:01Z",), ("2025-12-30T23:59:59Z",), ("junk",), (None,), ("2027-01-01T00:00:00Z",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(age_days(F.col("t"), NOW)).collect()] == [0, 1, 0, 0, 0]
    df = spark.createDataFrame([("2026-01-01T00:05:00Z",), ("2026-01-01T00:05:01Z",), (None,)], "t string")
    assert [r[0] for r in df.select(within_skew(F.col("t"), NOW, 300)).collect()] == [True, False, False]


def test_report(spark):
    _, found, _ = run(spark, [("a",), ("b",)])
    text = audit.report(found, "p")
    assert "2 records, 10 queries served" in text and "archive:" in text
    runs = spark.createDataFrame([("p/1", "p", "1"), ("p/2", "p", "2")], "run_id string, project_id string, started string")
    log = found.withColumn("run_id", F.lit("p/2")).unionByName(found.withColumn("run_id", F.lit("p/1")))
    assert {r["run_id"] for r in audit.last_run(runs, log, ["archive"]).collect()} == {"p/2"}
