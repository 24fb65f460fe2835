"""Delivery once per destination, routing tables, and jobs whose detail fails late."""

from pyspark.sql import functions as F

from recallspark.operators import fusion, outbox
from recallspark.plans import jobs
from recallspark.schema import TABLES
from recallspark.sources import snapshots

NOW = "2026-01-01T00:00:00Z"
SORTED = "id bigint, project_id string, memory_id string, name string, remote string, queued_at string, attempts int, action string, last_error string"


def test_delivery_happens_once(spark, tmp_path):
    def rows(*given):
        return spark.createDataFrame([(i, p, m, m, r, q, 0, a, None) for i, p, m, r, q, a in given], SORTED)

    url = f"{tmp_path}/a"
    remotes = spark.createDataFrame([("a", url, "", True, NOW, None, "old"), ("b", "nowhere://b", "", True, NOW, None, None)], TABLES["remotes"])
    bodies = spark.createDataFrame([(p, m, f"{p} {m}") for p in "pq" for m in ("m1", "m2")], "project_id string, memory_id string, body string")
    # One record id in two projects; the second is held back.
    queue = rows((1, "p", "m1", "a", "d1", "send"), (2, "q", "m1", "a", "d1", "hold"), (3, "p", "m2", "b", "d1", "send"), (4, "q", "m2", "a", "d1", "send"))
    failed, outcome = outbox.deliver(queue, bodies, remotes, "r1", NOW)
    assert outcome["a"] is None and outcome["b"] and [r.id for r in failed.collect()] == [3]
    assert {r.body for r in outbox.delivered(spark, url).collect()} == {"p m1", "q m2"}
    left = {r.id: (r.attempts, r.last_error) for r in outbox.after_delivery(queue, failed).collect()}
    assert left == {2: (0, None), 3: (1, outcome["b"])}
    stamps = {r.name: (r.last_ok, r.last_error) for r in outbox.stamped(remotes, outcome, NOW).collect()}
    assert stamps == {"a": (NOW, None), "b": (None, outcome["b"])}
    for run in ("r1", "r2"):  # the same run, and a later one over a queue that was never put back
        outbox.deliver(queue, bodies, remotes, run, NOW)
        assert outbox.delivered(spark, url).count() == 2
    more = queue.where("remote = 'a'").union(rows((5, "p", "m2", "a", "d2", "send"), (1, "p", "m1", "a", "d2", "send")))
    outbox.deliver(more, bodies, remotes, "r1", NOW)  # the id was used, the rows are new or were asked for again
    assert sorted((r.id, r.queued_at) for r in outbox.delivered(spark, url).collect()) == [(1, "d1"), (1, "d2"), (4, "d1"), (5, "d2")]
    bodies.write.parquet(f"{url}/run=unfinished")
    assert outbox.delivered(spark, url).count() == 4


def test_bodies_are_read_once_for_all_remotes(spark, tmp_path):
    """Each remote read the bodies of all records."""
    met = spark.sparkContext.accumulator(0)

    def seen(body):
        met.add(1)
        return body

    queue = spark.createDataFrame([(i, "p", f"m{i % 3}", "", r, "d", 0, "send", None) for i, r in enumerate("aabbc")], SORTED)
    remotes = spark.createDataFrame([(r, f"{tmp_path}/{r}", "", True, NOW, None, None) for r in "abc"], TABLES["remotes"])
    bodies = spark.createDataFrame([("p", f"m{i}", f"body {i}") for i in range(3)], "project_id string, memory_id string, body string")
    bodies = bodies.withColumn("body", F.udf(seen, "string").asNondeterministic()("body"))
    failed, outcome = outbox.deliver(queue, bodies, remotes, "r1", NOW)
    assert failed.isEmpty() and outcome == {"a": None, "b": None, "c": None} and met.value == 3
    held = {r: sorted((x.id, x.remote, x.body) for x in outbox.delivered(spark, f"{tmp_path}/{r}").collect()) for r in "abc"}
    assert held == {"a": [(0, "a", "body 0"), (1, "a", "body 1")], "b": [(2, "b", "body 2"), (3, "b", "body 0")], "c": [(4, "c", "body 1")]}
    assert outbox.deliver(queue.limit(0), bodies, remotes, "r2", NOW)[1] == {}


def test_the_complete_ranking_names_every_open_remote(spark):
    records = spark.createDataFrame([("p", "m", "pump drift", [], []), ("q", "m", "nothing", [], [])],
                                    "project_id string, memory_id string, description string, triggers array<string>, labels array<string>")
    remotes = spark.createDataFrame([("a", "other", True), ("b", "drift", True), ("c", "pump drift", False), ("d", "valves", True)], "name string, description string, enabled boolean")
    used = spark.createDataFrame([("p", "m", "d"), ("p", "m", "c")], "project_id string, memory_id string, name string")
    chosen = fusion.choose_remote(records, remotes, consulted=used)
    assert sorted((r.project_id, r.place, r.name) for r in chosen.collect()) == [("p", 1, "d"), ("p", 2, "b")]
    every = sorted((r.project_id, r.place, r.name) for r in fusion.complete(chosen, remotes, records).collect())
    assert every == [("p", 1, "d"), ("p", 2, "b"), ("p", 3, "a"), ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "d")]


def test_a_detail_that_fails_late_is_logged(spark, monkeypatch):
    def late(tables, now):
        rows = spark.createDataFrame([("p", "x")], "project_id string, detail string")
        return tables, rows.withColumn("detail", F.raise_error(F.lit("boom")).cast("string"))

    monkeypatch.setitem(jobs.JOBS, "audit", late)
    tables = {"cached": snapshots.empty(spark, "cached")}
    log = {r.kind: (r.outcome, r.detail) for r in jobs.run(spark, tables, ["audit", "evict"], NOW)["jobs"].collect()}
    assert log["audit"][0] == "failed" and "boom" in log["audit"][1] and log["evict"][0] == "done"
