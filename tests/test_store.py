import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallspark.operators import cache, fusion, index, messages, records, search, validate
from recallspark.plans import jobs
from recallspark.plans.store import Store
from recallspark.schema import DOCUMENT_DDL, TABLES, RecallError
from recallspark.sources import exchange, snapshots

NOW = "2026-01-01T00:00:00Z"
GAUGE = "Gauge drift follows every restart of the pump."
VALVE = "Valve seals leak below the freezing point at night."
WHY = "Found on the same round."
LISTS = ("tags", "triggers", "remembered_facts", "solution_pattern", "pitfalls")


def doc(name, description=GAUGE, labels=("area:x",), related=(), files=(), supersedes=(), status="active", **more):
    """A whole document around what a test is about; everything else is the shortest that passes the rules."""
    made = dict.fromkeys(LISTS, [])
    made.update(schema_version=1, id=name, status=status, description=description, labels=list(labels))
    made.update(triggers=[f"when {name} shows"], remembered_facts=[description])
    made["scope"] = dict(project="p", area="works", files=list(files), applies_to=[])
    made["evidence"] = dict(created_from_task="round-7", last_validated="2026-01-01")
    made["relationships"] = dict(related=[dict(id=r, reason=WHY) for r in related], supersedes=list(supersedes), superseded_by=[])
    return made | more


def store(spark, *docs, **kw):
    made = Store(spark, "p", actor="me", **kw)
    made.add_labels({"area:x": "X.", "area:z": "Z.", "kind:bug": "Bugs."})
    if docs:
        refused = made.create(list(docs), NOW)
        assert refused.isEmpty(), refused.collect()
    return made


def slugs(df):
    return [r["slug"] for r in df.collect()]


def test_create_links_both_ways_and_recall_ranks(spark):
    s = store(spark, doc("pump-drift"), doc("valve-leak", VALVE, ["area:z"], related=["pump-drift"]),
              doc("old-gauge", "An older answer about gauges without heating.", ["area:z"], status="superseded"))
    back = s.tables["records"].where("id = 'pump-drift'").head()["relationships"]["related"]
    assert [(r["id"], r["reason"]) for r in back] == [("valve-leak", WHY)]
    found = s.recall("pump drift", now=NOW).orderBy("rank").collect()
    assert found[0]["slug"] == "pump-drift" and found[0]["text"] == 1.0 and found[0]["full"]
    # Reached only through the link.
    valve = next(r for r in found if r["slug"] == "valve-leak")
    assert valve["text"] == 0.0 and valve["graph"] > 0 and "old-gauge" not in [r["slug"] for r in found]
    used = {r["slug"]: r for r in s.usage().collect()}
    assert used["pump-drift"]["surfaced_direct"] == 1 and used["valve-leak"]["surfaced_direct"] == 0
    assert s._mine("projects").head()["queries"] == 1
    s.recall("pump drift", now=NOW)
    s.record_use(["pump-drift"], NOW)
    used = {r["slug"]: r for r in s.usage().collect()}
    assert (used["pump-drift"]["surfaced"], used["pump-drift"]["applied"], used["pump-drift"]["spread_days"]) == (2, 1, 1)
    around = s.recall(related_to="pump-drift")
    assert slugs(around)[0] == "valve-leak" and "pump-drift" not in slugs(around)
    assert set(slugs(s.recall())) == {"pump-drift", "valve-leak"}  # orientation: only linked ones
    assert s.recall("nothing zzz").isEmpty()
    with pytest.raises(RecallError):
        s.recall("x", limit=0)


def test_create_refuses(spark):
    s = store(spark, doc("one"))
    bad = doc("Two", "short", ["area:x", "area:x", "nope:y"])
    bad["evidence"]["last_validated"] = "2026/01/01"
    errors = {r["id"]: r["errors"] for r in s.create([bad, doc("one")], NOW).collect()}
    assert errors["one"] == ["Memory already exists."]
    assert errors["Two"] == [
        "id must be lowercase kebab-case.", "description must be a string of at least 20 characters.",
        "field 'labels' contains duplicate values.", "label 'nope:y' is not declared in labels.json.",
        "evidence.last_validated must be YYYY-MM-DD."]
    assert s.tables["records"].count() == 1


def test_update_merge_delete(spark):
    s = store(spark, doc("keep", files=["f.py"]), doc("fold", labels=["kind:bug"], files=["f.py", "g.py"], related=["third"]),
              doc("third", VALVE, ["area:z"]))
    s.update("third", {"status": "stale", "scope": {"area": "moved"}}, NOW)
    third = s.tables["records"].where("id = 'third'").head()
    assert (third["status"], third["scope"]["area"], third["scope"]["project"]) == ("stale", "moved", "p")
    assert json.loads(s.tables["revisions"].head()["body"])["status"] == "active"
    assert s.update("third", {"labels": ["area:unknown"]}, NOW).head()["errors"] == [
        "label 'area:unknown' is not declared in labels.json."]
    s.record_use(["keep"], NOW)
    for _ in range(2):
        s.record_use(["fold"], NOW)
    s.merge("keep", "fold", "one finding", NOW)
    rows = {r["id"]: r for r in s.tables["records"].collect()}
    assert rows["keep"]["labels"] == ["area:x", "kind:bug"] and rows["keep"]["scope"]["files"] == ["f.py", "g.py"]
    assert [r["id"] for r in rows["keep"]["relationships"]["related"]] == ["third"]
    assert rows["fold"]["archived_at"] == NOW and rows["fold"]["merged_into"] == rows["keep"]["memory_id"]
    assert {r["slug"]: r["applied"] for r in s.usage().collect()}["keep"] == 3
    with pytest.raises(RecallError):
        s.merge("keep", "keep", "x", NOW)
    with pytest.raises(RecallError):
        s.delete("third", "thirds", NOW)
    assert {r["id"] for r in s.delete("third", "third", NOW).collect()} == {"keep", "fold"}
    assert s.tables["records"].where("id = 'keep'").head()["relationships"]["related"] == []
    with pytest.raises(RecallError):
        s.archive(["third"], NOW)


def test_timeline_and_lookup(spark):
    s = store(spark, *[doc(f"m{i}", evidence={"created_from_task": "t", "last_validated": "2026-01-01",
                                                "created": f"2026-01-0{i}T00:00:00Z"}) for i in range(1, 6)])
    assert slugs(s.recent(limit=2)) == ["m5", "m4"]
    assert slugs(s.recent(before="m3")) == ["m2", "m1"] and slugs(s.recent(after="m3", limit=1)) == ["m4"]
    assert slugs(s.recent(limit=2, offset=4)) == ["m1"]
    s.archive(["m2"], NOW)
    assert slugs(s.recent(before="m3")) == ["m1"] and slugs(s.archived()) == ["m2"]
    s.archive(["m2"], None)
    assert s.archived().isEmpty()
    with pytest.raises(RecallError):
        s.recent(before="m9")
    with pytest.raises(RecallError):
        s.recent(before="m1", after="m2")
    assert sorted(slugs(s.search(text="GAUGE", limit=2))) == ["m1", "m2"]


def test_publication(spark):
    s = store(spark, doc("pump-drift"), doc("leaky", "Use token = da39a3ee5e6b4b0d3255bfef95601890afd80709 there."))
    s._append("remotes", [("team", "u", "gauge drift notes", True, NOW, None, None),
                          ("off", "u", "x", False, NOW, None, None)])
    for args, why in [(("pump-drift", "team"), "private"), ]:
        with pytest.raises(RecallError, match=why):
            s.promote(*args, NOW)
    for name in ("pump-drift", "leaky"):
        s.set_visibility(name, "public")
    with pytest.raises(RecallError, match="tier too low"):
        s.promote("pump-drift", "team", NOW)
    with pytest.raises(RecallError, match="remote disabled"):
        s.promote("pump-drift", "off", NOW, force=True)
    with pytest.raises(RecallError, match="unknown remote"):
        s.promote("pump-drift", "nowhere", NOW, force=True)
    with pytest.raises(RecallError, match="holds a secret"):
        s.promote("leaky", "team", NOW, force=True)
    s.promote("leaky", "team", NOW, force=True, allow_secrets=True)
    s.promote("pump-drift", "team", NOW, force=True)
    s.promote("pump-drift", "team", NOW, force=True)  # asking again refreshes, never duplicates
    assert sorted(r["name"] for r in s.outbox_status().collect()) == ["leaky", "pump-drift"]
    s.add_remote("far", "v", "nothing in common", NOW)
    assert [r["name"] for r in s.promotion_targets("pump-drift").orderBy("place").collect()] == ["team", "far"]
    assert s.promotion_targets("pump-drift", k=1).count() == 1
    first = s.promotion_targets("pump-drift").head()
    assert first["name"] == "team" and first["description_match"] == 0.667 and first["held"] == ""
    assert s.promotion_targets("leaky").head()["held"] == "random-near-name da39..."


def test_round_trip_and_old_formats(spark, tmp_path):
    s = store(spark, doc("kept-note"), doc("shelved-note", VALVE))
    s.record_use(["kept-note"], NOW)
    s.archive(["shelved-note"], NOW)
    s.set_visibility("kept-note", "public")
    s.tables["records"] = s.tables["records"].withColumn("tier", F.when(F.col("id") == "kept-note", 3).otherwise(F.col("tier")))
    s.export(str(tmp_path / "out"), NOW)
    other = store(spark)
    other.restore(exchange.read_export(spark, str(tmp_path / "out")), NOW)
    state = {r["id"]: (r["tier"], r["archived_at"], r["visibility"]) for r in other.tables["records"].collect()}
    assert state == {"kept-note": (3, None, "public"), "shelved-note": (1, NOW, "private")}
    assert other.usage().head()["applied"] == 1
    other.restore(exchange.read_export(spark, str(tmp_path / "out")), NOW)  # again: converges
    assert other.tables["records"].count() == 2 and other.usage().head()["applied"] == 1

    for version, used in [(1, {"surfaced": 4, "applied": 2}), (2, {"r1": {"surfaced": 4, "applied": 2, "spread_bits": 3, "spread_epoch": 9}})]:
        payload = {"format": "some-store-export", "format_version": version, "projects": {"p": {
            "labels": {"area:x": {"description": "X."}, "area:new": {}}, "memories": [doc("early-note")], "usage": {"early-note": used}}}}
        path = tmp_path / f"v{version}.json"
        path.write_text(json.dumps(payload, indent=2), encoding="utf-8-sig")
        fresh = store(spark)
        fresh.restore(exchange.read_document(spark, str(path)), NOW)
        row = fresh.tables["records"].head()
        assert (row["tier"], row["tier_since_query"], row["archived_at"], row["visibility"]) == (1, 0, None, "private")
        counted = fresh.tables["usage"].head()
        assert (counted["replica_id"], counted["surfaced"], counted["applied"]) == ("legacy" if version == 1 else "r1", 4, 2)
        assert {r["label"] for r in fresh.tables["registry"].collect()} >= {"area:new", "kind:bug"}
    (tmp_path / "no.json").write_text("{}")
    with pytest.raises(RecallError):
        exchange.read_document(spark, str(tmp_path / "no.json"))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    s = store(spark, doc("one"))
    for stamp in ("20260101", "20260102", "20260103"):
        s.publish(root, stamp, keep=2)
    assert snapshots.versions(spark, root) == ["20260103", "20260102"]
    again = Store.open(spark, root, "p")
    assert slugs(again.search()) == ["one"] and again._known() == ["area:x", "area:z", "kind:bug"]
    assert snapshots.prune(spark, root, 0) == []
    with pytest.raises(RecallError):
        s.publish(root, "20260103")
    with pytest.raises(RecallError):
        snapshots.load(spark, root, "1999")


def test_jobs_run_in_order_and_survive_failure(spark):
    s = store(spark, doc("a"), doc("b", GAUGE.replace(".", "!")), doc("c", VALVE, ["area:z"]))
    s.run_jobs(["dedup", "audit", "reindex", "evict", "rebase"], NOW, evict={"bogus": 1})
    log = [(r["kind"], r["outcome"]) for r in s.tables["jobs"].collect()]
    assert sorted(log) == [("audit", "done"), ("dedup", "done"), ("evict", "failed"), ("rebase", "done"), ("reindex", "done")]
    detail = json.loads(s.tables["jobs"].where("kind = 'dedup'").head()["detail"])
    assert [sorted(pair) for pair in detail["pairs"]] == [["a", "b"]] and detail["candidates"] == 1
    assert s.tables["jobs"].where("kind = 'dedup'").head()["project_id"] == "p"
    assert s.tables["audit_runs"].count() == 1 and s.tables["audit_findings"].count() == 3
    assert jobs.seconds_since_last_run(s.tables["jobs"], "2026-01-01T00:01:00Z") == 60.0
    assert (jobs.first_delay(None), jobs.first_delay(0), jobs.first_delay(3590), jobs.first_delay(9999)) == (15, 3600, 15, 15)


def test_fusion(spark):
    def fused(*rows, limit=10):
        df = spark.createDataFrame([(1, *r) for r in rows], "query_id int, source string, rank int, uuid string, slug string")
        return fusion.fuse(df, limit).orderBy("rn").collect()

    got = fused(("a", 0, "u1", "shared"), ("a", 1, "u2", "x"), ("b", 0, "u3", "y"), ("b", 1, "u1", "shared"))
    assert got[0]["slug"] == "shared" and got[0]["sources"] == ["a", "b"] and got[0]["source"] == "a"
    assert len(fused(("a", 0, None, "same"), ("b", 0, None, "same"))) == 2
    assert len(fused(("a", 0, "u", "same"), ("b", 0, "u", "same"))) == 1
    assert fused(("a", 0, "s", "sharp"), ("a", 5, "m", "shared"), ("b", 5, "m", "shared"))[0]["slug"] == "shared"
    assert fused(("a", 0, "s", "sharp"), ("a", 200, "m", "shared"), ("b", 200, "m", "shared"))[0]["slug"] == "sharp"


def test_cache_eviction(spark):
    rows = [("p", f"u{i}", "2020-01-01T00:00:00Z" if i < 2 else f"2025-12-3{i - 2}T00:00:00Z") for i in range(4)]
    df = spark.createDataFrame(rows, "project_id string, memory_id string, cached_at string")
    assert cache.retained(df, NOW).count() == 2
    kept = cache.retained(df, NOW, 30, 1)
    assert [r["memory_id"] for r in kept.collect()] == ["u3"] and cache.evicted(df, kept).count() == 3
    assert cache.retained(df, NOW, 30, 0).isEmpty()


def test_message_quota(spark):
    clients = spark.createDataFrame([("c1", "ann", None), ("c2", "bob", None), ("c3", "eve", NOW)],
                                    "client_id string, name string, revoked_at string")
    held = spark.createDataFrame([(f"h{i}", "c1", "c2", None) for i in range(8)],
                                 "id string, from_client string, to_client string, read_at string")
    out = spark.createDataFrame(
        [(f"m{i}", "c1", "bob", "hello", f"t{i}") for i in range(4)]
        + [("e", "c1", "bob", " \n ", "t"), ("l", "c1", "bob", "x" * 4001, "t"), ("u", "c1", "zed", "x", "t"),
           ("r", "c1", "eve", "x", "t"), ("o", "c1", "ann", "x", "t")],
        "id string, from_client string, to_name string, body string, sent_at string")
    got = {r["id"]: r["outcome"] for r in messages.send(out, held, clients).collect()}
    assert got == {"m0": "sent", "m1": "sent", "m2": "too many unread", "m3": "too many unread", "e": "empty",
                   "l": "too long", "u": "unknown recipient", "r": "recipient revoked", "o": "own client"}


def test_anchors(spark):
    rows = [("p", "1", "stands", "active", ["a.cpp"], None), ("p", "2", "gone", "active", ["d.cpp"], None),
            ("p", "3", "partial", "active", ["a.cpp", "d.cpp"], None), ("p", "4", "none", "active", [], None),
            ("p", "5", "wrong", "wrong", ["d.cpp"], None), ("p", "6", "away", "active", ["d.cpp"], NOW)]
    df = spark.createDataFrame(rows, "project_id string, memory_id string, slug string, status string, files array<string>, archived_at string")
    adrift = validate.anchors_adrift(df, spark.createDataFrame([("a.cpp",)], "path string"))
    assert sorted(slugs(adrift)) == ["gone", "wrong"]
    after = {r["slug"]: r["status"] for r in validate.mark_stale(df, adrift).collect()}
    assert after["gone"] == "stale" and after["wrong"] == "wrong" and after["partial"] == "active"


def test_shape_errors(spark):
    good = doc("x")
    odd = {**doc("y"), "weight": 1}
    odd.pop("pitfalls")
    odd["scope"]["extra"] = 1
    odd["evidence"].pop("last_validated")
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(odd),), ("[1]",)], "j string")
    got = [sorted(r[0]) for r in df.select(validate.shape_errors(F.col("j"))).collect()]
    assert got == [[], ["evidence is missing 'last_validated'.", "missing required field 'pitfalls'.",
                        "scope has unknown field 'extra'.", "unknown field 'weight'."], ["memory must be a JSON object."]]


def test_patch_null_is_not_absent(spark):
    base = spark.createDataFrame([("p",)], "project_id string").select(
        "project_id", F.from_json(F.lit(json.dumps(doc("a"))), f"struct<{DOCUMENT_DDL}>").alias("d")).select("project_id", "d.*")
    done = records.patched(base.withColumn("patch", F.lit('{"description": null, "evidence": {"created": "c"}}'))).head()
    assert done["description"] is None and done["evidence"]["created"] == "c" and done["evidence"]["created_from_task"] == "round-7"


def test_bm25_against_loops(spark):
    texts = {f"d{i}": " ".join(f"w{(i * k) % 13}" for k in range(1, 4 + i % 9)) for i in range(30)}
    df = spark.createDataFrame([("p", k, v, True) for k, v in texts.items()], "project_id string, memory_id string, description string, live boolean")
    rows = index.index_rows(df, {"description": F.col("description")}, ["project_id", "memory_id", "live"])
    asked = spark.createDataFrame([(1, "p", "w1 w5 w5 w12"), (2, "p", "w3"), (3, "p", "x y"), (4, "q", "w3")],
                                  "query_id int, project_id string, query string")
    got = {(r["query_id"], r["memory_id"]): r["raw"] for r in index.bm25(rows, asked).collect()}
    bags = {k: Counter(set(v.split())) for k, v in texts.items()}
    mean = sum(len(b) for b in bags.values()) / len(bags)
    want = {}
    for q, terms in ((1, ["w1", "w5", "w12"]), (2, ["w3"])):
        for k, bag in bags.items():
            score = 0.0
            for t in terms:
                if t in bag:
                    n = sum(t in b for b in bags.values())
                    idf = math.log((30 - n + 0.5) / (n + 0.5))
                    f = 3.0
                    score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(bag) / mean))
            if score:
                want[(q, k)] = score
    assert got == pytest.approx(want, abs=1e-8)
    limited = index.bm25(rows, asked, limit=2).where("query_id = 1").orderBy("rn").collect()
    best = sorted((-round(s, 9), k) for (q, k), s in want.items() if q == 1)[:2]
    assert [r["memory_id"] for r in limited] == [k for _, k in best] and limited[0]["text"] == 1.0


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_skipping_common_terms_changes_nothing(spark, limit):
    """Two terms on most records, one on a third, rare ones; copies make exact ties."""
    rows = []
    for i in range(120):
        words = ["the", "of"] if i % 7 else ["the"]
        words += ["third"] if i % 3 == 0 else []
        words += [f"r{i % 40}"] if i % 2 else []
        words += [f"pad{j}" for j in range(i % 5)]
        rows += [("p", f"d{i:03}{c}", " ".join(words), i % 13 != 0) for c in "ab"]
    df = spark.createDataFrame(rows, "project_id string, memory_id string, description string, live boolean")
    built = index.index_rows(df, {"description": F.col("description")}, ["project_id", "memory_id", "live"])
    asked = spark.createDataFrame(
        [(1, "p", "the of r1 r3 r5"), (2, "p", "the of"), (3, "p", "third r7 of"), (4, "p", "r9"), (5, "p", "third the"),
         (6, "p", "r1 r3 r5 r7 r9 r11 the of third")], "query_id int, project_id string, query string")
    plain = index.bm25(built, asked, limit=limit)
    skipped = index.bm25(built, asked, limit=limit, skip_above=0)
    key = lambda df: sorted((r["query_id"], r["rn"], r["memory_id"], r["raw"]) for r in df.collect())
    assert key(plain) == key(skipped)


def test_search_refuses_unknown_status(spark):
    with pytest.raises(RecallError):
        search.status_filter(["active", "dead"])
    assert set(TABLES) >= {"records", "usage", "edges", "outbox"}


def test_recall_across_reports_what_it_could_not_read(spark, tmp_path):
    from recallspark.plans.federated import RANKED, recall_across, remember

    ddl = "query_id int, rank int, uuid string, slug string, status string, description string, labels array<string>"
    local = spark.createDataFrame([(1, 0, "u1", "mine", "active", "d", []), (1, 1, "u2", "both", "active", "d", [])], ddl)
    team = spark.createDataFrame([(1, 0, "u2", "both", "active", "theirs", [])], ddl)
    fused, answers, lost = recall_across(
        local, {"team": lambda: team, "gone": lambda: spark.read.parquet(str(tmp_path / "nothing"))}, 5)
    rows = fused.orderBy("rn").collect()
    assert [r["slug"] for r in rows] == ["both", "mine"] and rows[0]["source"] == "team" and list(lost) == ["gone"]
    held = spark.createDataFrame([("p", "u2", "first-name", "stale", "old", [], "team", "c", "2020")],
                                 "project_id string, memory_id string, slug string, status string, description string, "
                                 "labels array<string>, origin string, created string, cached_at string")
    after = remember(held, answers, "p", NOW).head()
    assert (after["slug"], after["created"], after["description"], after["cached_at"]) == ("first-name", "c", "theirs", NOW)
    assert set(RANKED) < set(answers.columns)


def links(s):
    return {r["id"]: [(x["id"], x["reason"]) for x in r["relationships"]["related"]] for r in s.tables["records"].collect()}


def test_links_follow_the_written_record(spark):
    s = store(spark, doc("hub", related=["zeta", "beta"]), doc("zeta"), doc("beta"), doc("lone", VALVE))
    assert links(s) == {"hub": [("zeta", WHY), ("beta", WHY)], "zeta": [("hub", WHY)], "beta": [("hub", WHY)], "lone": []}
    s.update("zeta", {"relationships": {"related": [{"id": "hub", "reason": "Seen again on the next round."}, {"id": "lone", "reason": "New on the same line of pipe."}]}}, NOW)
    assert links(s)["hub"] == [("zeta", "Seen again on the next round."), ("beta", WHY)] and links(s)["lone"] == [("zeta", "New on the same line of pipe.")]
    s.update("hub", {"relationships": {"related": [{"id": "beta", "reason": WHY}]}}, NOW)
    assert links(s) == {"hub": [("beta", WHY)], "zeta": [("lone", "New on the same line of pipe.")], "beta": [("hub", WHY)], "lone": [("zeta", "New on the same line of pipe.")]}
    s.update("lone", {"relationships": {"supersedes": ["beta"]}}, NOW)
    rows = {r["id"]: r["relationships"] for r in s.tables["records"].collect()}
    assert rows["beta"]["superseded_by"] == ["lone"] and links(s)["beta"] == [("hub", WHY)]
    assert s.tables["revisions"].where("author_name = 'me'").count() == 3
    edges = s.tables["edges"].where("kind = 'related'").count()
    assert edges == 4


def test_unknown_targets_are_refused(spark):
    s = store(spark, doc("one"))
    refused = s.create([doc("two", related=["nowhere"]), doc("three", related=["two"]), doc("four", related=["one"])], NOW)
    assert {r["id"]: r["errors"] for r in refused.collect()} == {"two": ["linked record 'nowhere' does not exist."]}
    assert set(links(s)) == {"one", "three", "four"}
    assert not s.update("one", {"relationships": {"supersedes": ["gone"]}}, NOW).isEmpty()
    assert s.tables["records"].where("id = 'one'").head()["relationships"]["supersedes"] == []


def test_one_id_in_two_projects(spark):
    s = store(spark, doc("one"))
    other = s.tables["records"].withColumn("project_id", F.lit("q"))
    s.tables["records"] = s.tables["records"].unionByName(other)
    s.update("one", {"status": "stale"}, NOW)
    assert {(r["project_id"], r["status"]) for r in s.tables["records"].collect()} == {("p", "stale"), ("q", "active")}


def test_remotes_change(spark):
    s = store(spark, doc("one"))
    s.add_remote("team", "u", "notes", NOW)
    s.add_remote("team", "v", "more notes", "2027-01-01T00:00:00Z")
    row = s.sources().head()
    assert (row["url"], row["description"], row["added"], row["enabled"]) == ("v", "more notes", NOW, True)
    s.enable_remote("team", False)
    assert s.sources(enabled_only=True).isEmpty()
    s.enable_remote("team")
    s.set_visibility("one", "public")
    s.promote("one", "team", NOW, force=True)
    assert s.remove_remote("team") == 1 and s.sources().isEmpty() and s.outbox_status().isEmpty()
    with pytest.raises(RecallError):
        s.enable_remote("team")


def test_mail_flags(spark):
    s = store(spark)
    s._append("clients", [("me", "me", NOW, None, []), ("you", "you", NOW, None, [])])
    assert s.send("you", "hello", "m1", NOW, about="one", reply_to="m0") == "sent"
    kept = s.tables["messages"].head()
    assert (kept["about_memory"], kept["in_reply_to"]) == ("one", "m0")
    assert s.inbox("you", mark_read_at=NOW).count() == 1
    assert s.inbox("you").isEmpty() and s.inbox("you", unread_only=False).count() == 1


def test_an_empty_registry_knows_no_label(spark):
    s = Store(spark, "p")
    with pytest.raises(RecallError):
        s.recall("x", label_query="area:x")


def test_details_stay_json():
    text = jobs.short({"error": "x" * 100_000, "n": 1})
    assert len(text) <= jobs.MAX_DETAIL and json.loads(text)["n"] == 1


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_commits_hold_what_changed_and_open_as_the_same_store(spark, tmp_path):
    root = f"{tmp_path}/log"
    s = store(spark, *[doc(f"m{i}", f"{GAUGE} Number {i}.", files=[f"f{i % 3}.py"]) for i in range(30)])
    s.commit(root, "20260101")
    before = folder_bytes(tmp_path / "log")
    s.archive(["m4"], NOW)
    s.record_use(["m3"], NOW)
    assert s.commit(root, "20260102") == 1
    assert folder_bytes(tmp_path / "log") - before < before / 2  # thirty records and their links are not written again
    again = Store.open_log(spark, root, "p")
    for name in ("records", "edges", "usage", "registry"):
        assert sorted(map(str, again.tables[name].collect())) == sorted(map(str, s.tables[name].collect())), name
    assert set(again._log.state["tables"]["records"]["changes"]) and not again._log.state["tables"]["edges"]["changes"]


WRONG = [
    ({"tags": [1, 2]}, ["field 'tags' must contain only strings."]),
    ({"labels": ["bad", 3, "worse"]}, ["field 'labels' value 'bad' has an invalid format.", "field 'labels' must contain only strings."]),
    ({"labels": []}, ["field 'labels' must have at least 1 item(s)."]),
    ({"triggers": "one"}, ["field 'triggers' must be an array."]),
    ({"extra": 1, "tags": [1]}, ["unknown field 'extra'."]),
    ({"schema_version": "1"}, ["schema_version must be 1."]),
    ({"description": 123456789012345678901234}, ["description must be a string of at least 20 characters."]),
    ({"status": 7}, ["status '7' is not one of ['active', 'stale', 'superseded', 'wrong']."]),
    ({"status": None}, ["status 'None' is not one of ['active', 'stale', 'superseded', 'wrong']."]),
    ({"scope": '{"project": "p"}'}, ["scope must be an object."]),
    ({"scope": {"project": 5, "deep": 1, "files": ["a", "a"]}},
     ["scope has unknown field 'deep'.", "scope.project must be a string.", "field 'scope.files' contains duplicate values."]),
    ({"evidence": {"created": 5, "last_validated": 20260101}},
     ["evidence.last_validated must be YYYY-MM-DD.", "evidence.created must be an ISO-8601 string."]),
    ({"relationships": {"related": [{"id": "one", "reason": WHY, "weight": 1}, "one", {"id": 4, "reason": WHY}]}},
     ["relationships.related entries must be objects with exactly 'id' and 'reason'."] * 2 + ["relationships.related id must be lowercase kebab-case."]),
    ({"relationships": {"related": "one", "supersedes": [None]}},
     ["relationships.related must be an array.", "field 'relationships.supersedes' must contain only strings."]),
]


def test_values_of_the_wrong_type_are_refused(spark):
    from recallspark.operators import bodies

    whole = json.dumps(doc("one"))
    texts = [(i, whole, json.dumps(patch)) for i, (patch, _) in enumerate(WRONG)]
    rows = spark.createDataFrame([*texts, (90, whole, "{}"), (91, whole, "[1]"), (92, whole, None)], "n int, a string, b string")
    got = {r["n"]: r["errors"] for r in bodies.judged(rows.withColumn("body", bodies.merged(F.col("a"), F.col("b"))), "body", ["area:x"]).collect()}
    assert {n: got[n] for n in range(len(WRONG))} == {n: errors for n, (_, errors) in enumerate(WRONG)}
    assert got[90] == [] and got[91] == got[92] == ["memory must be a JSON object."]
    odd = spark.createDataFrame([(0, "{"), (1, '{"id": "a", "id": "b"}'), (2, None), (3, "null"), (4, "")], "n int, body string")
    assert all(r["errors"] == ["memory must be a JSON object."] for r in bodies.judged(odd, "body").collect())
    assert bodies.judged(odd.limit(0), "body").count() == 0


def test_the_store_refuses_wrong_types(spark):
    s = store(spark, doc("one"))
    refused = {r["id"]: r["errors"] for r in s.create([doc("two", tags=[1, 2]), doc("three", weight=1), doc("four")], NOW).collect()}
    assert refused == {"two": ["field 'tags' must contain only strings."], "three": ["unknown field 'weight'."]}
    assert sorted(r["id"] for r in s.tables["records"].collect()) == ["four", "one"]
    assert s.update("one", {"scope": {"deep": True}}, NOW).head()["errors"] == ["scope has unknown field 'deep'."]
    assert s.update("one", {"scope": {"files": ["b.py"]}}, NOW).isEmpty()
    assert s.tables["records"].where("id = 'one'").head()["scope"]["files"] == ["b.py"]


def test_shared_values_are_worked_out_once(spark):
    """A rule, and the merge of two documents, read the same JSON anew at every place that named it."""
    from recallspark.operators import bodies

    calls = bodies.merged(F.col("held"), F.col("patch"))
    text = spark.createDataFrame([("{}", "{}")], "held string, patch string").select(calls.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text.count("from_json(") <= 2 + 2 + 1
    scope = bodies._strings("tags", F.parse_json(F.col("body")), True, 1, "^a")
    plan = spark.createDataFrame([("[]",)], "body string").select(scope.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1
    rows = spark.createDataFrame([('["a", "a"]',), ('["a", 1, "b"]',), ('["b"]',), ("[]",), ("3",), ("null",)], "body string")
    got = [r["x"] for r in rows.select(scope.alias("x")).collect()]
    assert got == [["field 'tags' contains duplicate values."], ["field 'tags' must contain only strings."], ["field 'tags' value 'b' has an invalid format."],
                   ["field 'tags' must have at least 1 item(s)."], ["field 'tags' must be an array."], ["field 'tags' must be an array."]]
