"""The stored text index and the change log against what they stand for, computed anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recallspark.operators import index
from recallspark.schema import RecallError
from recallspark.session import settle
from recallspark.sources import changes, postings
from recallspark.sources.files import create_text, list_names, read_text, replace_text
from recallspark.sources.postings import Postings

WORDS = [f"w{i}" for i in range(30)]
ROW = "project_id string, memory_id string, live boolean, text string"
ASK = "query_id bigint, project_id string, query string"


def corpus(spark, rows):
    df = spark.createDataFrame([(r[1], r[0], r[2], r[3]) for r in rows.values()], ROW)
    return index.index_rows(df, {"description": F.col("text")}, ["project_id", "memory_id", "live"])


def made(dice, i):
    # w0 is in nearly every record, the others get rarer.
    words = ["w0"] * (dice.random() < 0.9) + [w for k, w in enumerate(WORDS) if dice.random() < 1.5 / (k + 1)] + ["x"] * dice.randrange(0, 30)
    return f"m{i:03}", dice.choice("pq"), dice.random() > 0.1, " ".join(f"{w} {w}{dice.randrange(3)}" for w in words)


def found(df):
    return sorted((r.query_id, r.rn, r.memory_id, r.raw, round(r.text, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def questions(spark):
    dice = random.Random(4)
    asked = [(i, dice.choice("pq"), " ".join(dice.sample(WORDS, dice.randrange(1, 6)))) for i in range(12)]
    return spark.createDataFrame([*asked, (50, "p", "w0"), (51, "q", "nowhere"), (52, "p", "w0 w29 w29"), (53, "none", "w1")], ASK)


@pytest.mark.parametrize("limit,first,block,by_project", [(50, 64, 128, False), (3, 1, 2, True)])
def test_top_lists_equal_scoring_everything(spark, tmp_path, questions, limit, first, block, by_project):
    """After a build, after two refreshes with new, changed and removed records, and after merging the segments."""
    dice = random.Random(limit)
    rows = {i: made(dice, i) for i in range(70)}
    held = Postings.build(corpus(spark, rows), f"{tmp_path}/i", buckets=4, block=block)

    def compare():
        want = index.bm25(corpus(spark, rows), questions, limit, ["project_id"] if by_project else None)
        assert found(Postings(spark, f"{tmp_path}/i").search(questions, limit, by_project, first)) == found(want)

    for number in range(2):
        changed = {i: made(dice, i) for i in dice.sample(range(100), 9)}
        gone = [i for i in dice.sample(sorted(rows), 3) if i not in changed]
        lost = spark.createDataFrame([(rows[i][1], rows[i][0]) for i in gone], "project_id string, memory_id string")
        # A record keeps its project; changing it would be a removal and an insert.
        changed = {i: (r[0], rows[i][1] if i in rows else r[1], *r[2:]) for i, r in changed.items()}
        held.refresh(corpus(spark, changed), lost, block)
        rows.update(changed)
        for i in gone:
            del rows[i]
    compare()
    assert len(held.segments) == 3
    held.compact(block)
    assert len(held.segments) == 1
    compare()


def test_a_question_reads_its_terms_files_only(spark, tmp_path):
    dice = random.Random(1)
    held = Postings.build(corpus(spark, {i: made(dice, i) for i in range(40)}), f"{tmp_path}/i", buckets=8)
    terms = spark.createDataFrame([("w3",)], "term string")
    bucket = terms.select(held._bucket(F.col("term")).alias("b")).head()["b"]
    plan = held._asked("postings", [bucket], ["p"])._jdf.queryExecution().toString()
    assert f"PartitionFilters: [(bucket" in plan or f"bucket#" in plan.split("PartitionFilters: [")[1][:80]
    assert "EqualTo(project_id,p)" in plan
    files = [r["f"] for r in held._asked("postings", [bucket], None).select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(f"bucket={bucket}/" in f for f in files)


def test_odd_indexes(spark, tmp_path, questions):
    empty = corpus(spark, {0: made(random.Random(0), 0)}).limit(0)
    held = Postings.build(empty, f"{tmp_path}/e", buckets=2)
    assert held.search(questions).count() == 0
    held.refresh(corpus(spark, {1: ("m1", "p", True, ""), 2: ("m2", "p", False, "w0")}), empty.select("project_id", "memory_id"))
    assert held.search(questions).count() == 0  # one has no words, the other is not live
    with pytest.raises(RecallError):
        Postings.build(empty, f"{tmp_path}/e")


# ------------------------------------------------------------------ change log

T = "k string, sub string, v bigint, note string"
KEYS = {"t": ["k", "sub"]}


def frame(spark, rows):
    return spark.createDataFrame([(*key, *value) for key, value in rows.items()], T)


def test_folding_equals_applying_one_after_another(spark):
    dice = random.Random(2)
    state = {(f"k{i}", "a"): (i, None) for i in range(30)}
    base, parts = frame(spark, state), []
    for _ in range(5):
        # Key k0 is in every change.
        puts = {(f"k{i}", dice.choice("ab")): (dice.randrange(100), dice.choice([None, "n"])) for i in [0, *dice.sample(range(40), 5)]}
        gone = [key for key in dice.sample(sorted(state), 4) if key not in puts]
        drops = spark.createDataFrame([(k, s) for k, s in [*gone, ("never", "there")]], "k string, sub string")
        parts.append(settle(changes.change_rows(base.columns, frame(spark, puts), drops)))
        state = {k: v for k, v in state.items() if k not in gone} | puts
    got = {(r.k, r.sub): (r.v, r.note) for r in changes.fold(base, parts, ["k", "sub"]).collect()}
    assert got == state
    once = settle(changes.last_of_each(parts, ["k", "sub"]))
    assert {(r.k, r.sub): (r.v, r.note) for r in changes.fold(base, [once], ["k", "sub"]).collect()} == state
    found = changes.difference(base, frame(spark, state), ["k", "sub"])
    assert {(r.k, r.sub): (r.v, r.note) for r in changes.fold(base, [found], ["k", "sub"]).collect()} == state
    assert found.count() < len(state) + 10 and changes.difference(base, base, ["k", "sub"]).isEmpty()
    only = changes.change_rows(base.columns, None, spark.createDataFrame([("k1", "a")], "k string, sub string"))
    assert changes.fold(base, [only], ["k", "sub"]).count() == 29


def test_versions_compaction_and_a_second_writer(spark, tmp_path):
    root = f"{tmp_path}/log"
    log = changes.ChangeLog(spark, root)
    base = frame(spark, {("a", "x"): (1, None), ("b", "x"): (2, None)})
    lines = spark.createDataFrame([("one",)], "line string")
    assert log.commit("s0", whole={"t": base, "lines": lines}, keys=KEYS) == 0
    late = changes.ChangeLog(spark, root)
    put = changes.change_rows(base.columns, frame(spark, {("b", "x"): (3, "new")}), None)
    more = changes.change_rows(["line"], spark.createDataFrame([("two",)], "line string"), None)
    log.commit("s1", changes={"t": put, "lines": more})
    with pytest.raises(RecallError, match="somebody else"):
        late.commit("s1", changes={"t": put})
    fresh = changes.ChangeLog(spark, root)
    assert fresh.version == 1 and {(r.k, r.v) for r in fresh.read("t").collect()} == {("a", 1), ("b", 3)}
    assert sorted(r.line for r in fresh.read("lines").collect()) == ["one", "two"]
    assert {(r.k, r.v) for r in late.read("t").collect()} == {("a", 1), ("b", 2)}  # its version still reads the same
    with pytest.raises(RecallError, match="no base"):
        fresh.commit("s2", changes={"other": put})
    assert fresh.compact("s2") == ["lines", "t"] and fresh.state["tables"]["t"]["changes"] == []
    assert {(r.k, r.v) for r in fresh.read("t").collect()} == {("a", 1), ("b", 3)}
    assert fresh.prune() == 5  # two bases, two changes, and what the refused writer left
    assert {(r.k, r.v) for r in changes.ChangeLog(spark, root).read("t").collect()} == {("a", 1), ("b", 3)}


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/deep/er/f.json"
    assert read_text(spark, path) is None and list_names(spark, f"{tmp_path}/deep") == []
    assert create_text(spark, path, "é") and not create_text(spark, path, "b")
    assert read_text(spark, path) == "é"
    replace_text(spark, path, "c")
    assert read_text(spark, path) == "c" and [n for n in list_names(spark, f"{tmp_path}/deep/er") if n.endswith("json") and n[0] != "."] == ["f.json"]


def test_a_record_is_summed_where_it_is_and_postings_hold_numbers(spark, tmp_path):
    """Building moved every posting four times, with the record's id each time."""
    rows = spark.createDataFrame(
        [("p", "a", True, [("x", 1.0), ("y", 2.0), ("x", 0.5)], 3.0), ("p", "b", False, [], 0.0)],
        "project_id string, memory_id string, live boolean, entries array<struct<term:string,w:double>>, dl double")
    done = index.summed(rows, ["memory_id"])
    assert "Exchange" not in done._jdf.queryExecution().toString()
    assert {r["memory_id"]: [tuple(e) for e in r["entries"]] for r in done.collect()} == {"a": [("x", 1.5), ("y", 2.0)], "b": []}
    held = Postings.build(rows, f"{tmp_path}/n", buckets=2)
    assert dict(held._read("postings").dtypes)["docs"] == "array<bigint>"


def test_a_refresh_notes_numbers_of_what_it_replaces(spark, tmp_path):
    """Ids of replaced records were matched against every posting of a question."""
    dice = random.Random(9)
    held = Postings.build(corpus(spark, {i: made(dice, i) for i in range(6)}), f"{tmp_path}/g", buckets=2)
    old = {r["memory_id"]: (r["segment"], r["doc"]) for r in held._read("rows").collect()}
    row = held.rows().where("memory_id = 'm002'").head()
    held.refresh(corpus(spark, {2: ("m002", row["project_id"], True, "w1 new")}), spark.createDataFrame([], "project_id string, memory_id string"))
    assert [(r["of"], r["doc"]) for r in held._read("gone").collect()] == [old["m002"]]
    assert sorted(r["memory_id"] for r in held.rows().collect()) == [f"m{i:03}" for i in range(6)]


def test_a_question_meets_a_record_where_its_postings_are(spark, tmp_path, questions, monkeypatch):
    """Every posting moved once for each question that asks for it."""
    dice, kept = random.Random(5), []
    held = Postings.build(corpus(spark, {i: made(dice, i) for i in range(40)}), f"{tmp_path}/w", buckets=2)
    monkeypatch.setattr(postings, "settle", lambda df: kept.append(df) or settle(df))
    held.search(questions)
    summed = [df._jdf.queryExecution().executedPlan().toString() for df in kept if "raw" in df.columns]
    assert len(summed) == 1 and re.search(r"hashpartitioning\((segment#\d+|0), doc#", summed[0])
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, (segment|doc)#", summed[0])
