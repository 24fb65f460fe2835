import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.operators import graph, similar
from recallspark.operators.similar import SHAPE, _first_ids, derived_edges, edge_changes, edges_and_reach
from recallspark.session import settle


def ranked(links, seeds=None):
    rows = [(a, b, w) for a, b, w in links] + [(b, a, w) for a, b, w in links]
    rows += [(n, None, w) for n, w in (seeds or {}).items()]
    out = graph.rank_nodes(pd.DataFrame(rows, columns=["a", "b", "w"]), 1e-8, 100)
    return dict(zip(out["node"], out["rank"]))


def test_rank_invariants():
    path = [("a", "b", 1.0), ("b", "c", 1.0)]
    assert sum(ranked(path).values()) == pytest.approx(1, abs=1e-6)
    uniform = ranked(path, {"a": 1.0, "b": 1.0, "c": 1.0})
    assert all(uniform[n] == pytest.approx(r, abs=1e-9) for n, r in ranked(path).items())
    lonely = ranked([("a", "b", 1.0)], {"a": 1.0, "b": 1.0, "lonely": 1.0})
    assert sum(lonely.values()) == pytest.approx(1, abs=1e-6) and lonely["lonely"] > 0
    tri = [("a1", "a2", 1.0), ("a2", "a3", 1.0), ("a1", "a3", 1.0), ("b1", "b2", 1.0), ("b2", "b3", 1.0),
           ("b1", "b3", 1.0), ("a3", "b1", 1.0)]
    near = ranked(tri, {"a1": 1.0})
    assert near["a2"] > near["b2"] and near["a3"] > near["b1"]


@pytest.mark.parametrize("hub_links", [100_000, 3])
def test_pagerank_matches_one_machine(spark, hub_links):
    random.seed(3)
    links = sorted({tuple(sorted(random.sample(range(30), 2))) for _ in range(60)})
    nodes = spark.createDataFrame([("p", f"n{i}") for i in range(33)], "project_id string, memory_id string")
    edges = spark.createDataFrame([("p", f"n{a}", f"n{b}", "related") for a, b in links],
                                  "project_id string, src string, dst string, kind string")
    got = {r["memory_id"]: r["rank"] for r in graph.pagerank(nodes, edges, iterations=8, hub_links=hub_links).collect()}
    rows = [(f"n{a}", f"n{b}", 1.0) for x in links for a, b in (x, x[::-1])] + [(f"n{i}", None, 1.0) for i in range(33)]
    want = graph.rank_nodes(pd.DataFrame(rows, columns=["a", "b", "w"]), 0.0, 8)
    assert got == pytest.approx(dict(zip(want["node"], want["rank"])), abs=1e-12)


def slow_walk(edges, seeds, depth, max_nodes, frontier):
    """The walk with ordinary loops."""
    opened = list(dict.fromkeys(seeds))
    seen, out = set(opened), set()
    for _ in range(depth):
        if not opened or len(seen) >= max_nodes:
            break
        rows = sorted(e for e in edges if e[1] in opened or e[2] in opened)[: max_nodes * 4]
        fresh = []
        for kind, src, dst in rows:
            out.add((kind, src, dst))
            for node in (dst, src):
                if node not in seen and len(seen) < max_nodes:
                    seen.add(node)
                    fresh.append(node)
        opened = fresh[:frontier]
    return out


@pytest.mark.parametrize("max_nodes,frontier", [(250, 60), (12, 4), (30, 3)])
def test_walk_against_loops(spark, max_nodes, frontier):
    random.seed(max_nodes)
    kinds = ["derived", "related", "supersedes"]
    # Node n000 is a hub holding a third of all links.
    edges = {(random.choice(kinds), f"n{random.randrange(80):03}", f"n{random.randrange(80):03}") for _ in range(120)}
    edges |= {("related", "n000", f"n{i:03}") for i in range(60)}
    edges = {e for e in edges if e[1] != e[2]}
    df = spark.createDataFrame([("p", *e) for e in edges], "project_id string, kind string, src string, dst string")
    seeds = {1: ["n000", "n003"], 2: ["n050"], 3: ["n077", "n078"]}
    seed_df = spark.createDataFrame([(q, "p", n, 1.0) for q, ns in seeds.items() for n in ns],
                                    "query_id bigint, project_id string, node string, weight double")
    got: dict[int, set] = {}
    for r in graph.walk(df, seed_df, max_nodes=max_nodes, frontier=frontier).collect():
        got.setdefault(r["query_id"], set()).add((r["kind"], r["src"], r["dst"]))
    for query, nodes in seeds.items():
        assert got.get(query, set()) == slow_walk(edges, nodes, 2, max_nodes, frontier), query


def slow_derived(rows, candidates, neighbours, threshold):
    def jac(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    out = {}
    for me, (labels, files, live) in rows.items():
        if not live:
            continue
        by_label = sorted((m for m in rows if m != me and rows[m][0] & labels), key=lambda m: (-len(rows[m][0] & labels), m))
        by_file = sorted(m for m in rows if m != me and rows[m][1] & files)
        scored = []
        for m in {*by_label[:candidates], *by_file[:candidates]}:
            s = 0.7 * jac(labels, rows[m][0]) + 0.3 * jac(files, rows[m][1])
            if s >= threshold:
                scored.append((-s, m))
        out.update({(me, m): -s for s, m in sorted(scored)[:neighbours]})
    return out


@pytest.mark.parametrize("candidates,neighbours,wide", [(200, 10, False), (3, 2, True)])
def test_derived_edges_against_all_pairs(spark, candidates, neighbours, wide):
    random.seed(candidates)
    pool = [f"k:l{i}" for i in range(6)] + ([f"w:x{i}" for i in range(12)] if wide else [])
    rows = {}
    for i in range(90):
        labels = set(random.sample(pool[:6], random.randrange(0, 4)))
        if wide and i % 9 == 0:
            labels |= set(pool[6:])  # many labels, all of them rare
        if i % 3 == 0:
            labels.add("k:l0")  # a third of all records share one label
        files = set(random.sample(["a", "b", "c", "d"], random.randrange(0, 3)))
        rows[f"m{i:03}"] = (labels, files, i % 11 != 0)
    df = spark.createDataFrame(
        [("p", m, sorted(l), sorted(f), None if live else "gone") for m, (l, f, live) in rows.items()],
        "project_id string, memory_id string, labels array<string>, files array<string>, archived_at string")
    got = {(r["src"], r["dst"]): r["similarity"] for r in derived_edges(df, candidates, neighbours, rare=1).collect()}
    assert got == pytest.approx(slow_derived(rows, candidates, neighbours, 0.34))


RECORD_ROW = "project_id string, memory_id string, labels array<string>, files array<string>, archived_at string"


def frame_of(spark, rows):
    return spark.createDataFrame(
        [("p", m, sorted(l), sorted(f), None if live else "gone") for m, (l, f, live) in rows.items()], RECORD_ROW)


@pytest.mark.parametrize("candidates", [200, 6, 3])
def test_counted_lists_equal_all_pairs_and_the_lists_by_subsets(spark, candidates):
    """Twelve common labels a record made 4,095 subsets of each, which did not end on 0.1 GB."""
    random.seed(candidates)
    rows = {}
    for i in range(80):
        labels = set(random.sample([f"w:l{x}" for x in range(40)], 11)) if i % 8 else {"w:l0", f"w:l{i % 3}"} if i % 16 else set()
        labels |= {"k:third"} if i % 3 == 0 else set()
        rows[f"m{i:03}"] = (labels, set(random.sample("abc", random.randrange(3))), i % 9 != 0)
    frame = frame_of(spark, rows)
    got, reach = edges_and_reach(frame, candidates, 5, 0.2, 1, count_above=0)
    assert {(r["src"], r["dst"]): r["similarity"] for r in got.collect()} == pytest.approx(slow_derived(rows, candidates, 5, 0.2))
    _, want = edges_and_reach(frame, candidates, 5, 0.2, 1, count_above=float("inf"))
    assert sorted(map(str, reach.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("k", [1, 7, 200, 5000])
def test_counting_by_binary_digits_equals_counting_one_by_one(k):
    """A set was held against every record of its project, a byte each, and against its file candidates one pair at a time."""
    dice = np.random.default_rng(k)
    lists = [np.unique(np.minimum(dice.zipf(1.3, dice.integers(0, 14)), 3000)) for _ in range(3001)]
    table = pa.table({"labels": pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))})
    held = similar._Lists(table, "labels")
    counter = similar._Counter(held, max(map(len, lists)))
    for mine in lists[:60]:
        count = np.array([len(np.intersect1d(mine, x)) for x in lists])
        order = np.lexsort((np.arange(len(lists)), -count))[: min(k, int((count > 0).sum()))]
        best, shared = counter.best(held.known(mine), k)
        assert best.tolist() == order.tolist() and shared.tolist() == count[order].tolist()
    assert len(counter.sets) < len(held.names) / 4  # rare labels take no bit a record


def test_counted_lists_with_missing_names(spark):
    random.seed(2)
    rows = [("p", f"m{i:03}", random.sample(["a", "b", "c", "d", "e", None], 3) if i % 9 else [], random.sample(["x", "y", None], i % 3), None) for i in range(60)]
    rows += [("p", "n1", None, ["x"], None), ("p", "n2", ["a", "b"], None, None)]
    df = spark.createDataFrame(rows, RECORD_ROW)
    got, want = (sorted(map(tuple, derived_edges(df, 6, 4, 0.2, 1, count_above=above).collect())) for above in (0, float("inf")))
    assert got == want and got


@pytest.mark.parametrize("candidates,rare", [(6, 1), (4, 0)])
def test_twelve_labels_with_one_on_a_third(spark, candidates, rare):
    random.seed(candidates)
    rows = {}
    for i in range(80):
        labels = set(random.sample([f"w:l{x}" for x in range(40)], 11)) | ({"k:third"} if i % 3 == 0 else {"w:other"} if i % 5 else set())
        rows[f"m{i:03}"] = (labels, {random.choice("abc")}, i % 9 != 0)
    got = {(r["src"], r["dst"]): r["similarity"] for r in derived_edges(frame_of(spark, rows), candidates, 10, 0.2, rare).collect()}
    assert got == pytest.approx(slow_derived(rows, candidates, 10, 0.2))


@pytest.mark.parametrize("candidates,neighbours", [(5, 3)])
def test_edge_changes_equal_a_full_rebuild(spark, candidates, neighbours):
    """Rounds of inserts, edits, archivings and removals, with lists short enough that places are left and taken."""
    dice = random.Random(candidates)
    settings = {"candidates": candidates, "neighbours": neighbours, "rare": 1}

    def made(i):
        labels = set(dice.sample([f"k:l{x}" for x in range(7)], dice.randrange(0, 4))) | ({"k:l0"} if dice.random() < 0.3 else set())
        return labels, set(dice.sample("abcd", dice.randrange(0, 3))), dice.random() > 0.1

    rows = {f"m{i:03}": made(i) for i in range(0, 100, 2)}
    edges, reach = edges_and_reach(frame_of(spark, rows), **settings)
    edges, reach = settle(edges), settle(reach)
    for number in range(2):
        after = dict(rows)
        touched = set()
        for i in dice.sample(range(100), 5):
            name = f"m{i:03}"
            touched.add(name)
            if name in after and dice.random() < 0.4:
                del after[name]
            else:
                after[name] = made(i)
        before = frame_of(spark, {m: r for m, r in rows.items() if m in touched})
        ids = spark.createDataFrame([("p", m) for m in touched], "project_id string, memory_id string")
        added, removed, fresh, stale = edge_changes(frame_of(spark, after), before, ids, edges, reach, **settings)
        edges = settle(edges.join(removed, edges.columns, "left_anti").unionByName(added))
        reach = settle(reach.join(stale, SHAPE, "left_anti").unionByName(fresh))
        rows = after
        got = {(r["src"], r["dst"]): r["similarity"] for r in edges.collect()}
        assert got == pytest.approx(slow_derived(rows, candidates, neighbours, 0.34)), number
        assert edges.count() == len(got)


def test_a_small_change_recomputes_few_records(spark):
    """A new record behind everybody's reach changes nothing but its own edges."""
    rows = {f"m{i:03}": ({"k:all"}, set(), True) for i in range(60)}
    edges, reach = edges_and_reach(frame_of(spark, rows), candidates=10)
    ids = spark.createDataFrame([("p", "z")], "project_id string, memory_id string")
    after = frame_of(spark, {**rows, "z": ({"k:all", "k:new"}, set(), True)})
    added, removed, _, stale = edge_changes(after, frame_of(spark, rows).limit(0), ids, settle(edges), settle(reach), candidates=10)
    assert {r["src"] for r in added.collect()} == {"z"} and removed.isEmpty() and stale.count() == 1


def test_touched_records_of_one_label_set_are_one_row(spark):
    """Every touched record met every shape that shares a label."""
    rows = {f"m{i:03}": ({"k:all", f"k:{i % 2}"}, set(), True) for i in range(60)}
    assert sorted((r["theirs"], r["first"]) for r in _first_ids(frame_of(spark, rows)).collect()) == [
        (["k:0", "k:all"], "m000"), (["k:1", "k:all"], "m001")]


def test_siblings_are_capped_and_projects_stay_apart(spark):
    rows = [(p, f"{p}{i:02}", ["area:x"], ["f"], None) for p in "ab" for i in range(25)]
    rows += [("a", "far", ["area:x", "area:z", "kind:bug"], [], None)]
    df = spark.createDataFrame(
        rows, "project_id string, memory_id string, labels array<string>, files array<string>, archived_at string")
    got = derived_edges(df).collect()
    assert max(len(list(g)) for _, g in itertools.groupby(sorted(r["src"] for r in got))) == 10
    assert all(r["src"][0] == r["dst"][0] for r in got) and "far" not in {r["src"] for r in got}


def test_neighbourhood(spark):
    links = [("a", "b", "related"), ("a", "c", "supersedes"), ("b", "d", "related"), ("a", "x", "derived")]
    edges = spark.createDataFrame([("p", s, d, k) for s, d, k in links], "project_id string, src string, dst string, kind string")
    roots = spark.createDataFrame([("p", "a")], "project_id string, memory_id string")

    def around(**kw):
        nodes, out = graph.neighbourhood(edges, roots, **kw)
        return {r["memory_id"] for r in nodes.collect()}, {(r["src"], r["dst"]) for r in out.collect()}

    assert around(depth=0) == ({"a"}, set())
    assert around(depth=1) == ({"a", "b", "c"}, {("a", "b"), ("a", "c")})
    assert around(depth=2) == ({"a", "b", "c", "d"}, {("a", "b"), ("a", "c"), ("b", "d")})
    assert around(depth=2, max_nodes=2) == ({"a", "b"}, {("a", "b"), ("a", "c")})


def test_neighbourhood_moves_links_to_their_root_once(spark):
    """Every level worked the earlier ones out again and moved its links three times."""
    random.seed(5)
    links = {(f"n{random.randrange(30):02}", f"n{random.randrange(30):02}", random.choice(["related", "supersedes"])) for _ in range(300)}
    edges = spark.createDataFrame([("p", *x) for x in links], "project_id string, src string, dst string, kind string")
    roots = spark.createDataFrame([("p", f"n{i:02}") for i in range(31)], "project_id string, memory_id string")
    for most in (3, 12):
        nodes, _ = graph.neighbourhood(edges, roots, depth=2, max_nodes=most)
        got = {(r["root"], r["memory_id"]): r["level"] for r in nodes.collect()}
        want = {}
        for root in (f"n{i:02}" for i in range(31)):
            have, level = {root: 0}, [root]
            for step in (1, 2):
                via = {}
                for s, d, k in links:
                    if s in level and d not in have:
                        via[d] = min(via.get(d, (k, s)), (k, s))
                level = [d for _, d in sorted((v, d) for d, v in via.items())][:most - len(have)]
                have |= dict.fromkeys(level, step)
            want |= {(root, node): at for node, at in have.items()}
        assert got == want
        assert "Exchange" not in nodes._jdf.queryExecution().toString()


def test_pagerank_moves_numbers_and_keeps_shares_of_links_beyond(spark):
    """A link to what is no node still takes its share along; every round joined and sorted names of 32 letters,
    and worked earlier rounds out again. Two projects may have nodes of one name."""
    nodes = spark.createDataFrame([(p, n) for p in "pq" for n in "abcd"], "project_id string, memory_id string")
    rows = [("p", "a", "b", "related"), ("p", "a", "x", "related"), ("p", "y", "a", "related"), ("p", "b", "c", "derived"),
            ("p", "c", "b", "related"), ("q", "a", "d", "related"), ("r", "a", "b", "related")]
    edges = spark.createDataFrame(rows, "project_id string, src string, dst string, kind string")
    done = graph.pagerank(nodes, edges, iterations=5)
    got = {(r["project_id"], r["memory_id"]): r["rank"] for r in done.collect()}
    weight = {r["kind"]: r["w"] for r in edges.select("kind", graph.edge_weight().alias("w")).collect()}
    want = {}
    for p in "pq":
        w = {}
        for q, a, b, kind in rows:
            for pair in ((a, b), (b, a)):
                if q == p:
                    w[pair] = max(w.get(pair, 0), weight[kind])
        rank = dict.fromkeys("abcd", 0.25)
        for _ in range(5):
            out = {n: sum(x for (a, _), x in w.items() if a == n) for n in rank}
            spilt = sum(rank[n] for n in rank if not out[n])
            rank = {n: graph.RESTART * 0.25 + (1 - graph.RESTART) * (spilt * 0.25 + sum(
                rank[a] * x / out[a] for (a, b), x in w.items() if b == n and a in rank)) for n in rank}
        want |= {(p, n): x for n, x in rank.items()}
    assert got == pytest.approx(want, abs=1e-12)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "RDD" in plan  # the names come back last; no round is worked out again
