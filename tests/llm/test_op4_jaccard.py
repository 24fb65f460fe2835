"""Jaccard join: against all pairs, with chains, hot groups, tiny sets and odd rows."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.llm import links, op4_jaccard as op


def brute(rows, words, share):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if not text or text.isascii() else re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode()))
        sets.append({tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    component = {i: i for i, _ in rows if i is not None}

    def top(x):
        while component[x] != x:
            x = component[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            i = len(sets[p] & sets[q])
            if rows[p][0] is not None and rows[q][0] is not None and i and 100 * i >= share * (len(sets[p]) + len(sets[q]) - i):
                x, y = sorted((top(rows[p][0]), top(rows[q][0])))
                component[y] = x
    return sorted((i if i is not None else -1, len(s), top(i) if i is not None else -1) for (i, _), s in zip(rows, sets))


def result(df, **options):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1)
                  for r in op.near_copies(df, **options).collect())


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], " ".join(rng.choices(vocabulary, k=25))
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * 0.93))]
            text = " ".join(copy)
            rows.append((len(rows) * 3 % 997, text + (" " + shared if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed, words, share", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_equals_all_pairs(spark, seed, words, share):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df, words=words, share=share) == brute(rows, words, share)


def test_chain_and_hot_groups(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    chain = [(i, " ".join([f"z{j}" for j in range(3 * i)] + base[3 * i:])) for i in range(20)]
    hot = [(1000 + i, "same text of a very common document here") for i in range(80)]
    near = [(2000 + i, " ".join(f"q{j}" if j != i else f"x{rng.random()}" for j in range(90))) for i in range(60)]
    rows = chain + hot + near
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows, 4, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (7, "é É"), (8, "é é"),
            (9, "a b c d e " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("key", F.lit(1))
    assert result(df) == brute(rows, 4, 85)
    assert op.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distance_of_sketches_bounds_the_difference():
    rng = np.random.default_rng(3)
    for share in (85, 80, 60):
        for low, high, d, count in op.bands(share, 3000):
            assert count > d > 0 and low < high
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        a, b = np.sort(rng.choice(pool, 300, False)), np.sort(rng.choice(pool, 300, False))
        of, block, word = op._blocks_of([a, b], 20)
        sketch = np.zeros((2, 20), np.uint64)
        sketch[of, block] = word
        distance = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(300, 300), (None, 5), (301, 302), (302, 301)]
    got = {r.id: r.component_id for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 180)}, 301: 301, 302: 301}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_of_a_crowded_key(spark, monkeypatch):
    """Alike texts, some linked and some not, in keys larger than a cell."""
    monkeypatch.setattr(op, "CELL", 7)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            words[rng.randrange(100)] = f"y{rng.random()}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows, 4, 85)


def test_the_query_works_its_bands_off_in_turns(monkeypatch):
    """The key rows of all bands were on disk at a time."""
    from recallspark.llm import op4_jaccard as op
    asked = {}
    monkeypatch.setattr(op.blocks, "read", lambda *_: None)
    monkeypatch.setattr(op, "near_copies", lambda df, **given: asked.update(given))
    op.query(None, "")
    assert asked == {"turns": op.TURNS} and op.TURNS > 1


def test_what_a_task_holds_is_bounded():
    """A million shingles left out took 50 MB in every Python worker, and long texts came 2,500 or 10,000 at a time."""
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    marks = op.Marks(keys)
    assert marks.flags.nbytes <= 16 << 20 and marks.has(keys).all()
    assert marks.has(keys + np.uint64(1)).mean() < 0.05 and not op.Marks(keys[:0]).has(keys).any()
    texts = ["x" * 3_000_000] * 7 + ["y"] * 6000 + [None, "z" * 20_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])
    got = list(op._portions([batch]))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert max(b.num_rows for b in got) <= op.ROWS
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= op.BYTES for b in got)


def test_shingles_that_several_sets_share():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 9], [2, 3, 4], [2])]
    assert [x.tolist() for x in op._often(sets)] == [[2, 3], [4, 3]]
    assert [len(x) for x in op._often([])] == [0, 0] and [len(x) for x in op._often(sets[:2])] == [0, 0]


@pytest.mark.parametrize("cell", [2000, 4])
def test_members_of_a_key_meet_once_whatever_its_cells(spark, monkeypatch, cell):
    """A key of one cell sends every member once; it sent those outside the largest component twice."""
    monkeypatch.setattr(op, "CELL", cell)
    rng = random.Random(4)
    members = [(k, r, r if r % 3 else 0) for k in range(6) for r in rng.sample(range(40), 3 + 4 * k)]
    sketch = {r: [1 << rng.randrange(60) for _ in range(op.CHECK_CELLS // op.CELLS)] if r % 4 else [7] * (op.CHECK_CELLS // op.CELLS) for r in range(40)}
    sketches = spark.createDataFrame([(r, 100, x) for r, x in sketch.items()], "rep long, n long, sketch array<long>")
    placed = op.placed_in_cells(spark.createDataFrame(members, "key long, rep long, component long"))
    got = {(r.a, r.b) for r in op.close_pairs(placed, sketches, 80).collect()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(sketch[a], sketch[b]))
    of = {}
    for k, r, c in members:
        of.setdefault(k, []).append((r, c))
    want = {(min(a, b), max(a, b)) for x in of.values() for a, c in x for b, d in x if c != d and apart(a, b) * 180 <= 200 * 20}
    assert got == want and want


def test_several_turns_give_the_same(spark):
    rows = corpus(21, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, turns=3) == brute(rows, 4, 85)


def test_sketches_take_little_room(spark):
    """What a task holds besides the sets of its batch does not grow with them, and freed memory goes back."""
    class Source:  # takes the function that a task runs
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = op.set_sizes(Source(), "id", "t", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array([" ".join(f"w{i}x{j}" for j in range(250)) for i in range(4_000)])], ["id", "t"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4_000 and run.__wrapped__ and peak < 55e6, peak


def test_unrelated_sets_share_no_key():
    """Parities of the few elements of a block were alike by chance, in more keys of a text the more texts there were."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in rng.integers(60, 400, 1500)]
    _, keys, _, _ = op.sketch_keys(sets, 80, op.Marks(np.zeros(0, np.uint64)))
    assert len(keys) > 1500 * 20 and len(np.unique(keys)) == len(keys)
    linked = [np.sort(np.append(sets[0][2:], rng.integers(0, 1 << 63, 2, dtype=np.uint64))), sets[0]]
    owner, keys, need, _ = op.sketch_keys(linked, 80, op.Marks(np.zeros(0, np.uint64)))
    assert len(np.intersect1d(keys[owner == 0], keys[owner == 1])) >= need[owner == 1].max() > 1
