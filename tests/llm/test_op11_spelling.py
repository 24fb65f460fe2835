"""Spelling variants against pairwise edit distance and a plain reading of the rules."""

import random
import re
import zlib

import numpy as np
import pytest

from recallspark.llm import blocks, op11_spelling as op


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def plain(rows):
    counts = {}
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1:] if h % op.EVERY == 0 else w
            if len(w) >= op.SHORTEST:
                counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= op.LEAST}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= op.TIMES * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in op.variants(op.vocabulary(df)).collect()}


def made_rows(seed, docs=150):
    dice = random.Random(seed)
    stems = ["abcdefgh", "abcdefg", "aaaaaaaa", "aaaaaaaaaaaa", "straßenbahn", "élèveàçü", "xyxyxyxyx"]
    rows = []
    for doc in range(docs):
        words = []
        for _ in range(60):
            w = dice.choice(stems)
            if dice.random() < 0.3:
                i = dice.randrange(len(w))
                w = dice.choice([w[:i] + w[i + 1:], w[:i] + dice.choice("abxé×") + w[i:], w[:i] + dice.choice("abzà") + w[i + 1:]])
            words.append(w if dice.random() < 0.8 else w.upper())
        rows.append((doc, dice.choice([" ", ", ", "1"]).join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = made_rows(3)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_given_documents(spark):
    docs = blocks.read(spark, "/root/testdata/sf0.001", "documents")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("most", [1, 10**9])
def test_splitting_hot_chunks_loses_and_repeats_nothing(spark, most):
    """Words that share a prefix, a suffix or nearly everything, with keys split down to single letters."""
    dice = random.Random(5)
    words = {"counter" + "".join(dice.choice("ab") for _ in range(dice.randint(1, 6))) for _ in range(80)}
    words |= {"".join(dice.choice("ab") for _ in range(dice.randint(1, 4))) + "ableness" for _ in range(30)} | {"a" * n for n in range(7, 16)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in op.near_pairs(df, most_pairs=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_chains_end_at_the_root(spark):
    chain = [("g" + "abcdefg"[:7], 2), ("abcdefg", 30), ("abcdefgh", 400), ("abcdefghi", 5000), ("abcdefghij", 60000)]
    rows = {r.word: r for r in op.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r.root for r in rows.values()} == {"abcdefghij"}
    assert rows["abcdefghij"].form is None and rows["abcdefghi"].form_n == 60000


def test_odd_rows(spark):
    long = "ab" * 30000
    rows = [(None, "wonderful wonderful"), (1, None), (2, ""), (3, "   "), (4, "short wörds 1234567"), (5, f"{long} {long}x {long}"),
            (5, "repeated repeated"), (5, "repeated repeated"), (6, "ÀÈÌÒÙÇÑ ÀÈÌÒÙÇÑ×÷ éééééééé éééééééé"), (7, "MiXeDcAsE mixedcase")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert result(df) == plain(rows)
    assert result(df.limit(0)) == set()


def test_checksums_of_runs():
    buf = np.frombuffer(b"abcdefg" * 40, np.uint8)
    start, end = np.array([0, 3, 5, 100, 7]), np.array([200, 3, 11, 164, 72])
    before = np.array([zlib.crc32(b"1:"), 0, 5, 7, 9], np.uint32)
    want = [zlib.crc32(buf[s:e].tobytes(), int(p)) for s, e, p in zip(start, end, before)]
    assert op.checksums(buf, start, end, before).tolist() == want
