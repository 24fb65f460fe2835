"""The subword lattice against sums over enumerated segmentations, and counts by hand."""

import math
import re
import zlib

import numpy as np
import pytest

from recallspark.llm import blocks, op12_lattice as op


def lower_words(text):
    raw = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % op.FOLDS == op.HELD


def paths(raw, pieces):
    """Every segmentation of ``raw`` as a list of pieces."""
    if not raw:
        return [[]]
    return [[p, *rest] for n in range(1, len(raw) + 1) if (p := raw[:n]) in pieces for rest in paths(raw[n:], pieces)]


def plain(rows, pieces, strength=op.STRENGTH, rounds=op.ROUNDS):
    train, ends = {}, 0
    for doc, text in rows:
        if not held(doc):
            ends += 1
            for w in lower_words(text):
                train[w] = train.get(w, 0) + 1
    tokens = sum(train.values())
    total, kinds, once = tokens + ends, len(train) + (ends > 0), sum(c == 1 for c in train.values())
    zipf = {p: 1 / (1 - s) for p, s in pieces}
    prior = {p: z / sum(zipf.values()) for p, z in zipf.items()}
    known = {w: paths(b" " + w.encode(), prior) for _, text in rows for w in lower_words(text)}

    def weight_of(path, weight):
        return math.prod(weight[p] for p in path)

    weight = prior
    for _ in range(rounds):
        used = dict.fromkeys(prior, 0.0)
        for w, c in train.items():
            each = [weight_of(path, weight) for path in known[w]]
            for path, share in zip(known[w], each):
                for p in path:
                    used[p] += c * share / sum(each)
        n = sum(used.values())
        weight = {p: (used[p] + strength * prior[p]) / (n + strength) for p in prior}
    end = (ends + 1) / (total + 2)
    open_share = (once + 1) / (tokens + 2) if tokens else 1.0
    out = []
    for doc, text in rows:
        words = lower_words(text)
        base = sum(math.log10((train.get(w, 0) + 1) / (total + kinds + 1)) for w in words) + math.log10((ends + 1) / (total + kinds + 1))
        score = math.log10(end)
        for w in words:
            spelled = sum(weight_of(path, weight) for path in known[w])
            own = train.get(w, 0) / tokens if tokens else 0.0
            score += math.log10((1 - end) * (open_share * spelled + (1 - open_share) * own))
        out.append((doc, held(doc), len(words) + 1, sum(w in train for w in words) + (ends > 0), total, base, score))
    return out


def compare(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[5])) for x in (got, want))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-7), (g, w)


@pytest.fixture(scope="module")
def pieces():
    return op.scored_pieces(op.vocabulary_file())


ROWS = [
    (None, "the Cat sat"), (1, None), (2, ""), (3, " \n\t "), (4, "the the THE élan 你好 \U0001f600"), (5, "unseen\x0bwords\x0chere"),
    (5, "the cat"), (5, "the cat"), (6, "a b ▁ x▁y"), *((i, f"word{i % 7} the cat sat on it") for i in range(7, 40)),
]


@pytest.mark.parametrize("hot", [op.HOT, 2])
def test_equals_enumerated_segmentations(spark, pieces, hot):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, score int, word string")
    got = op.score(df, hot=hot)
    compare(got.collect(), plain(ROWS, pieces))
    assert op.score(df.limit(0), hot=hot).count() == 0


def test_no_training_documents(spark, pieces):
    rows = [(i, "the cat") for i in range(60) if held(i)]
    compare(op.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain(rows, pieces))


def test_every_piece_is_found_where_it_stands(pieces):
    lattice = op.Lattice(pieces)
    words = [b" the", b" internationalisation", " élèves".encode(), " 你好".encode(), b" \x00\x7f", b" " + b"ab" * 40]
    buf, offs = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
    start, end, piece = lattice.arcs(buf, offs)
    got = {(s, e, lattice.strings[p]) for s, e, p in zip(start.tolist(), end.tolist(), piece.tolist())}
    known, want = dict(pieces), set()
    for at, w in zip(offs.tolist(), words):
        want |= {(at + i, at + j, w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in known}
    assert got == want


def test_training_texts_make_held_out_ones_likelier(spark):
    """Against the vocabulary's own scores alone; and known words cost about what the base says."""
    docs = blocks.read(spark, "/root/testdata/sf0.001", "documents")
    rows = op.score(docs).collect()
    untrained = {r.doc_id: r.score for r in op.score(docs, rounds=0).collect()}
    held = [r for r in rows if r.held_out]
    assert held and all(r.score < 0 and r.n_known <= r.n_tokens for r in rows)
    assert sum(r.score for r in held) > sum(untrained[r.doc_id] for r in held)
    known = [r for r in rows if r.n_known == r.n_tokens]
    assert abs(sum(r.score - r.base_score for r in known)) < 0.1 * -sum(r.base_score for r in known)


def test_a_very_long_word(spark):
    rows = [(1, "ab" * 20000), (2, "x " * 5)]
    got = {r.doc_id: r for r in op.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 2 and math.isfinite(got[1].score)


def test_words_of_a_slice():
    texts = [b"A b  a", b"", b"B\ta"]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    names, word, row = op._words(buf, offs)
    assert [names.to_pylist()[w] for w in word] == ["a", "b", "a", "b", "a"] and row.tolist() == [0, 0, 0, 2, 2]
    assert not blocks.SPACE[ord("a")]
