"""Tokenizer alignment against dense products and whole texts encoded by the libraries."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recallspark.llm import blocks, op13_alignment as op

ODD = [
    None, "", " ", "  ", "a  b", " lead", "tail ", "tail  ", "naïve café 你好吗 \U0001f600", "a▁b ▁ c", "<|endoftext|> <s> </s> <unk>",
    "don't we'll", "x\ty\r\n  z\n\n", "12345 6 7,890.", "\x00 null", "　wide　 space", "a" * 3000, "ﬁ ① é é", "the the the the",
    "  two  gaps   three", "word nbsp word", "a b c",
]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(P.path(op.FIRST))
    one.encode_special_tokens = True
    back = {c: b for b, c in enumerate(op.byte_to_char())}
    a_bytes = {i: bytes(back[c] for c in s) for s, i in one.get_vocab().items()}
    two = sentencepiece.SentencePieceProcessor(model_file=P.path(op.SECOND))

    def spell(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    return one, two, a_bytes, [spell(i) for i in range(two.get_piece_size())]


def plain_one(libraries, text):
    """``a ids, b ids, links, groups`` of one text, byte by byte."""
    one, two, a_bytes, b_bytes = libraries
    if not text:
        return [], [], [], []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    want = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
        return [], [], [], []
    of_a, of_b = [k for k, i in enumerate(a) for _ in a_bytes[i]], [k for k, i in enumerate(b) for _ in b_bytes[i]]
    links = sorted(set(zip(of_a, of_b)))
    groups, ga, gb = [], [], []
    for p in range(len(want)):
        ends_a, ends_b = p + 1 == len(want) or of_a[p + 1] != of_a[p], p + 1 == len(want) or of_b[p + 1] != of_b[p]
        ga += [a[of_a[p]]] * ends_a
        gb += [b[of_b[p]]] * ends_b
        if ends_a and ends_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, links, groups


def plain(libraries, rows):
    docs = [(key, *plain_one(libraries, text)) for key, text in rows]
    counts = {}
    for _, a, b, links, _ in docs:
        for pair in {(a[i], b[j]) for i, j in links}:
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for key, a, b, links, groups in docs:
        each = [(a[i], counts[a[i], b[j]]) for i, j in links]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(n == best[i] for i, n in each), sum(n for _, n in each),
                    hashlib.sha256(spelled.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [op.HOT, 3])
def test_odd_texts(spark, libraries, hot):
    rows = [*enumerate(ODD), (None, "the cat"), (3, "the cat"), (3, "the cat")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, codes string, n_a int")
    assert sorted(map(tuple, op.alignment(df, hot=hot).collect()), key=repr) == plain(libraries, rows)
    assert op.alignment(df.limit(0), hot=hot).count() == 0


def test_given_documents(spark, libraries):
    docs = blocks.read(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, op.alignment(docs, hot=500).collect()), key=repr)
    assert got == plain(libraries, [(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=25), st.text("ab é'\n 1▁", max_size=25)), min_size=1, max_size=4))
def test_pieces_and_whole_agree(libraries, texts):
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    aligner = op.Aligner(*op.files())
    out, row, codes, times = aligner.rows(np.frombuffer(b"".join(raw), np.uint8), offs)
    for r, text in enumerate(texts):
        a, b, links, groups = plain_one(libraries, text)
        assert (out[0][r], out[1][r], out[2][r]) == (len(a), len(b), len(groups))
        want = {}
        for i, j in links:
            code = a[i] * aligner.width + b[j]
            want[code] = want.get(code, 0) + 1
        assert dict(zip(codes[row == r].tolist(), times[row == r].tolist())) == want


def test_products_equal_dense_ones():
    dice = np.random.default_rng(1)
    for _ in range(30):
        x, y = dice.integers(0, 3, (dice.integers(1, 6), 5)), dice.integers(0, 3, (5, dice.integers(1, 6)))

        def sparse(m):
            return op.Csr(np.append(0, np.cumsum((m != 0).sum(1))), np.nonzero(m)[1], m[m != 0], m.shape[1])

        got = op.product(sparse(x), sparse(y))
        dense = np.zeros((x.shape[0], y.shape[1]), int)
        dense[got.rows(), got.col] = got.val
        assert (dense == x @ y).all()
        assert (op.row_sizes(sparse(x), sparse(y)) >= np.diff(got.ptr)).all()
        back = sparse(x).transposed()
        dense = np.zeros((5, x.shape[0]), int)
        dense[back.rows(), back.col] = back.val
        assert (dense == x.T).all()


def test_real_outputs(spark, libraries):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in op.tokens_and_links(df).collect():
        a, b, links, groups = plain_one(libraries, ODD[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(x.a, x.b) for x in r.links] == links and all(x.bytes > 0 for x in r.links)
        assert [(x.a, x.b) for x in r.groups] == groups


def test_shared_group_links(libraries):
    found = op.Aligner(*op.files()).align([b" unbelievable tokenization"])
    got = op.shared_groups(found)
    want = {(i, j) for i, x in enumerate(found.group_a) for j, y in enumerate(found.group_b) if x == y}
    assert set(zip(got.rows().tolist(), got.col.tolist())) == want
