"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from recallspark.llm import blocks, op9_bpe
import numpy as np

ODD = [
    None, "", " ", "  a", "a  b", "a  b", "  b", " \n\n x\ty ", "it's  we'll 's", "café naïve 你好", "\U0001f600\U0001f600 ok",
    "<|endoftext|> x", "1234 5 6a", "a\x1cb \x85 c", "　   wide", "a" * 5000, "  z", "tail ", "tail  ", "\r\n a",
    " Â á ก あ",
]


@pytest.fixture(scope="module")
def library():
    with open(P.path(op9_bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "y")], "doc_id long, text string, n_tokens string")
    rows = op9_bpe.encode(df, digests=True).collect()
    assert len(rows) == len(ODD) + 1
    for row in rows:
        text = ("a b" if row.doc_id is None else ODD[row.doc_id]) or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_given_documents(spark, library):
    docs = blocks.read(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: library.encode_ordinary(r.text) for r in docs.collect()}
    got = {r.doc_id: r.ids for r in op9_bpe.encode(docs).collect()}
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_pieces_and_whole_agree(library, texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = op9_bpe.Encoder(op9_bpe.rank_file()).rows(np.frombuffer(b"".join(raw), np.uint8), offs)
    for text, (ids, decoded) in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert decoded.decode() == text


def test_decode_handles_split_characters_and_bad_ids(spark, library):
    ids = library.encode_ordinary("\U0001f9ff ok")
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, []), (5, [None, -1, 10**9, ids[-1]])], "doc_id long, ids array<long>")
    got = {r.doc_id: (bytes(r.bytes), r.text) for r in op9_bpe.decode(df).collect()}
    assert got[1][1] == "\U0001f9ff ok" and "�" in got[2][1]
    assert got[3] == got[4] == (b"", "") and got[5][1] == " ok"


def test_offsets_name_the_characters(spark):
    text = "naïve \U0001f9ff end"
    row = op9_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), offsets=True).first()
    assert row.starts[0] == 0 and row.ends[-1] == len(text)
    assert all(a < b for a, b in zip(row.starts, row.ends))


def test_empty_table(spark):
    assert op9_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
