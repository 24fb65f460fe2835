"""Hilbert sharding: the curve itself, the law of rows, pruning, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import blocks, op3_hilbert as op


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 3), (5, 2)])
def test_the_curve_visits_all_cells_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = op.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_law(rows, shards=8):
    count = Counter(r.shard for r in rows)
    if rows:
        assert set(count) <= set(range(shards)) and max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in ordered] == sorted(r.cell for r in rows)


def test_documents(spark):
    docs = blocks.read(spark, "/root/testdata/sf0.01", "documents")
    rows = op.query(spark, "/root/testdata/sf0.01").collect()
    check_law(rows)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_shards_are_narrow(spark):
    df = spark.range(4096).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 1000).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("b"))
    rows = op.shard(df, ["a", "b"], bits=6).collect()
    spread = lambda c: np.mean([max(x) - min(x) for x in ([getattr(r, c) for r in rows if r.shard == s] for s in range(8))])
    assert spread("a") < 1400 and spread("b") < 1400  # of 2000


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "é", "de", None), (5, "x" * 1_000_000, "", "zzzzzzzzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    got = op.shard(op.document_dimensions(df), ["x_lang", "x_source", "x_size", "x_id"], tie="text_crc32").collect()
    check_law(got)
    assert sorted(r["size"] for r in got) == [1, 1, 1, 3, 1_000_001]
    none = op.document_dimensions(df.limit(0))
    assert op.shard(none, ["x_lang", "x_size"]).count() == 0


def test_one_hot_cell(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("a"))
    check_law(op.shard(df, ["a"]).collect())


def test_written_files(spark, tmp_path):
    rows = op.query(spark, "/root/testdata/sf0.001")
    op.write(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
