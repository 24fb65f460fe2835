"""The pipeline's stages on a small corpus, each against what its input asks for."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import blocks, pipeline as corpus_pipeline
from tests.llm import brute_force as plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), blocks.read(spark, SF, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stage_columns(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_goes_and_clean_stays(spark, stages):
    labels = {r.doc_id: r.toxic for r in blocks.read(spark, SF, "labels").collect()}
    left = {r.doc_id for r in stages[1].select("doc_id").collect()}
    toxic = [i for i, t in labels.items() if t]
    clean = [i for i, t in labels.items() if not t]
    assert np.mean([i not in left for i in toxic]) > 0.8 and np.mean([i in left for i in clean]) > 0.97


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, _, component in plain.near_copies(rows, 5, 80) if i == component}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_no_repeats_are_left(stages):
    rows = [(r.doc_id, (r.text or "").encode()) for r in stages[2].collect()]
    got = {r.doc_id: r for r in stages[3].collect()}
    assert got.keys() == {i for i, _ in rows}
    for doc, kept in plain.without_repeats(rows, 100):
        assert got[doc].text == kept.decode("utf-8", "ignore")
        assert got[doc].n_chars == len(got[doc].text) or kept == dict(rows)[doc]


def test_mixture_words(stages):
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    before, after = size(stages[3]), size(stages[4])
    want = plain.targets(before)
    longest = max(len((r.text or "").split()) for r in stages[3].collect())
    assert all(abs(after.get(s, 0) - t) <= 2 * longest for s, t in want.items())
    copies = collections.Counter(r.doc_id for r in stages[4].collect())
    assert max(copies.values()) <= 2


def test_encoding(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, None, 0, "y"), (3, "one two three four five six", "en", "a", 27, None),
            (3, "one two three four five six", "en", "a", 27, None), (None, "z", "en", "b", 1, "q"), (5, "ok \U0001f9ff", "en", "b", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 5
    assert corpus_pipeline.repeated_strings(spark, docs, SF).where("doc_id = 1 and text is null").count() == 1
    assert corpus_pipeline.encoding(spark, docs, SF).where("round_trip").count() == 6


def test_one_id_with_different_texts(spark):
    """Texts under one id are told apart: only near copies go, whatever their namesakes are."""
    text, other = "one two three four five six seven eight", "a wholly different text that nothing else is like at all"
    rows = [(1, text), (2, text), (2, other), (3, "first of three under an id"), (3, "second of three under an id is unlike"),
            (3, "second of three under an id is unlike"), (4, "stands alone among all of these")]
    docs = spark.createDataFrame([(*r, "en", "a", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(t for _, t in left) == sorted({t for _, t in rows})
    assert sorted((i, t) for i, t in left if t != text) == sorted({r for r in rows if r[1] != text})


def test_clashing_columns(spark):
    names = ["kept", "kept_text", "removed", "n_bytes", "n_removed", "n_spans", "own", "again", "row"]
    long = "the same words " * 20
    docs = spark.createDataFrame([(i, long, "en", "a", len(long), *names) for i in (1, 2)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = corpus_pipeline.repeated_strings(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert all([r[n] for n in names] == names for r in out.collect())
    assert corpus_pipeline.near_copies(spark, docs, SF).dtypes == docs.dtypes


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and got.count() > 0


def test_toxicity_sends_each_text_once(spark):
    plan = corpus_pipeline.toxicity(spark, blocks.read(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [run(text#" in plan and "MapInArrow" not in plan
