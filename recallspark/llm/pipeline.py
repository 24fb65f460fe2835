"""A corpus made ready for training: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. Where an operator needs no settings of its own, the stage runs it with
its defaults: five-word shingles at a similarity of 0.8, 100-byte repeats, a mix of 1.5 times
the words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.llm import blocks, op4_jaccard, op6_mixing, op7_suffix, op9_bpe, op10_toxicity
from recallspark.session import shared_dir

#: No SQL: the first stage is a fitted model. The tests compare each stage with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model is fitted on the labelled ones among ``docs``."""
    model = op10_toxicity.fit(docs, blocks.read(spark, sf_dir, "labels"))
    return docs.where(op10_toxicity.judge(spark, model)(F.col("text"))["score"] < op10_toxicity.THRESHOLD)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows without id all stay.

    Ids that occur once name their row. Where an id repeats, a row is told by its id and text: equal
    texts under one id stay once, different ones are documents of their own, ahead of the others
    of their group, and each stays or goes by its own text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    again = blocks.settle(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")))
    own = F.when(F.col("again"), -F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) - 1).otherwise(F.col("doc_id").cast("bigint"))
    named = docs.select(row, "doc_id", "text").join(again, "doc_id", "left").select(
        "row", "text", own.alias("own"), F.coalesce("again", F.lit(False)).alias("again"))
    found = blocks.settle(op4_jaccard.near_copies(named.select("own", "text"), key="own", words=5, share=80, turns=3))
    gone = blocks.settle(found.where("component_id < own").select("own").distinct())
    left = named.join(gone, "own", "left_anti")
    once = left.where("again").groupBy("own").agg(F.max_by("row", F.xxhash64("row")).alias("row"))
    return left.where("not again").select("row").union(once.select("row")).select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier start already holds; a character cut in two goes whole.

    Untouched texts stay as they are, nulls included; ``n_chars`` follows the text. All other columns
    stay, whatever their names.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    found = op7_suffix.kept(docs.select(others, "doc_id", "text"))
    changed = F.col("n_removed") > 0
    made = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
            "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; equal rows have their times evened out, upwards."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    drawn = op6_mixing.mix(docs.select(key.alias("key"), "text", "source"), key="key")
    times = drawn.groupBy("_key").agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias("_times")).where("_times > 0")
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_key.doc_id")) & (F.xxhash64("text") == F.col("_key.text")))
    return joined.withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, and whether decoding gives the text back."""
    return op9_bpe.encode(docs, check=True).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet folder that the next one reads."""
    docs = blocks.read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
