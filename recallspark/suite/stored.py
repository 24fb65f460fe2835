"""Registered queries: what is kept on shared storage between calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.functions.rank import six
from recallspark.session import shared_dir
from recallspark.sources import testdata as src
from recallspark.sources.changes import ChangeLog, change_rows
from recallspark.sources.postings import Postings
from recallspark.suite.ctes import sql
from recallspark.suite.ranking import corpus


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """What a built index holds of every term: its frequency, and over all projects its live postings and blocks' weights."""
    held = Postings.build(corpus(spark, sf), _folder(spark, "index"))
    terms = held._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
    blocks = held._read("postings").groupBy("term").agg(
        F.sum("n").alias("n_live"), F.sum(F.aggregate("fs", F.lit(0.0), lambda a, x: a + x)).alias("weight"), F.min("min_dl").alias("min_dl"))
    return terms.join(blocks, "term", "left").select(
        "term", "df", F.coalesce("n_live", F.lit(0)).alias("n_live"), six(F.col("weight")).alias("weight"), "min_dl")


def bm25_from_index(spark: SparkSession, sf: str) -> DataFrame:
    """Best 50 per question, read from a stored index of two segments: a third of the records came later."""
    rows = corpus(spark, sf)
    path = _folder(spark, "index")
    late = F.pmod(F.xxhash64("memory_id"), F.lit(3)) == 0
    held = Postings.build(rows.where(~late), path)
    held.refresh(rows.where(late), rows.select("project_id", "memory_id").limit(0))
    found = Postings(spark, path).search(src.queries(spark, sf))
    return found.select("query_id", "rn", "memory_id", six(F.col("raw")).alias("score"), six(F.col("text")).alias("text"))


def fold_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Records kept as a base and three changes, read back and, after compaction, read again: both times the same.

    The base has every record as a draft of the first tier; then the graded ones are written, the
    pages come as records, and at last the pages go again and all others are written a second time.
    """
    columns = ["project_id", "memory_id", "slug", "status", "tier", "visibility"]
    final = src.memories(spark, sf).select(*columns)
    draft = final.withColumn("status", F.lit("draft")).withColumn("tier", F.lit(1)).withColumn("visibility", F.lit(None).cast("string"))
    pages = src.cached(spark, sf).select(
        "project_id", "memory_id", "slug", "status", F.lit(0).alias("tier"), F.lit("public").alias("visibility"))
    key = {"kept": ["project_id", "memory_id"]}
    log = ChangeLog(spark, _folder(spark, "log"))
    log.commit("0", whole={"kept": draft}, keys=key)
    log.commit("1", changes={"kept": change_rows(columns, final.where("status <> 'active'"), None)})
    log.commit("2", changes={"kept": change_rows(columns, pages, None)})
    log.commit("3", changes={"kept": change_rows(columns, final.where("status = 'active'"), pages.select(*key["kept"]))})
    folded = log.read("kept").withColumn("read", F.lit("folded"))
    log.compact("4")
    return folded.unionByName(log.read("kept").withColumn("read", F.lit("compacted")))


QUERIES = {
    "fold_changes": fold_changes,
    "index_build": index_build,
    "bm25_from_index": bm25_from_index,
}

ORACLES = {
    "fold_changes": sql("""
SELECT project_id, memory_id, slug, status, tier, visibility, r AS read FROM memories, (VALUES ('folded'), ('compacted')) v(r)""", "memories"),
    "index_build": sql("""
SELECT term, count(*) AS df, count(*) FILTER (c.live) AS n_live, round(sum(f) FILTER (c.live), 6) AS weight,
  min(l.dl) FILTER (c.live) AS min_dl
FROM postings p JOIN corpus c USING (memory_id) JOIN lengths l USING (memory_id) GROUP BY term""", "postings", "corpus", "lengths"),
    "bm25_from_index": sql("""
SELECT query_id, rn, memory_id, round(raw, 6) AS score, round(text, 6) AS text FROM text_top""", "text_top"),
}
