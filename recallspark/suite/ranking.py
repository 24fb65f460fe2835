"""Registered queries: tokens and text ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.functions.identity import fingerprint, token_hash
from recallspark.functions.rank import six
from recallspark.functions.text import fold_all, slugify, token_set, tokens
from recallspark.operators import index
from recallspark.sources import testdata as src
from recallspark.suite.ctes import sql, tokens as sql_tokens


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Owned records and borrowed copies as index rows."""
    own = src.memories(spark, sf, reading=True)
    own = index.index_rows(
        own.withColumn("live", F.col("archived_at").isNull()).withColumn("origin", F.lit(None).cast("string")),
        index.text_fields(
            F.col("slug"), F.col("description"), F.col("triggers"), F.col("tags"), F.col("labels"),
            scope=[F.col("area"), F.array_join("files", " ")]),
        ["project_id", "memory_id", "slug", "live", "status", "labels", "origin", "area"],
    )
    borrowed = src.cached(spark, sf, reading=True).withColumn("live", F.lit(True)).withColumn("area", F.col("origin"))
    borrowed = index.index_rows(
        borrowed,
        index.text_fields(F.col("slug"), F.col("description"), labels=F.col("labels")),
        ["project_id", "memory_id", "slug", "live", "status", "labels", "origin", "area"],
    )
    return own.unionByName(borrowed)


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = src.texts(spark, sf, "documents", "doc_id").select("lang", "text")
    found = d.select("lang", tokens(F.col("text")).alias("t"), token_set(F.col("text")).alias("u"))
    return found.groupBy("lang").agg(
        F.sum(F.size("t")).alias("n_tokens"),
        F.sum(F.size("u")).alias("n_distinct_per_row"),
        F.sum(F.length(F.array_join("t", ""))).alias("n_chars"),
    )


def page_token_df(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency of every folded token of the raw pages."""
    p = src.texts(spark, sf, "pages", "page_id").select("html")
    terms = p.select(F.explode(F.array_distinct(fold_all(F.col("html"), token_set(F.col("html"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "customer").select("c_custkey", slugify(F.col("c_name")).alias("slug"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = index.bm25(corpus(spark, sf), src.queries(spark, sf))
    return found.select("query_id", "rn", "memory_id", six(F.col("raw")).alias("score"),
                        six(F.col("text")).alias("text"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "customer").select(
        "c_custkey", fingerprint(F.col("c_name")).alias("fingerprint"), token_hash(F.col("c_name")).alias("token_hash"))


QUERIES = {
    "tokenize_stats": token_stats,
    "token_document_frequency": page_token_df,
    "slugify": slugs,
    "fingerprints": fingerprints,
    "bm25_topk": bm25_topk,
}

_T = sql_tokens("text")
ORACLES = {
    "tokenize_stats": f"""
SELECT lang, sum(length(t)) AS n_tokens, sum(length(list_distinct(t))) AS n_distinct_per_row,
  sum(length(array_to_string(t, ''))) AS n_chars FROM (SELECT lang, {_T} AS t FROM documents) GROUP BY lang""",
    "token_document_frequency": f"""
SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_transform({sql_tokens('html')}, lambda t: strip_accents(t)))) AS term
FROM pages) GROUP BY term""",
    "slugify": """
SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM customer""",
    "fingerprints": """
SELECT c_custkey, 'SHA256:' || rtrim(to_base64(unhex(sha256(c_name))), '=') AS fingerprint, sha256(c_name) AS token_hash
FROM customer""",
    "bm25_topk": sql("""
SELECT query_id, rn, memory_id, round(raw, 6) AS score, round(text, 6) AS text FROM text_top""", "text_top"),
}
