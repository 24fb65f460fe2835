"""Registered queries: labels, search, timeline, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.operators import search as op
from recallspark.sources import testdata as src
from recallspark.suite.ctes import sql

DICT_QUERY = {"all": ["kind:rated"], "any": ["size:small", "size:huge"], "not": "kind:toxic"}
TEXT_QUERY = "(source:src3 OR size:medium) and NOT kind:rated OR source:src7 AND size:large"
NEEDLE = " Thin "


def _light(df: DataFrame) -> DataFrame:
    return df.select("project_id", "slug", "status", F.array_join("labels", ",").alias("labels"),
                     F.length("description").cast("long").alias("chars"))


def label_groups_query(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), label_query=DICT_QUERY, statuses="all"))


def label_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), label_query=TEXT_QUERY))


def label_negation(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), label_query="NOT kind:rated AND NOT size:small",
                            include_archived=True))


def status_default(spark: SparkSession, sf: str) -> DataFrame:
    return op.search(src.memories(spark, sf)).groupBy("project_id", "status").agg(F.count("*").alias("n"))


def status_listed(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), statuses=["wrong", "superseded"]))


def substring(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), text=NEEDLE, statuses="all"))


def search_first(spark: SparkSession, sf: str) -> DataFrame:
    return _light(op.search(src.memories(spark, sf), project="en", label_query={"any": ["size:large", "size:huge"]},
                            limit=20))


def timeline_newest(spark: SparkSession, sf: str) -> DataFrame:
    return op.timeline(src.memories(spark, sf), "en", limit=12, offset=5).select("slug", "created", "status")


def timeline_before(spark: SparkSession, sf: str) -> DataFrame:
    return op.timeline(src.memories(spark, sf), "en", before="doc-96", limit=10).select("slug", "created", "status")


def timeline_after(spark: SparkSession, sf: str) -> DataFrame:
    found = op.timeline(src.memories(spark, sf), "en", after="doc-96", limit=10, statuses="all",
                        label_query="kind:rated")
    return found.select("slug", "created", "status")


def order_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The same keyset scan over orders: the page just before one order."""
    o = src.table(spark, sf, "orders").select(
        F.lit("shop").alias("project_id"), F.col("o_orderkey").cast("string").alias("memory_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("slug"),
        F.col("o_orderdate").cast("date").cast("string").alias("created"),
        F.lit(None).cast("string").alias("archived_at"), F.lit("active").alias("status"),
        F.col("o_orderpriority").alias("description"), F.array("o_orderstatus").alias("labels"),
        F.array("o_orderstatus").alias("tags"), F.array("o_orderstatus").alias("triggers"))
    return op.timeline(o, "shop", before="000000000500", limit=25).select("slug", "created", "description")


def archived_listing(spark: SparkSession, sf: str) -> DataFrame:
    return op.archived(src.memories(spark, sf), "en", limit=15).select("slug", "archived_at")


def registry_groups(spark: SparkSession, sf: str) -> DataFrame:
    labels = src.memories(spark, sf).select("project_id", F.explode("labels").alias("label")).distinct()
    grouped = op.label_groups(labels.withColumn("description", F.concat(F.lit("about "), "label")))
    return grouped.select("project_id", "prefix", F.size("labels").cast("long").alias("n"),
                          F.array_join(F.map_values("labels"), ",").alias("described"))


def contents(spark: SparkSession, sf: str) -> DataFrame:
    return op.project_contents(
        records=src.memories(spark, sf), cached=src.cached(spark, sf), edges=src.authored_edges(spark, sf),
        usage_events=src.usage_events(spark, sf))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every name of both tables resolved: owned wins, else the newest copy."""
    own = src.memories(spark, sf)
    copies = src.cached(spark, sf)
    # Rename a share of the copies after owned records, so the two sides compete.
    tail = F.regexp_extract("slug", r"(\d+)$", 1)
    copies = copies.withColumn(
        "slug", F.when(tail.cast("long") % 3 == 0, F.concat(F.lit("doc-"), tail))
        .when(tail.cast("long") % 3 == 1, F.concat(F.lit("page-"), (tail.cast("long") % 10).cast("string")))
        .otherwise(F.col("slug")))
    names = own.select("project_id", "slug").union(copies.select("project_id", "slug")).distinct()
    return op.lookup(own, copies, names).select(
        "project_id", "slug", "memory_id", "status", F.coalesce("origin", F.lit("")).alias("origin"))


def result_slots(spark: SparkSession, sf: str) -> DataFrame:
    return op.resultable(src.memories(spark, sf), src.cached(spark, sf)).groupBy("project_id", "origin").agg(
        F.count("*").alias("n"), F.min("slug").alias("first_slug"))


QUERIES = {
    "label_dict": label_groups_query,
    "label_expression": label_text_query,
    "label_negation": label_negation,
    "status_default": status_default,
    "status_listed": status_listed,
    "search_substring": substring,
    "search_limit": search_first,
    "timeline_newest": timeline_newest,
    "timeline_before": timeline_before,
    "timeline_after": timeline_after,
    "timeline_orders": order_timeline,
    "archived_listing": archived_listing,
    "label_groups": registry_groups,
    "project_contents": contents,
    "point_lookup": point_lookup,
    "result_slots": result_slots,
}

_LIGHT = ("SELECT project_id, slug, status, array_to_string(labels, ',') AS labels, "
          "length(description) AS chars FROM memories WHERE ")
_LIVE = "archived_at IS NULL"
_DEFAULT = "status IN ('active', 'stale')"


def _has(label: str) -> str:
    return f"list_contains(labels, '{label}')"


ORACLES = {
    "label_dict": sql(
        f"{_LIGHT} {_LIVE} AND {_has('kind:rated')} AND ({_has('size:small')} OR {_has('size:huge')}) "
        f"AND NOT {_has('kind:toxic')}", "memories"),
    "label_expression": sql(
        f"{_LIGHT} {_LIVE} AND {_DEFAULT} AND ((({_has('source:src3')} OR {_has('size:medium')}) "
        f"AND NOT {_has('kind:rated')}) OR ({_has('source:src7')} AND {_has('size:large')}))", "memories"),
    "label_negation": sql(
        f"{_LIGHT} {_DEFAULT} AND NOT {_has('kind:rated')} AND NOT {_has('size:small')}", "memories"),
    "status_default": sql(
        f"SELECT project_id, status, count(*) AS n FROM memories WHERE {_LIVE} AND {_DEFAULT} GROUP BY 1, 2",
        "memories"),
    "status_listed": sql(f"{_LIGHT} {_LIVE} AND status IN ('wrong', 'superseded')", "memories"),
    "search_substring": sql(
        f"{_LIGHT} {_LIVE} AND contains(lower(slug || chr(10) || description || chr(10) || array_to_string(tags, ' ') "
        f"|| chr(10) || array_to_string(labels, ' ') || chr(10) || array_to_string(triggers, ' ')), 'thin')",
        "memories"),
    "search_limit": sql(
        f"{_LIGHT} {_LIVE} AND {_DEFAULT} AND project_id = 'en' AND ({_has('size:large')} OR {_has('size:huge')}) "
        f"ORDER BY slug LIMIT 20", "memories"),
    "timeline_newest": sql(
        f"SELECT slug, created, status FROM memories WHERE {_LIVE} AND {_DEFAULT} AND project_id = 'en' "
        f"ORDER BY created DESC NULLS LAST, slug DESC LIMIT 12 OFFSET 5", "memories"),
    "timeline_before": sql(
        f"SELECT slug, created, status FROM memories WHERE {_LIVE} AND {_DEFAULT} AND project_id = 'en' AND "
        f"(created, slug) < (SELECT (created, slug) FROM memories WHERE slug = 'doc-96') "
        f"ORDER BY created DESC, slug DESC LIMIT 10", "memories"),
    "timeline_after": sql(
        f"SELECT slug, created, status FROM (SELECT * FROM memories WHERE {_LIVE} AND project_id = 'en' AND "
        f"(created, slug) > (SELECT (created, slug) FROM memories WHERE slug = 'doc-96') "
        f"ORDER BY created, slug LIMIT 10) WHERE {_has('kind:rated')}", "memories"),
    "timeline_orders": """
WITH o AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS slug, strftime(o_orderdate, '%Y-%m-%d') AS created,
  o_orderpriority AS description FROM orders)
SELECT * FROM o WHERE (created, slug) < (SELECT (created, slug) FROM o WHERE slug = '000000000500')
ORDER BY created DESC, slug DESC LIMIT 25""",
    "archived_listing": sql(
        "SELECT slug, archived_at FROM memories WHERE archived_at IS NOT NULL AND project_id = 'en' "
        "ORDER BY archived_at DESC, slug DESC LIMIT 15", "memories"),
    "label_groups": sql("""
SELECT project_id, split_part(label, ':', 1) AS prefix, count(*) AS n,
  string_agg('about ' || label, ',' ORDER BY label) AS described
FROM (SELECT DISTINCT project_id, unnest(labels) AS label FROM memories) GROUP BY 1, 2""", "memories"),
    "project_contents": sql("""
SELECT p.project_id, (SELECT count(*) FROM memories m WHERE m.project_id = p.project_id) AS records,
  (SELECT count(*) FROM cached c WHERE c.project_id = p.project_id) AS cached,
  (SELECT count(*) FROM authored e WHERE e.project_id = p.project_id) AS edges,
  (SELECT count(*) FROM usage_events u WHERE u.project_id = p.project_id) AS usage_events
FROM (SELECT project_id FROM memories UNION SELECT project_id FROM cached) p""",
                            "memories", "cached", "authored", "usage_events"),
    "point_lookup": sql("""
SELECT project_id, slug, memory_id, status, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, slug ORDER BY side, cached_at DESC, memory_id) AS rn FROM (
    SELECT project_id, slug, memory_id, status, '' AS origin, 0 AS side, '' AS cached_at FROM memories
    UNION ALL
    SELECT project_id, CASE WHEN k % 3 = 0 THEN 'doc-' || k WHEN k % 3 = 1 THEN 'page-' || (k % 10) ELSE slug END,
      memory_id, status, origin, 1, cached_at
    FROM (SELECT *, CAST(regexp_extract(slug, '(\\d+)$', 1) AS BIGINT) AS k FROM cached))) WHERE rn = 1""",
                        "memories", "cached"),
    "result_slots": sql("""
SELECT project_id, NULL AS origin, count(*) AS n, min(slug) AS first_slug FROM memories WHERE archived_at IS NULL GROUP BY 1
UNION ALL SELECT project_id, origin, count(*), min(slug) FROM cached GROUP BY 1, 2""", "memories", "cached"),
}
