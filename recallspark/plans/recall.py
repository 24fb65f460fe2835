"""Ranked retrieval for a whole batch of questions in one plan.

Text score and graph score are added, cut at ``limit`` on that sum, and only
then scaled by how far each record's status is trusted. Both orders of events
matter: a record that loses its place to a stale one does not get it back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from recallspark.functions.labels import compile_labels
from recallspark.functions.rank import six, top_k
from recallspark.operators import graph
from recallspark.operators.index import bm25
from recallspark.operators.search import status_filter
from recallspark.schema import STATUS_FACTORS, WALK_DEPTH, WALK_SEEDS, RecallError
from recallspark.session import settle
from recallspark.sources.postings import Postings


@dataclass(frozen=True)
class RecallOptions:
    label_query: object = None
    known_labels: frozenset[str] | None = None
    statuses: object = None
    limit: int = 8
    full_count: int = 3
    include_derived: bool = True
    stats_by: tuple[str, ...] = ()
    # Weight of the graph score without and with an anchor record.
    graph_weight: float = 0.3
    anchored_weight: float = 1.0

    def check(self) -> None:
        if self.limit < 1:
            raise RecallError("limit must be >= 1.")
        if self.full_count < 0:
            raise RecallError("full_count must be >= 0.")


def recall(
    index: DataFrame | Postings,
    slots: DataFrame,
    edges: DataFrame,
    queries: DataFrame,
    options: RecallOptions = RecallOptions(),
) -> DataFrame:
    """Best ``limit`` records per question, best first in ``rank``.

    ``index``: a stored index, or rows of :func:`operators.index.index_rows`. ``slots``: what may be
    shown (:func:`operators.search.resultable`). ``edges``: ``project_id, kind,
    src, dst``, similarity edges included. ``queries``: ``query_id, project_id,
    query`` and optionally ``related_id``, the record to explore around.
    """
    options.check()
    if "related_id" not in queries.columns:
        queries = queries.withColumn("related_id", F.lit(None).cast("string"))
    if isinstance(index, Postings):
        if set(options.stats_by) - {"project_id"}:
            raise RecallError("a stored index keeps statistics of all records, or by project")
        found = index.search(queries, by_project=bool(options.stats_by))
    else:
        found = bm25(index, queries, stats_by=list(options.stats_by))
    text = settle(found.select(
        "query_id", "project_id", "memory_id", "text", "rn"))
    seeds = text.where(F.col("rn") <= WALK_SEEDS).select(
        "query_id", "project_id", F.col("memory_id").alias("node"), F.col("text").alias("weight"))
    anchors = queries.where(F.col("related_id").isNotNull()).select("query_id", "project_id", "related_id")
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("total"))
    anchored = anchors.join(total, "query_id", "left").select(
        "query_id", "project_id", F.col("related_id").alias("node"),
        F.greatest(F.lit(1.0), F.coalesce("total", F.lit(0.0))).alias("weight"))
    # An anchor that is also a text match keeps the anchor's weight.
    seeds = settle(seeds.unionByName(anchored).groupBy("query_id", "project_id", "node").agg(
        F.max("weight").alias("weight")))

    depth = WALK_DEPTH if options.include_derived else 1
    pairs = graph.both_ways(graph.walk(edges, seeds, depth=depth))
    ranks = graph.personalized_pagerank(pairs, seeds)
    by_query = Window.partitionBy("query_id")
    peak = F.max("rank").over(by_query)
    near = ranks.select(
        "query_id", "memory_id", (F.col("rank") / F.when(peak == 0, 1.0).otherwise(peak)).alias("graph"))

    asked = queries.select("query_id", "project_id", "related_id")
    blended = (
        text.select("query_id", "memory_id", "text").join(near, ["query_id", "memory_id"], "full")
        .na.fill(0.0, ["text", "graph"])
        .join(asked, "query_id")
        .where(F.col("related_id").isNull() | (F.col("memory_id") != F.col("related_id")))
    )
    weight = F.when(F.col("related_id").isNull(), options.graph_weight).otherwise(options.anchored_weight)
    blended = blended.withColumn("raw", F.col("text") + weight * F.col("graph")).drop("related_id")

    silent = queries.where((F.coalesce("query", F.lit("")) == "") & F.col("related_id").isNull()).select(
        "query_id", "project_id")
    connected = graph.orientation(edges, slots.withColumn("archived_at", F.col("origin")), options.limit * 4)
    oriented = silent.join(connected, "project_id").select(
        "query_id", "memory_id", F.lit(0.0).alias("text"), F.lit(0.0).alias("graph"), "project_id",
        F.col("degree").cast("double").alias("raw"))

    # Nine places: sums that differ only in the last bits are the same score.
    # Settled, the candidates (at most 50 + 2000 per question) are broadcast to the
    # records only if their files are small, and pruned against them otherwise.
    scored = settle(blended.unionByName(oriented).withColumn("raw", F.round("raw", 9)))
    shown = slots.select("project_id", "memory_id", "slug", "status", "labels", "origin").join(
        scored, ["project_id", "memory_id"])
    considered = F.count("*").over(by_query)
    kept = (
        shown.withColumn("considered", considered)
        .where(F.col("raw") > 0).where(status_filter(options.statuses))
        .where(compile_labels(options.label_query, None if options.known_labels is None else set(options.known_labels)).predicate)
    )
    cut = top_k(kept, ["query_id"], [F.col("raw").desc(), F.col("slug"), F.col("memory_id")], options.limit, "place")
    factor = F.lit(1.0)
    for status, trust in STATUS_FACTORS.items():
        factor = F.when(F.col("status") == status, trust).otherwise(factor)
    final = cut.withColumn("factor", factor).withColumn("score", six(F.col("raw") * F.col("factor")))
    order = by_query.orderBy(F.col("score").desc(), "slug", "memory_id")
    return final.select(
        "query_id", "project_id", F.row_number().over(order).alias("rank"), "memory_id", "slug", "status",
        "score", six(F.col("text")).alias("text"), six(F.col("graph")).alias("graph"), "factor", "origin",
        (F.col("place") <= options.full_count).alias("full"), "considered", "labels")


def sightings(results: DataFrame, replica: str, stamp: str, day: int) -> DataFrame:
    """Usage events a ranked answer causes: shown once per question, direct if the text matched."""
    return results.where(F.col("origin").isNull()).groupBy("project_id", "memory_id", "query_id").agg(
        F.lit(1).cast("long").alias("surfaced"),
        F.max((F.col("text") > 0).cast("long")).alias("direct"),
    ).select(
        "project_id", "memory_id", F.lit(replica).alias("replica_id"), F.lit(day).cast("long").alias("day"),
        "surfaced", "direct", F.lit(0).cast("long").alias("applied"), F.lit(stamp).alias("ts"))


def exposures(queries: DataFrame) -> DataFrame:
    """How many more chances to match each project's records have had."""
    return queries.groupBy("project_id").agg(F.count("*").alias("queries"))
