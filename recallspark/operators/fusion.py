"""Reciprocal-rank fusion of per-source rankings, and choosing where a record belongs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recallspark.functions.rank import six, top_k
from recallspark.functions.text import token_set
from recallspark.schema import RRF_K

# --------------------------------------------------------------- fixed values
CONSULTED = "you queried this remote while solving the task"
NO_SIGNAL = "no signal either way"
# ----------------------------------------------------------- end fixed values


def fuse(ranked: DataFrame, limit: int) -> DataFrame:
    """Merge lists by position only.

    ``ranked`` is ``(query_id, source, rank, uuid, slug)`` with ``rank`` from 0;
    rows without a uuid are the same record only within their source. The copy
    kept is the one ranked highest, the first source winning ties.
    """
    keyed = ranked.withColumn(
        "key", F.coalesce(F.nullif("uuid", F.lit("")), F.concat("source", F.lit(":"), "slug")))
    fused = keyed.groupBy("query_id", "key").agg(
        F.round(F.sum(1.0 / (RRF_K + 1 + F.col("rank"))), 12).alias("raw"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.struct("rank", "source", "slug")).alias("best"),
    )
    fused = fused.select(
        "query_id", "key", "raw", "sources", F.col("best.source").alias("source"),
        F.col("best.slug").alias("slug"), six(F.col("raw")).alias("fused_score"))
    return top_k(fused, ["query_id"], [F.col("raw").desc(), F.col("slug"), F.col("key")], limit).drop("raw")


def choose_remote(
    records: DataFrame, remotes: DataFrame, k: int | None = None, consulted: DataFrame | None = None
) -> DataFrame:
    """Enabled destinations of each record, best first: all of them, or the ``k`` best.

    Consulted sources first, then the share of a source's description found in
    the record, then the name. Records meet sources only through shared words; with
    ``k``, the first ``k`` names stand in for sources sharing none. Without ``k`` the
    rows are all sources that have anything to do with the record; all others follow
    them in the order of :func:`rest_of_remotes`, which is the same for every record and
    so is kept once, not per record. ``consulted`` is ``(project_id, memory_id, name)``.
    """
    words = F.array_distinct(F.concat(
        token_set(F.col("description")),
        token_set(F.array_join("triggers", " ")), token_set(F.array_join("labels", " "))))
    mine = records.select("project_id", "memory_id", F.explode(words).alias("word"))
    open_remotes = remotes.where("enabled")
    theirs = open_remotes.select("name", F.explode(token_set(F.col("description"))).alias("word"))
    sizes = open_remotes.select("name", F.size(token_set(F.col("description"))).alias("size"))
    overlap = (
        mine.join(theirs, "word").groupBy("project_id", "memory_id", "name").agg(F.count("*").alias("shared"))
        .join(sizes, "name")
        .select("project_id", "memory_id", "name", (F.col("shared") / F.col("size")).alias("overlap"))
    )
    options = overlap
    if k is not None:
        names = [r["name"] for r in open_remotes.select("name").distinct().orderBy("name").limit(k).collect()]
        options = options.unionByName(records.select(
            "project_id", "memory_id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("name"), F.lit(0.0).alias("overlap")))
    if consulted is not None:
        asked = consulted.join(open_remotes.select("name"), "name", "left_semi").join(
            records.select("project_id", "memory_id"), ["project_id", "memory_id"])
        options = options.unionByName(asked.select("project_id", "memory_id", "name", F.lit(0.0).alias("overlap")))
    options = options.groupBy("project_id", "memory_id", "name").agg(F.max("overlap").alias("overlap"))
    if consulted is not None:
        options = options.join(
            consulted.select("project_id", "memory_id", "name", F.lit(True).alias("_c")).distinct(), ["project_id", "memory_id", "name"], "left")
    else:
        options = options.withColumn("_c", F.lit(None).cast("boolean"))
    options = options.withColumn("consulted", F.coalesce("_c", F.lit(False))).withColumn(
        "description_match", F.round("overlap", 3))
    order = [F.col("consulted").desc(), F.col("description_match").desc(), F.col("name")]
    if k is None:
        best = options.withColumn("rn", F.row_number().over(Window.partitionBy("project_id", "memory_id").orderBy(*order)))
    else:
        best = top_k(options, ["project_id", "memory_id"], order, k)
    return best.select(
        "project_id", "memory_id", F.col("rn").alias("place"), "name", "consulted", "description_match",
        F.when(F.col("consulted"), CONSULTED)
        .when(F.col("overlap") > 0, F.concat(
            F.lit("description overlap "), F.bround(F.col("overlap") * 100).cast("int").cast("string"), F.lit("%")))
        .otherwise(NO_SIGNAL).alias("why"))


def rest_of_remotes(remotes: DataFrame) -> DataFrame:
    """``name, place``: all enabled sources by name, as they follow those that have to do with a record."""
    return remotes.where("enabled").select("name").distinct().withColumn(
        "place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")))


def complete(chosen: DataFrame, remotes: DataFrame, records: DataFrame) -> DataFrame:
    """Every enabled source for each of a few ``records`` (a caller's own, not a table): chosen ones, then the rest."""
    keys = ["project_id", "memory_id"]
    every = records.select(*keys).crossJoin(rest_of_remotes(remotes).withColumnRenamed("place", "_name_place"))
    others = every.join(chosen.select(*keys, "name"), [*keys, "name"], "left_anti")
    many = chosen.groupBy(*keys).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_name_place")) + F.coalesce("_n", F.lit(0))
    return chosen.unionByName(others.join(many, keys, "left").select(
        *keys, place.cast("int").alias("place"), "name", F.lit(False).alias("consulted"), F.lit(0.0).alias("description_match"), F.lit(NO_SIGNAL).alias("why")))
