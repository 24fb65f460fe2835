"""Copies borrowed from other servers: refresh and eviction."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from recallspark.functions.rank import top_k
from recallspark.schema import CACHE_MAX_ROWS, CACHE_TTL_DAYS

KEY = ["project_id", "memory_id"]
STAMP_FORMAT = "%Y-%m-%dT%H:%M:%SZ"


def refresh(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by record: newest content wins, the first seen name and creation stamp stay.

    Both frames carry ``project_id, memory_id, slug, status, description, labels,
    origin, created, cached_at``; rows without a record id or name are ignored.
    """
    usable = incoming.where((F.coalesce("memory_id", F.lit("")) != "") & (F.coalesce("slug", F.lit("")) != ""))
    rows = held.withColumn("_new", F.lit(0)).unionByName(usable.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "cached_at", "origin")
    content = F.max_by(F.struct("status", "description", "labels", "origin", "cached_at"), order)
    names = F.min_by(F.struct("slug", "created"), order)
    return rows.groupBy(*KEY).agg(content.alias("c"), names.alias("n")).select(*KEY, "n.*", "c.*")


def retained(
    held: DataFrame, now: str, older_than_days: int = CACHE_TTL_DAYS, keep_most_recent: int = CACHE_MAX_ROWS
) -> DataFrame:
    """What an eviction leaves: copies young enough and among each project's newest.

    Ranking stops at ``keep_most_recent`` rows per project, so the surplus, however
    large, is never sorted.
    """
    oldest = datetime.strptime(now, STAMP_FORMAT) - timedelta(days=max(0, older_than_days))
    cutoff = oldest.strftime(STAMP_FORMAT)
    young = held.where(F.col("cached_at") >= cutoff)
    if keep_most_recent < 1:
        return young.limit(0)
    newest = [F.col("cached_at").desc(), F.col("memory_id")]
    return top_k(young, ["project_id"], newest, keep_most_recent, spread_on="memory_id").drop("rn")


def evicted(held: DataFrame, kept: DataFrame) -> DataFrame:
    return held.join(kept.select(*KEY), KEY, "left_anti")
