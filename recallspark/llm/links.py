"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recallspark.llm.blocks import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id``: for each id with a link, the smallest id it reaches.

    Every round links each node's neighbours to the smallest node around it, first the
    larger neighbours, then the smaller ones; it ends when a round changes nothing, after
    about as many rounds as the logarithm of the longest path. A node's neighbours are only
    ever aggregated (minimum) and joined, never gathered, so a hub costs no task its list.
    Each round is settled on shared storage; as links fill few bytes of a file, joins go by merging
    and not, by the file's size, through the driver. Links of a node with itself or null are ignored.
    """
    now = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    signature = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = settle(moved.union(smallest.select("u", F.col("m").alias("v"))).distinct())
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == signature:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(
                now.select("v", "v").distinct().toDF("id", "component_id"))
        signature = tuple(got)
