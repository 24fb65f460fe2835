"""Near-duplicate nomination over similarity edges, and folding one record into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.functions.rank import top_k
from recallspark.functions.text import token_set
from recallspark.session import settle

# Fields whose text carries the lesson.
COMPARED = ("triggers", "remembered_facts", "solution_pattern", "pitfalls")


def bag(record: DataFrame) -> Column:
    """Distinct tokens of the compared fields."""
    lists = [F.array_join(name, " ") for name in COMPARED if name in record.columns]
    return token_set(F.concat_ws(" ", "description", *lists))


def duplicate_pairs(records: DataFrame, derived: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(project_id, a, b, score)`` for live linked pairs whose token overlap reaches ``threshold``.

    Two bags whose sizes differ by more than the threshold cannot reach it, so
    pairs meet with sizes first and only the survivors fetch their tokens. Bags are
    read by both ends of both joins, so texts are cut into tokens once and written.
    ``score`` is unrounded.
    """
    live = records.where(F.col("archived_at").isNull())
    bags = settle(live.select("project_id", "memory_id", "slug", bag(live).alias("bag")).withColumn("size", F.size("bag")))
    sizes = bags.select("project_id", "memory_id", "size")

    def side(df: DataFrame, end: str, **names: str) -> DataFrame:
        return df.select("project_id", F.col("memory_id").alias(end), *[F.col(k).alias(v) for k, v in names.items()])

    pairs = derived.select(
        "project_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = (
        pairs.join(side(sizes, "a", size="na"), ["project_id", "a"])
        .join(side(sizes, "b", size="nb"), ["project_id", "b"])
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(float(threshold)))
        .where(F.least("na", "nb") > 0)
    )
    full = (
        pairs.join(side(bags, "a", slug="slug_a", bag="bag_a"), ["project_id", "a"])
        .join(side(bags, "b", slug="slug_b", bag="bag_b"), ["project_id", "b"])
    )
    shared = F.size(F.array_intersect("bag_a", "bag_b")).cast("double")
    return (
        full.withColumn("score", shared / (F.col("na") + F.col("nb") - shared))
        .where(F.col("score") >= threshold)
        .select("project_id", F.col("slug_a").alias("a"), F.col("slug_b").alias("b"), "score")
    )


def duplicate_report(pairs: DataFrame, limit: int = 25) -> DataFrame:
    """The strongest ``limit`` pairs of each project."""
    rounded = pairs.withColumn("score", F.round("score", 3))
    return top_k(rounded, ["project_id"], [F.col("score").desc(), F.col("a"), F.col("b")], limit)


def keep_then_new(kept: Column, merged: Column) -> Column:
    """``kept`` as it is, then whatever of ``merged`` it lacks, repeats included."""
    mine = F.coalesce(kept, F.array().cast("array<string>"))
    other = F.coalesce(merged, F.array().cast("array<string>"))
    return F.concat(mine, F.filter(other, lambda x: ~F.array_contains(mine, x)))
