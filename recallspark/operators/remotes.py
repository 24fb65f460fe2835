"""Changes to the list of publication destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def add(remotes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``remotes`` with the ``fresh`` rows; a known name keeps its standing and takes the new address and description."""
    new = fresh.select("name", *(F.col(c).alias(f"_{c}") for c in remotes.columns if c != "name"))
    both = remotes.join(new, "name", "full")
    first = lambda c: F.coalesce(f"_{c}", c) if c in ("url", "description") else F.coalesce(c, f"_{c}")
    return both.select(*(F.col(c) if c == "name" else first(c).alias(c) for c in remotes.columns))


def enable(remotes: DataFrame, name: str, enabled: bool) -> DataFrame:
    return remotes.withColumn("enabled", F.when(F.col("name") == name, F.lit(enabled)).otherwise(F.col("enabled")))


def remove(remotes: DataFrame, outbox: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(remotes, outbox)`` without the destination and without what waits for it."""
    return remotes.where(F.col("name") != name), outbox.where(F.col("remote") != name)
