"""Grow-only usage counters per replica and the 64-day activity bitmap.

The bitmap an ordered sequence of touches would leave is exactly the set of days
less than 64 before the newest one, so events fold in any order: count per day
first (map-side, which also flattens a record that draws a third of all events),
then align the few days of each counter to its newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallspark.schema import SPREAD_WINDOW

REPLICA = ["project_id", "memory_id", "replica_id"]
RECORD = ["project_id", "memory_id"]


def _shifted(bits: Column, by: Column) -> Column:
    """``bits`` moved ``by`` days into the past; gone once it leaves the window."""
    return F.when(by < SPREAD_WINDOW, F.call_function("shiftleft", bits, by.cast("int"))).otherwise(
        F.lit(0).cast("long"))


def daily(events: DataFrame) -> DataFrame:
    """Events to one row per replica counter and day."""
    ts = F.col("ts")
    return (
        events.where(F.col("surfaced") + F.col("direct") + F.col("applied") > 0)
        .groupBy(*REPLICA, "day")
        .agg(
            F.sum("surfaced").alias("surfaced"),
            F.sum("direct").alias("surfaced_direct"),
            F.sum("applied").alias("applied"),
            F.max(F.when(F.col("surfaced") > 0, ts)).alias("last_surfaced"),
            F.max(F.when(F.col("applied") > 0, ts)).alias("last_applied"),
        )
    )


def from_days(days: DataFrame) -> DataFrame:
    """Daily rows to one counter row per replica."""
    newest = F.max("day").over(Window.partitionBy(*REPLICA))
    one = F.lit(1).cast("long")
    return (
        days.withColumn("spread_epoch", newest)
        .groupBy(*REPLICA)
        .agg(
            F.sum("surfaced").alias("surfaced"),
            F.sum("surfaced_direct").alias("surfaced_direct"),
            F.sum("applied").alias("applied"),
            F.max("last_surfaced").alias("last_surfaced"),
            F.max("last_applied").alias("last_applied"),
            F.bit_or(_shifted(one, F.col("spread_epoch") - F.col("day"))).alias("spread_bits"),
            F.max("spread_epoch").alias("spread_epoch"),
        )
    )


def fold(events: DataFrame) -> DataFrame:
    """Usage events to counter rows per replica."""
    return from_days(daily(events))


def combine(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counter rows of all replicas to one row per record."""
    by = keys or RECORD
    aligned = usage.withColumn("_newest", F.max("spread_epoch").over(Window.partitionBy(*by)))
    return (
        aligned.groupBy(*by)
        .agg(
            F.sum("surfaced").alias("surfaced"),
            F.sum("surfaced_direct").alias("surfaced_direct"),
            F.sum("applied").alias("applied"),
            F.max("last_surfaced").alias("last_surfaced"),
            F.max("last_applied").alias("last_applied"),
            F.bit_or(
                F.coalesce(_shifted(F.col("spread_bits"), F.col("_newest") - F.col("spread_epoch")),
                           F.lit(0).cast("long"))
            ).alias("spread_bits"),
            F.max("spread_epoch").alias("spread_epoch"),
        )
        .withColumn("spread_days", F.bit_count("spread_bits").cast("long"))
    )


def add_counters(usage: DataFrame, more: DataFrame) -> DataFrame:
    """Apply a batch of folded counters to a stored table: sums add, windows OR."""
    return combine(usage.unionByName(more), REPLICA).drop("spread_days")


def by_slug(usage: DataFrame, records: DataFrame) -> DataFrame:
    """Merged counters of owned records; counters of anything else drop out."""
    return combine(usage).join(records.select(*RECORD, "slug"), RECORD)
