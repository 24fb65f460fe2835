"""Usage events as a stream.

Each micro-batch is folded to per-day partial counters and written under its own
batch number; a batch that is retried after a failure overwrites exactly its own
files. Counters add and days form a set, so partials can be combined in any order
and late events need no watermark: a day outside the window simply sets no bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recallspark.operators import usage

DAYS_DDL = (
    "project_id string, memory_id string, replica_id string, day bigint, surfaced bigint, surfaced_direct bigint, "
    "applied bigint, last_surfaced string, last_applied string"
)


def start(events: DataFrame, sink: str, checkpoint: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Fold a stream of usage events into ``sink``; see :func:`read` for the counters."""
    def write(batch: DataFrame, number: int) -> None:
        usage.daily(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def days(spark: SparkSession, sink: str) -> DataFrame:
    """All partials as one row per counter and day."""
    parts = spark.read.schema(f"{DAYS_DDL}, batch bigint").parquet(sink)
    return parts.groupBy(*usage.REPLICA, "day").agg(
        F.sum("surfaced").alias("surfaced"), F.sum("surfaced_direct").alias("surfaced_direct"),
        F.sum("applied").alias("applied"), F.max("last_surfaced").alias("last_surfaced"),
        F.max("last_applied").alias("last_applied"))


def read(spark: SparkSession, sink: str) -> DataFrame:
    """Counters per replica from everything folded so far."""
    return usage.from_days(days(spark, sink))


def compact(spark: SparkSession, sink: str, target: str) -> None:
    """Rewrite the partials of a long-running stream as one table of days."""
    days(spark, sink).withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(target)
