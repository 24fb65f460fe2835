import random

import pytest
from pyspark.sql import functions as F

from recallspark.operators import usage
from recallspark.streaming import usage_stream

EVENTS = "project_id string, memory_id string, replica_id string, day bigint, surfaced bigint, direct bigint, applied bigint, ts string"


def events(spark, days, replica="r"):
    return spark.createDataFrame([("p", "m", replica, d, 1, 0, 0, f"t{d:05}") for d in days], EVENTS)


@pytest.mark.parametrize("days,count,epoch", [
    ([1000, 1000], 1, 1000), ([1000, 1001, 1005, 1030], 4, 1030), ([1000, 1069], 1, 1069),
    ([1000, 1001, 1064], 2, 1064), ([1000, 998], 2, 1000), ([1000, 1063], 2, 1063),
])
def test_window(spark, days, count, epoch):
    row = usage.combine(usage.fold(events(spark, days))).head()
    assert (row["spread_days"], row["spread_epoch"], row["surfaced"]) == (count, epoch, len(days))
    assert -(2**63) <= row["spread_bits"] < 2**63


def test_replicas_or_their_days(spark):
    both = usage.fold(events(spark, [1000])).unionByName(usage.fold(events(spark, [1003], "s")))
    row = usage.combine(both).head()
    assert (row["spread_days"], row["spread_bits"], row["spread_epoch"]) == (2, 0b1001, 1003)
    same = usage.fold(events(spark, [1000])).unionByName(usage.fold(events(spark, [1000], "s")))
    assert usage.combine(same).head()["spread_days"] == 1


def test_fold_ignores_order_and_batching(spark):
    random.seed(7)
    days = [random.randrange(700, 900) for _ in range(200)]
    want = len({d for d in days if max(days) - d < 64})
    assert usage.combine(usage.fold(events(spark, days))).head()["spread_days"] == want
    first, second = usage.fold(events(spark, days[:90])), usage.fold(events(spark, days[90:]))
    added = usage.add_counters(first, second).head()
    whole = usage.fold(events(spark, days)).head()
    assert added["spread_bits"] == whole["spread_bits"] and added["surfaced"] == whole["surfaced"]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([1000, 1001], [1005, 1000]):
        events(spark, part).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    sink, progress = str(tmp_path / "days"), str(tmp_path / "progress")
    usage_stream.start(stream, sink, progress).awaitTermination()
    assert usage_stream.read(spark, sink).collect() == usage.fold(spark.read.parquet(source)).collect()
    # Late events: a restart picks up only what is new.
    events(spark, [1040, 900]).write.mode("append").parquet(source)
    usage_stream.start(stream, sink, progress).awaitTermination()
    assert usage_stream.read(spark, sink).collect() == usage.fold(spark.read.parquet(source)).collect()
    usage_stream.compact(spark, sink, str(tmp_path / "compact"))
    assert usage_stream.read(spark, str(tmp_path / "compact")).collect() == usage.fold(spark.read.parquet(source)).collect()
