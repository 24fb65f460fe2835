"""Positions in a total order, without sorting any hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A group of equal sort values is dealt into parts of about this share of all rows.
PARTS = 8192


def numbered(df: DataFrame, within: list[str], by: list[str], last: list[Column], salt: Column, total: int) -> DataFrame:
    """``df`` with ``position``, from 0, of each row among those equal in ``within``.

    The order is by ``by`` (few different values: counts of them are summed up), then by the
    part that ``salt`` (a non-negative integer) deals the row to, then by ``last``. Only counts
    of groups are put in order as a whole; rows are sorted within parts, and no part holds more
    than about 1 / ``PARTS`` of the ``total`` rows unless its rows share the salt.
    """
    sizes = df.groupBy(*within, *by).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_parts", F.ceil(F.col("_n") * PARTS / F.lit(max(total, PARTS))).cast("bigint"))
    same = [F.col(c).eqNullSafe(F.col("_r_" + c)) for c in within + by]
    side = sizes.select(*(F.col(c).alias("_r_" + c) for c in within + by), "_parts")
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    dealt = df.join(side, condition).drop(*("_r_" + c for c in within + by)).withColumn("_part", F.pmod(salt, F.col("_parts"))).drop("_parts")
    parts = dealt.groupBy(*within, *by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = before.orderBy(*(F.col(c).asc_nulls_last() for c in by), "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(c).alias("_r_" + c) for c in within + by), F.col("_part").alias("_r__part"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = Window.partitionBy(*within, *by, "_part").orderBy(*last)
    ranked = dealt.withColumn("_row", F.row_number().over(row) - 1)
    return (ranked.join(offsets, condition & (F.col("_part") == F.col("_r__part")))
            .withColumn("position", (F.col("_before") + F.col("_row")).cast("bigint"))
            .drop("_row", "_part", "_before", "_r__part", *("_r_" + c for c in within + by)))
