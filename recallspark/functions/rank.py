"""Per-group ranking helpers that stay safe when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rn",
    spread_on: str | None = None,
    fan: int = 32,
) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1 in column ``rank``.

    Spark trims each map partition to ``k`` rows per group before the shuffle
    (WindowGroupLimit), so a group's reducer sees at most ``k`` rows per task.
    ``spread_on`` adds a salted round first: a group holding a third of the
    table is then sorted by ``fan`` tasks, and the last one sees ``fan * k`` rows.
    The result is the same either way, since ``order`` ends in a unique column.
    """
    if spread_on is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(fan)))
        near = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_near", F.row_number().over(near))
            .where(F.col("_near") <= k)
            .drop("_near", "_salt")
        )
    last = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)


def six(column: Column) -> Column:
    """Round to the six places results are compared at."""
    return F.round(column, 6)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is counted to hold at most ``rows`` rows.

    The count stops at ``rows + 1``. Above it the frame comes back unhinted and
    the join shuffles, with adaptive skew handling.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_of(value: Column, *of: str) -> Column:
    """Whether the value is one of these; a null is none."""
    return F.coalesce(value.isin(*of), F.lit(False))
