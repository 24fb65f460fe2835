"""Fixed-width UTC stamps kept as strings, compared as strings, aged as instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def instant(stamp: Column) -> Column:
    """Seconds since the epoch, or NULL for anything not in the fixed format."""
    return F.when(stamp.rlike(STAMP), F.unix_timestamp(stamp.try_cast("timestamp")))


def age_days(stamp: Column, now: str) -> Column:
    """Whole days before ``now``; zero for a missing, malformed or future stamp."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - instant(stamp)
    return F.coalesce(F.greatest(F.lit(0), F.floor(seconds / 86400)), F.lit(0)).cast("long")


def within_skew(sent: Column, now: str, seconds: int) -> Column:
    """Whether two clocks agree to within ``seconds``."""
    gap = F.abs(F.unix_timestamp(F.lit(now).cast("timestamp")) - instant(sent))
    return F.coalesce(gap <= seconds, F.lit(False))
