"""Joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of keys is broadcast; longer ones are joined by a shuffle.
MOST_BROADCAST = 500_000


def checked_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (MOST_BROADCAST), counted first in a job of its own."""
    most = MOST_BROADCAST if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
