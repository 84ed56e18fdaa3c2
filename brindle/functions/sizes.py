"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which is counted here; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
