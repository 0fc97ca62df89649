"""Size checks in front of broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension with at most this many narrow rows takes a few megabytes.
MAX_BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one beyond that."""
    return df.limit(rows + 1).count() <= rows


def dimension(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is small, else as it is."""
    return F.broadcast(df) if is_small(df, rows) else df
