"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that are broadcast.
ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is; counts no further than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
