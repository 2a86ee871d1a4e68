"""Frames that may be broadcast because their size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def broadcast_when_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a frame of at most ``limit`` rows; larger ones stay as they are.

    The check reads no more than ``limit + 1`` rows, and a small frame is kept as the
    result of that read instead of being computed a second time.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
