"""Broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500_000


def small(frame: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """A narrow table, marked for broadcast if its counted rows are few enough; beyond that Spark shuffles both sides."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame
