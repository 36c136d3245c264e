"""General relational operators that built-ins don't name: as-of joins, range joins, top-k by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time: both sides are merged in order of time, and the last value
    seen is carried on. One exchange by key."""
    a = left.withColumns({"_right": F.lit(0), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, time, value).withColumn("_right", F.lit(1))
    order = Window.partitionBy(key).orderBy(F.col(time), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(F.when(F.col("_right") == 1, F.col(value)), ignorenulls=True).over(order)).filter("_right = 0").drop("_right")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points and the ranges [low, high) that hold them: both are dealt to bins of `width`, so that an equality finds the candidates."""
    a = points.withColumn("_bin", F.floor(F.col(at) / width))
    b = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "_bin").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bin")


def top_k(frame: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the limit is pushed below the exchange."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
