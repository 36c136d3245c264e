"""Helpers that the training-data operators share: the shared folder, settled tables and column selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows of a few numbers are broadcast, after they have been counted.
BROADCAST_ROWS = 2_000_000
#: Up to so many rows of a few numbers are ordered by one task, after they have been counted.
ONE_TASK = 200_000
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="siftline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/siftline/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a settled table that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(spark: SparkSession, frame: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it again: this cuts lineage and survives lost executors."""
    path = path or fresh_path(spark, tag)
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python BATCH_ROWS and BATCH_BYTES at a time, or fewer if the session says so: whole texts can be long, and several
    workers share an executor's memory."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, most)


def bounded(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, marked for broadcast if its counted rows are few enough; beyond that Spark shuffles both sides."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def running(spark: SparkSession, frame: DataFrame, order: list[Column], value: str, name: str, small: bool | None = None) -> DataFrame:
    """The frame with the sum of a column over all rows before each, in an order that tells rows apart, as `name`, and over all rows as
    `name`_total. One task does it if the rows were counted to be few (or `small` says so); beyond that the sum inside each range of
    the order is added to that of the ranges before, of which there are as many as partitions."""
    if small is None:
        small = frame.limit(ONE_TASK + 1).count() <= ONE_TASK
    if small:
        whole = Window.orderBy(*order)
        before = F.coalesce(F.sum(value).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return frame.withColumns({name: before, f"{name}_total": F.sum(value).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    dealt = settle(spark, frame.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumnRenamed("_range", "_of")
    over = Window.orderBy("_of")
    starts = sums.select("_of", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{name}_total"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(starts), dealt["_range"] == F.col("_of"))
    return rows.withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_of", "_start")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other code point stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def through_arrow(frame: DataFrame, function) -> DataFrame:
    """mapInArrow of whole rows, all columns, whatever their names: those but doc_id and text have other names on the way."""
    names = [c if c in ("doc_id", "text") else f"_column{k}" for k, c in enumerate(frame.columns)]
    plain = frame.toDF(*names)
    return plain.mapInArrow(function, plain.schema).toDF(*frame.columns)


def partitions(spark: SparkSession) -> int:
    """How many partitions the session's cluster wants after a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
