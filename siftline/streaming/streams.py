"""Streams: exact dedup, near dedup against a table, validated sinks, windows, revisit and politeness state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.functions.text import bands, hamming
from siftline.operators.crawl import DAY, Bounds
from siftline.sources.sinks import VersionedTable, bury, split_jobs


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 4, glob: str = "*.parquet") -> DataFrame:
    """Events as a stream; their times get a zone, as watermarks need it."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(stream: DataFrame, key: str = "content_hash", time: str = "ts", late: str = "1 day") -> DataFrame:
    """First rows by key within the watermark; rows without a key pass."""
    named = stream.withColumn("_key", F.coalesce(F.nullif(F.col(key), F.lit("")), F.expr("uuid()")))
    return named.withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def near_dedup_batch(batch: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """Rows of a micro-batch with near_id, the smallest known document within `most` bits; copies in the batch count as one hash."""
    hashes = batch.select("simhash").distinct().withColumn("b", F.explode(bands(F.col("simhash"))))
    old = known.groupBy("simhash").agg(F.min("doc_id").alias("near_id")).withColumn("b", F.explode(bands(F.col("simhash")))).withColumnRenamed("simhash", "old")
    found = hashes.join(old, "b").filter(hamming(F.col("simhash"), F.col("old")) <= most).groupBy("simhash").agg(F.min("near_id").alias("near_id"))
    return batch.join(found, "simhash", "left")


def index_sink(table: VersionedTable, dead_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: good jobs are upserted by id, bad ones go to the dead letters; a repeated batch changes
    nothing in either."""

    def run(batch: DataFrame, number: int) -> None:
        good, bad = split_jobs(batch)
        rows = good.select(F.get_json_object("payload", "$.id").alias("id"), F.col("payload"), F.coalesce(F.get_json_object("payload", "$.indexed_at").cast("long"), F.lit(0)).alias("indexed_at"))
        table.put(rows)
        bury(bad, dead_path, number)

    return run


def windows(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding windows of event time."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def revisit_state(stream: DataFrame, bounds: Bounds = Bounds(), start: int = DAY) -> DataFrame:
    """The revisit interval of each URL as a stream (url, ts, changed) and perhaps trust, kept as state across micro-batches: the same rule
    as `crawl.revisit`, with the bounds of the trust (of middle trust without one)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        visits = pd.concat(list(frames)).sort_values("ts")
        floor, ceiling = bounds.of(int(visits["trust"].max()) if "trust" in visits and visits["trust"].notna().any() else 50)
        interval, streak, volatile = state.get if state.exists else (min(max(start, floor), ceiling), 0, False)
        for changed in visits["changed"]:
            streak = streak + 1 if changed and interval <= floor else 0
            volatile = volatile or streak >= 4
            interval = ceiling if volatile else min(max(interval // 2 if changed else interval + floor, floor), ceiling)
        state.update((int(interval), int(streak), bool(volatile)))
        yield pd.DataFrame({"url": [key[0]], "interval_s": [int(interval)], "volatile": [bool(volatile)]})

    return stream.groupBy("url").applyInPandasWithState(run, "url string, interval_s long, volatile boolean", "interval long, streak int, volatile boolean", "update", GroupStateTimeout.NoTimeout)
