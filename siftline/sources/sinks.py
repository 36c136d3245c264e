"""Sinks: validated index jobs, dead letters, upserts into versioned tables, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_JOB_BYTES, MOST_BATCH_DOCS, MOST_BATCH_BYTES = 1 << 20, 500, 4 << 20


def job_error(payload: Column) -> Column:
    """Why a job can't be indexed, or null: not an object, too large, no id, neither title nor body."""
    get = lambda path: F.coalesce(F.get_json_object(payload, path), F.lit(""))
    return F.when(payload.isNull() | F.coalesce(F.json_object_keys(payload).isNull(), F.lit(True)), "not_an_object").when(F.octet_length(payload) > MOST_JOB_BYTES, "too_large").when(F.trim(get("$.id")) == "", "missing_id").when((F.trim(get("$.title")) == "") & (F.trim(get("$.body")) == ""), "empty")


def split_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good jobs, and bad ones with their reason; each is judged on its own, so one bad job costs no other."""
    judged = jobs.withColumn("reason", job_error(F.col("payload")))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def batches(jobs: DataFrame, lanes: int = 64) -> DataFrame:
    """jobs (id, payload) with lane and batch: in each lane, by id, a batch closes at MOST_BATCH_DOCS rows or MOST_BATCH_BYTES. Lanes are hashes of the
    id, so that no task gets all jobs; a running count that starts anew needs order, and streams in constant memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, batch, n, size = None, 0, 0, 0
        for frame in frames:
            out = []
            for k, b in zip(frame["lane"], frame["bytes"]):
                if k != lane:
                    lane, batch, n, size = k, 0, 0, 0
                elif n >= MOST_BATCH_DOCS or size + b > MOST_BATCH_BYTES:
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + b
                out.append(batch)
            yield frame.assign(batch=out)

    lane = (F.conv(F.left(F.md5("id"), F.lit(6)), 16, 10).cast("long") % lanes).cast("int")
    rows = jobs.select("id", "payload", F.octet_length("payload").alias("bytes"), lane.alias("lane"))
    return rows.repartition("lane").sortWithinPartitions("lane", "id").mapInPandas(run, "id string, payload string, bytes int, lane int, batch int")


def upsert(table: DataFrame | None, rows: DataFrame, key: str = "id", version: str = "indexed_at", newer_only: bool = False) -> DataFrame:
    """The table with rows put in by key; of several rows with one key the newest. Rows older than the table's own are left out if
    `newer_only`, so that a batch which is delivered again, or late, undoes nothing."""
    if newer_only and table is not None:
        known = table.select(F.col(key).alias("_key"), F.col(version).alias("_known"))
        rows = rows.join(known, (rows[key] == known["_key"]) & (known["_known"] > rows[version]), "left_anti")
    order = F.struct(F.col(version), F.xxhash64(*rows.columns).alias("tie"))
    newest = rows.withColumn("_v", order)
    best = newest.groupBy(key).agg(F.max("_v").alias("_v"))
    newest = newest.join(best, [key, "_v"], "left_semi").dropDuplicates([key]).drop("_v")
    return newest if table is None else table.join(newest.select(key), key, "left_anti").unionByName(newest)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


class VersionedTable:
    """Folders name_v1, name_v2 and so on; readers take the newest that is complete, so a new version replaces the old one at once."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._root = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = [int(n[len(self.name) + 2 :]) for n in names if n.startswith(f"{self.name}_v") and n[len(self.name) + 2 :].isdigit()]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in found if self._fs.exists(done(f"{self.root}/{self.name}_v{v}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.root}/{self.name}_v{v[-1]}") if v else None

    def write(self, frame: DataFrame, keep: int = 3) -> int:
        """A new version; beside it the last ones stay, for readers that began before it, and older ones go."""
        v = (self.versions() or [0])[-1] + 1
        frame.write.mode("overwrite").parquet(f"{self.root}/{self.name}_v{v}")
        for old in self.versions()[:-keep]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.name}_v{old}"), True)
        return v

    def put(self, rows: DataFrame, key: str = "id", version: str = "indexed_at") -> int:
        return self.write(upsert(self.read(), rows, key, version, newer_only=True))


def letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("payload string, reason string, at timestamp, batch string").parquet(path).drop("batch")


def bury(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add bad jobs to the dead letters; those of a numbered batch replace what the same batch wrote before."""
    name = uuid.uuid4().hex if batch is None else batch
    rows.select("payload", "reason", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{path}/batch={name}")


def peek(dead: DataFrame, most: int = 20) -> DataFrame:
    return dead.orderBy(F.desc("at"), "payload").limit(most)


def dead_count(dead: DataFrame) -> DataFrame:
    return dead.agg(F.count("*").alias("n"))


def replay(dead: DataFrame, most: int) -> DataFrame:
    """The payloads of the newest letters, to be produced again; the letters are deleted once they are."""
    return peek(dead, most).select("payload")


MAX_QUEUE = 100_000


def trim(queue: DataFrame, most: int = MAX_QUEUE) -> DataFrame:
    """The newest rows (by seq) of a queue; what is older goes."""
    return queue.orderBy(F.desc("seq")).limit(most)


def produce(queue: DataFrame, rows: DataFrame, most: int = MAX_QUEUE) -> DataFrame:
    """The queue (seq, payload) with rows (payload) behind its last: their numbers grow but may leave gaps, as no task counts them all."""
    last = F.broadcast(queue.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last")))
    new = rows.select("payload", F.monotonically_increasing_id().alias("_k")).join(last, F.lit(True))
    return trim(queue.unionByName(new.select((F.col("_last") + 1 + F.col("_k")).alias("seq"), "payload")), most)


def pending(queue: DataFrame, delivered: DataFrame, acked: DataFrame) -> DataFrame:
    """Rows that were delivered (seq) and not yet acknowledged (seq)."""
    return queue.join(delivered.select("seq"), "seq", "left_semi").join(acked.select("seq"), "seq", "left_anti")


def lag(queue: DataFrame, delivered: DataFrame) -> DataFrame:
    """How many rows no consumer has been given."""
    return queue.join(delivered.select("seq"), "seq", "left_anti").agg(F.count("*").alias("n"))


def isolate(rows: list, sink) -> list:
    """Rows that a sink refuses for good, found by halving: the sink takes a list, and raises ValueError if it can't. Every other row is
    taken. Other errors are passed on, as they may not last."""
    if not rows:
        return []
    try:
        sink(rows)
    except ValueError:
        if len(rows) == 1:
            return list(rows)
        half = len(rows) // 2
        return isolate(rows[:half], sink) + isolate(rows[half:], sink)
    return []


def write_report(values: dict, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def settings_diff(old: dict, new: dict) -> dict[str, tuple]:
    """Keys whose canonical JSON differs."""
    text = lambda v: json.dumps(v, sort_keys=True)
    return {k: (old.get(k), new.get(k)) for k in sorted({*old, *new}) if text(old.get(k)) != text(new.get(k))}
