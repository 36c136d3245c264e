from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.sources.sinks import VersionedTable, letters
from siftline.streaming import streams


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=7 * k), k % 3, "view" if k % 2 else "purchase", float(k), "{}") for k in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for part in range(3):
        frame.filter(F.col("event_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / "e" / str(part)))
    flat = tmp_path / "flat"
    frame.repartition(3).write.parquet(str(flat))
    return str(flat)


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_windows_and_dedup(spark, folder):
    drain(streams.windows(streams.read_events(spark, folder), late="30 days"), "w", "complete")
    assert spark.sql("select sum(n) from w").first()[0] == 60
    keyed = streams.read_events(spark, folder).withColumn("content_hash", F.when(F.col("event_id") < 50, (F.col("event_id") % 5).cast("string")))
    drain(streams.dedup(keyed, late="30 days"), "d")
    assert spark.sql("select count(*) from d where event_id < 50").first()[0] == 5
    assert spark.sql("select count(*) from d where event_id >= 50").first()[0] == 10


def test_revisit_state(spark, folder):
    visits = streams.read_events(spark, folder).select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("changed"))
    drain(streams.revisit_state(visits), "r", "update")
    assert {r.url for r in spark.table("r").collect()} == {"0", "1", "2"}


def test_index_sink(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('{"id":"1","title":"a"}\n{"id":"1","title":"b","indexed_at":5}\n[3]\n')
    jobs = spark.readStream.schema("value string").text(str(tmp_path / "q")).select(F.col("value").alias("payload"))
    table = VersionedTable(spark, str(tmp_path / "t"), "docs")
    query = jobs.writeStream.foreachBatch(streams.index_sink(table, str(tmp_path / "dead"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.id for r in table.read().collect()] == ["1"] and '"b"' in table.read().first().payload
    assert [r.reason for r in letters(spark, str(tmp_path / "dead")).collect()] == ["not_an_object"]
