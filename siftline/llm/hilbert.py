"""Sharding along a Hilbert curve of metadata.

Language, source and length are quantised to BITS bits each: strings by their share of rows in code-point order, so that codes keep
order and a frequent value gets a code of its own, lengths by powers of two. Rows are ordered by the curve's index of their cell,
inside a cell by a hash of doc_id and text and then doc_id, and the order is cut into runs: shards of row counts at most one apart. A shard
so covers few languages, sources and lengths, and file statistics prune on all three.

Ranks come from counts of cells, and in large cells of slices, runs of the hash, so no task orders more than a few slices, whatever
share of the rows one cell holds. A slice has SLICE rows or fewer, so that each of the session's partitions gets some; the order doesn't
depend on it. Counts of values and slices are summed in one task if they are counted to be few, and else by ranges.

A null text has size 1 (no bytes, plus 1); null languages and sources are a value of their own, before all others. Repeated rows
each get a slot. Rows with the same text keep their own metadata and so may stand apart. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._shared import bounded, partitions, running, settle

SHARDS = 16
BITS = 4
DIMENSIONS = 3
SLICE = 20_000
LAW = "rows"


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """A point's index on the Hilbert curve: bit planes from the highest on exchange or invert the lower bits of the axes, and a Gray
    code of the result is read off plane by plane."""
    x, n = list(point), len(point)
    plane = 1 << (bits - 1)
    while plane > 1:
        below = plane - 1
        for k in range(n):
            if x[k] & plane:
                x[0] ^= below
            else:
                swap = (x[0] ^ x[k]) & below
                x[0] ^= swap
                x[k] ^= swap
        plane >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, plane = 0, 1 << (bits - 1)
    while plane > 1:
        if x[-1] & plane:
            flip ^= plane - 1
        plane >>= 1
    index = 0
    for bit in reversed(range(bits)):
        for v in x:
            index = index << 1 | (((v ^ flip) >> bit) & 1)
    return index


@cache
def curve() -> tuple[int, ...]:
    """The index on the curve of each cell; a cell's coordinates are the digits of its number in base 2^BITS."""
    side = (1 << BITS) - 1
    return tuple(hilbert_index(tuple((cell >> (BITS * (DIMENSIONS - 1 - k))) & side for k in range(DIMENSIONS)), BITS) for cell in range(1 << (BITS * DIMENSIONS)))


def _codes(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """(value, code) of a string column's values: the share of rows before the value's middle, in BITS bits."""
    counts = settle(spark, rows.groupBy(name).agg(F.count("*").alias("n")), "values")
    summed = running(spark, counts, [F.asc_nulls_first(name)], "n", "before")
    code = F.floor((F.col("before") + F.col("n") / 2) * (1 << BITS) / F.col("before_total"))
    return settle(spark, summed.select(F.coalesce(name, F.lit("")).alias(f"{name}_value"), F.col(name).isNull().alias(f"{name}_null"), F.least(code, F.lit((1 << BITS) - 1)).cast("int").alias(f"{name}_code")), "codes")


def _index(cell: Column) -> Column:
    table = F.split(F.lit(",".join(map(str, curve()))), ",")
    return F.get(table, cell).cast("int")


def _described(documents: DataFrame) -> DataFrame:
    """The columns that place a row, before its own columns as a struct."""
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), size.alias("size"), crc.alias("text_crc32"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))


def _placed(rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for name, table in codes.items():
        rows = rows.join(table, (F.coalesce(name, F.lit("")) == F.col(f"{name}_value")) & (F.col(name).isNull() == F.col(f"{name}_null"))).drop(f"{name}_value", f"{name}_null")
    long = F.least(F.floor(F.log2("size")), F.lit((1 << BITS) - 1)).cast("int")
    return rows.withColumn("curve_index", _index((F.col("lang_code") * (1 << BITS) + F.col("source_code")) * (1 << BITS) + long))


def shard_documents(spark: SparkSession, documents: DataFrame, shards: int = SHARDS, whole_rows: bool = True) -> DataFrame:
    """Per row its own columns (whole_rows; a shard or slot of its own is replaced) or doc_id, size, text_crc32 and curve_index, with shard and slot, its place in the shard. Whole rows
    move once, by cell and slice; a text of any length is moved only if asked for."""
    rows = _described(documents)
    narrow = settle(spark, rows.drop("row"), "metadata")
    codes = {name: bounded(_codes(spark, narrow, name)) for name in ("lang", "source")}
    cells = settle(spark, _placed(narrow, codes).select("doc_id", "size", "text_crc32", "curve_index"), "cells")
    # There are at most 2^(BITS * DIMENSIONS) = 4096 cells.
    sums = settle(spark, cells.groupBy("curve_index").agg(F.count("*").alias("n")), "cell-sizes")
    wanted = (sums.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(spark))
    each = min(SLICE, max(wanted, 100))
    slices = F.broadcast(sums.select("curve_index", F.ceil(F.col("n") / each).cast("long").alias("slices")))

    def sliced(x: DataFrame) -> DataFrame:
        hashed = x.withColumn("turn", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 33))
        return hashed.join(slices, "curve_index").withColumn("slice", F.shiftright(F.col("turn") * F.col("slices"), 31)).drop("slices")

    counts = settle(spark, sliced(cells).groupBy("curve_index", "slice").agg(F.count("*").alias("n")), "slice-sizes")
    starts = running(spark, counts, [F.col("curve_index"), F.col("slice")], "n", "start").withColumnRenamed("start_total", "total").drop("n")
    starts = bounded(settle(spark, starts, "starts"))
    inside = Window.partitionBy("curve_index", "slice").orderBy("turn", F.asc_nulls_first("doc_id"), "text_crc32", "size")
    ranked = sliced(_placed(rows, codes) if whole_rows else cells).join(starts, ["curve_index", "slice"]).withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    # Shard s begins at the smallest rank r with r * shards div total = s.
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    slot = (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot")
    own = [F.col(f"row.`{c}`") for c in documents.columns if c.lower() not in ("shard", "slot")]
    return ranked.select(*own, "shard", slot) if whole_rows else ranked.select("doc_id", "size", "text_crc32", "curve_index", "shard", slot)


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One file a shard, in curve order."""
    sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").parquet(path)
