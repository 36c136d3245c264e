"""Autocomplete: a weighted prefix index and the merge of several legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import fold_plain, trim_title
from siftline.operators.sizes import small


def build(curated: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, term, weight): curated terms at .9 of their weight, titles at 1; of each folded key the heaviest."""
    rows = curated.select("term", (F.col("weight") * 0.9).alias("weight")).unionByName(titles.select(trim_title(F.col("title")).alias("term"), F.lit(1.0).alias("weight")))
    keyed = rows.withColumn("key", fold_plain(F.col("term"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.max(F.struct("weight", "term")).alias("x")).select("key", "x.term", "x.weight")


def by_prefix(index: DataFrame, prefixes: DataFrame, limit: int = 8) -> DataFrame:
    """Of each (query_id, prefix) of two characters and more the first 8 * limit keys in order, then the heaviest, shortest first. Keys and prefixes
    are joined by their first two characters; prefixes are a bounded batch."""
    asked = prefixes.withColumn("folded", fold_plain(F.col("prefix"))).filter(F.length("folded") >= 2).withColumn("head", F.left("folded", F.lit(2)))
    found = index.withColumn("head", F.left("key", F.lit(2))).join(small(asked), "head").filter(F.startswith("key", "folded"))
    scanned = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("key"))).filter(F.col("k") <= 8 * limit)
    return scanned.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), F.length("term"), "term"))).filter(F.col("rank") <= limit).select("query_id", "key", "term", "weight", "rank")


def merge(legs: DataFrame, limit: int = 8) -> DataFrame:
    """Of (query_id, key, term, weight): the heaviest of each key in order of weight, length and text, without keys that are strict prefixes
    of a key kept before."""
    one = legs.groupBy("query_id", "key").agg(F.max(F.struct("weight", "term")).alias("x")).select("query_id", "key", "x.term", "x.weight")
    ordered = one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), F.length("term"), "term"))).filter(F.col("place") <= 8 * limit)
    a, b = ordered.alias("a"), ordered.alias("b")
    shadowed = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.place") < F.col("a.place")) & (F.length("b.key") > F.length("a.key")) & F.startswith(F.col("b.key"), F.col("a.key")), "left_anti")
    return shadowed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("rank") <= limit).select("query_id", "key", "term", "weight", "rank")
