"""Exact and near duplicates of crawled documents, and which of a group stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import block_keys, hamming


def new_only(batch: DataFrame, seen: DataFrame, key: str = "content_hash", order: str = "doc_id") -> DataFrame:
    """Rows whose key neither was seen nor came earlier in the batch; rows without a key are new. Copies in the batch are reduced by a
    minimum, not sorted."""
    unseen = batch.filter(F.col(key).isNotNull() & (F.col(key) != "")).join(seen.select(key), key, "left_anti")
    first = unseen.groupBy(key).agg(F.min(order).alias(order))
    return unseen.join(first, [key, order], "left_semi").unionByName(batch.filter(F.col(key).isNull() | (F.col(key) == "")), allowMissingColumns=True)


def _smallest(hashed: DataFrame) -> DataFrame:
    """(simhash, doc_id): the smallest document of each hash. Nulls go after the count, as a filter on the hash itself would be pushed
    below, where it computes each hash twice."""
    return hashed.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("simhash").alias("n")).filter("n > 0").select("simhash", "doc_id")


def near_links(hashed: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, simhash, near_id, distance): for each different hash its smallest document, linked to the smallest of each other hash within
    `most` bits, at most three. Two hashes that near share a key of three blocks; equal hashes are one row before keys are joined, so
    copies make no pairs. The join is by sorting: Spark takes the twenty keys of a hash for one row, and would broadcast them through the
    driver."""
    if most > 3:
        raise ValueError("keys of three of six blocks find hashes that differ in at most three bits")
    one = _smallest(hashed)
    dealt = one.select("doc_id", "simhash", F.explode(block_keys(F.col("simhash"))).alias("b")).select("doc_id", "simhash", "b.band", "b.value")
    other = dealt.select(F.col("doc_id").alias("near_id"), F.col("simhash").alias("near_hash"), "band", "value")
    pairs = dealt.hint("merge").join(other.hint("merge"), ["band", "value"]).filter("doc_id < near_id").withColumn("distance", hamming(F.col("simhash"), F.col("near_hash")))
    return pairs.filter(F.col("distance") <= most).select("doc_id", "near_id", "distance").distinct()


def hash_members(hashed: DataFrame) -> DataFrame:
    """(doc_id, near_id, distance): each document whose hash a smaller one has too, as near_id of the smallest one, at distance 0. With
    `near_links` these rows give every link: two documents are near if their smallest ones are the same or linked. One row a document, as
    copies are not paired with each other. The join is by sorting, as there can be as many different hashes as documents."""
    held = hashed.select(F.col("doc_id").alias("near_id"), F.col("simhash").alias("near_hash"))
    pairs = held.hint("merge").join(_smallest(hashed).hint("merge"), F.col("near_hash").eqNullSafe(F.col("simhash"))).filter("doc_id < near_id")
    return pairs.select("doc_id", "near_id", F.lit(0).alias("distance")).distinct()


def winner_order() -> list[Column]:
    """Trusted dates first, then the earliest, the more trusted source, the longer body, the smallest id."""
    trusted = (F.col("precision") != "unknown").cast("int")
    return [F.desc(trusted), F.asc("published_at"), F.desc("trust"), F.desc("body_len"), F.asc("doc_id")]


def winners(clustered: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row of each cluster, with the cluster's summed engagement. A struct's minimum keeps this a partial aggregate."""
    key = F.struct((F.col("precision") == "unknown").alias("a"), F.col("published_at").alias("b"), (-F.col("trust")).alias("c"), (-F.col("body_len")).alias("d"), F.col("doc_id").alias("doc_id"))
    best = clustered.groupBy(cluster).agg(F.min(key).alias("k"), F.sum("engagement").alias("engagement"), F.count("*").alias("members"))
    return best.select(cluster, F.col("k.doc_id").alias("doc_id"), "engagement", "members")


def confusion(pairs: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall, accuracy and F1 of a yes/no column."""
    t, f = F.col(truth).cast("boolean"), F.col(found).cast("boolean")
    n = lambda c: F.sum(c.cast("long"))
    c = pairs.agg(n(t & f).alias("tp"), n(~t & f).alias("fp"), n(t & ~f).alias("fn"), n(~t & ~f).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def unseen_window(batch: DataFrame, key: str, order: str) -> DataFrame:
    """As `new_only` inside one batch, by window: for small keyed batches."""
    return batch.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")
