"""Relevance measures of ranked results against graded judgements, reports and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(grade: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1.0)


def measures(results: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """Per query of golden (query_id, doc_id, grade): ndcg and recall (null without relevant judgements) and mrr of results
    (query_id, doc_id, pos from 1)."""
    top = results.filter(F.col("pos") <= k)
    seen = top.join(golden, ["query_id", "doc_id"], "left")
    got = seen.groupBy("query_id").agg(F.sum(_gain(F.coalesce("grade", F.lit(0)), F.col("pos"))).alias("dcg"), F.min(F.when(F.col("grade") >= 2, F.col("pos"))).alias("first_good"), F.sum((F.coalesce("grade", F.lit(0)) > 0).cast("long")).alias("good"), F.sum(F.col("grade").isNull().cast("long")).alias("unjudged"), F.count("*").alias("results"))
    ideal = golden.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place")))).alias("idcg"), F.sum((F.col("grade") > 0).cast("long")).alias("relevant"))
    rows = ideal.join(got, "query_id", "left")
    ndcg = F.when(F.col("idcg") > 0, F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")))
    return rows.select("query_id", ndcg.alias("ndcg"), F.coalesce(1.0 / F.col("first_good"), F.lit(0.0)).alias("mrr"), F.when(F.col("relevant") > 0, F.coalesce("good", F.lit(0)) / F.col("relevant")).alias("recall"), F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("unjudged", F.lit(0)).alias("unjudged"))


def report(measured: DataFrame, by: str | None = None) -> DataFrame:
    """Means (those of ndcg and recall over judged queries only), zero-result rate and unjudged results, of all and by language."""
    out = measured.rollup(by) if by else measured.groupBy()
    return out.agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"), F.avg("recall").alias("recall"), F.avg((F.col("results") == 0).cast("double")).alias("zero_rate"), F.sum("unjudged").alias("unjudged"))


def age_bucket(now: Column, published: Column) -> Column:
    days = F.floor(F.abs(now - published) / 86400) * F.signum(now - published)
    return F.when(F.coalesce(published, F.lit(0)) <= 0, "unknown").when(days < 0, "future").when(days <= 1, "0-1d").when(days <= 7, "2-7d").when(days <= 30, "8-30d").when(days <= 365, "31-365d").otherwise("365d+")


def grade_by_coverage(share: Column) -> Column:
    return F.when(share >= 0.99, 3).when(share >= 0.6, 2).when(share > 0, 1).otherwise(0)


def regressed(new: float, old: float, tolerance: float = 0.01) -> bool:
    """Whether ndcg fell by more than the tolerance, relatively."""
    return old > 0 and (old - new) / old > tolerance


def drifted(golden_size: int | None, corpus_size: int, tolerance: float = 0.2) -> bool:
    """Whether the corpus is no longer the one that was judged."""
    return golden_size is not None and abs(corpus_size - golden_size) > tolerance * golden_size
