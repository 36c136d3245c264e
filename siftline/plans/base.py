"""The tables of a data folder, and the roles that they play in query plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: The time at which plans are evaluated.
NOW = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawled pages: the first line is the title, the source is domain and source_id; dates and scores follow from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.col("source").alias("domain"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language"),
        (NOW - F.col("doc_id") % 400 * 86400).alias("published_at"),
        F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise("day").alias("precision"),
        F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("quality_score"),
        (F.col("doc_id") % 10 / 10.0).alias("spam_score"),
        F.col("n_chars").alias("body_len"),
    )


#: The same as a common table expression.
CRAWLED = f"""crawled AS (
  SELECT doc_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, coalesce(text, '') AS body, source AS domain, source AS source_id,
         lang AS language, {NOW} - doc_id % 400 * 86400 AS published_at, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'day' END AS precision,
         least(1.0, n_chars / 3000.0) AS quality_score, (doc_id % 10) / 10.0 AS spam_score, n_chars AS body_len
  FROM documents)"""

TERMS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}@#_]+'), lambda t: t <> '')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries: the first three words of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 3), " ").alias("query"))


ASKED = r"""asked AS (SELECT item_id AS query_id, array_to_string(string_split_regex(coalesce(text, ''), '\s+')[1:3], ' ') AS query FROM benchmark)"""
