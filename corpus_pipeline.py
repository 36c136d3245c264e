"""A corpus pipeline: classify quality, drop near-duplicates, drop contaminated documents, mix sources, cut shards.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before it kept. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, hilbert, mixing, neardup, quality
from siftline.llm._shared import drop_path, fresh_path, settle


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest doc_id stays."""
    return neardup.drop_near_duplicates(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix draws it, shard by shard and in the shards' local order."""
    return mixing.ordered(mixing.mix(spark, docs)).select(*_columns(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return hilbert.shard_documents(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: The classifier's fit and the mix are no SQL; tests hold run() against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents; each result is written and read again, and that before it deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{k + 1}")
        docs = settle(spark, stage(spark, docs, sf_dir), f"stage-{k + 1}", path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
