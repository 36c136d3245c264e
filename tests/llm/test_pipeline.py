from __future__ import annotations

import pytest

import corpus_pipeline
from siftline.llm import queries
from tests.llm.conftest import PASSAGE, SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(300)]
    texts[10] = texts[11] = texts[4]
    texts[20] = texts[20] + " " + PASSAGE
    texts += [(prose(rng, 8).upper() + "!! ") * 6 for _ in range(100)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300), 0) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = corpus_pipeline.settle(spark, out, "test")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not [i for i in kept["quality classifier"] if i >= 300] and len(kept["quality classifier"]) >= 295
    assert set(kept["quality classifier"]) - set(kept["near-dedup"]) == {10, 11}
    assert set(kept["near-dedup"]) - set(kept["decontamination"]) == {20}
    assert set(kept["source mixing"]) <= set(kept["decontamination"])


def test_run_gives_shards_without_gaps(spark, folder):
    rows = corpus_pipeline.run(spark, folder).select("shard", "slot").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_queries_are_registered():
    import __spark_entry__

    every = __spark_entry__.queries()
    assert {*queries.queries()} <= {*every} and "pipeline" in every
    assert {*__spark_entry__.oracle_sql()} <= {*every}
