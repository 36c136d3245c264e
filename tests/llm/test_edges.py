"""Null ids, nulls in every column, long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import decontaminate, hilbert, licenses, mixing, neardup, quality
from tests.llm.conftest import PASSAGE, SCHEMA, make_rows, prose


@pytest.fixture(scope="module")
def odd(spark):
    """All rows of the common table, rows without an id, rows without anything, and one text far longer than a batch."""
    import random

    rng = random.Random(1)
    long = prose(rng, 60_000)
    rows = [*make_rows(), (None, "one of no id", "en", "a", 12), (None, "one of no id", "en", "a", 12), (None, None, None, None, None), (900, long, None, "hot", None), (901, long, "en", "hot", len(long)), (900, "other text of a known id", "en", "b", 3)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _ids(frame):
    return sorted((r[0] is not None, r[0] or 0) for r in frame.select("doc_id").collect())


def test_every_operator_keeps_every_row(spark, odd):
    rows, docs = odd
    want = sorted((r[0] is not None, r[0] or 0) for r in rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (None, PASSAGE), (3, "no id")], "item_id long, text string")
    scored = quality.score_documents(spark, docs, labels)
    assert _ids(scored) == want and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in scored.collect())
    scanned = licenses.summarise(licenses.scan_licenses(spark, docs))
    assert _ids(scanned) == want and scanned.filter("doc_id = 900").agg(F.max("n_words")).first()[0] == 60_000
    taken = mixing.taken_words(spark, docs).collect()
    assert len(taken) == len(rows) and all(r.taken <= 3 * r.size for r in taken)
    assert _ids(hilbert.shard_documents(spark, docs, whole_rows=False)) == want
    marked = decontaminate.mark_contaminated(spark, docs, benchmark)
    assert _ids(marked) == want and marked.filter("doc_id = 901").first().n_words == 60_000
    assert {tuple(r["items"]) for r in marked.filter("n_hit > 0 and doc_id is null").collect()} == {("3",)}
    linked = neardup.link_documents(spark, docs)
    assert _ids(linked) == want
    found = {(r.doc_id, r.n_shingles): r.component_id for r in linked.collect()}
    assert {c for (d, n), c in found.items() if d in (900, 901) and n > 1000} == {900} and all(c is None for (d, _), c in found.items() if d is None)


def test_stages_take_odd_tables(spark, odd, tmp_path):
    """Each stage on rows with nulls and extra columns whose names stages use themselves, and on no rows; what they give can be written."""
    _, docs = odd
    folder = str(tmp_path)
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = ["size", "label", "node", "part", "sub", "row", "rank", "shard", "slot", "mix_shard", "mix_key", "Slice", "turn", "weird.name"]
    clashing = docs.withColumns({c: F.lit("extra") for c in extra})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name, table in (("rows", clashing), ("none", clashing.limit(0))):
            out = stage(spark, table, folder)
            if k < 4:
                assert out.columns == table.columns
            else:
                assert sorted(out.columns) == sorted(table.columns)
            out.write.parquet(f"{folder}/{k}-{name}")
            again = spark.read.parquet(f"{folder}/{k}-{name}")
            assert again.count() == (0 if name == "none" else again.count()) and again.columns == out.columns
            if k in (1, 2, 4) and name == "rows":
                assert again.filter("doc_id is null").count() == 3


@pytest.mark.parametrize("most", [32, 2])
def test_scores_as_plain_equations(spark, monkeypatch, most):
    """The model fitted from partition sums, or from sums of these, is the one that the whole matrix gives."""
    import random

    monkeypatch.setattr(quality, "FIT_PARTITIONS", most)

    rng = random.Random(12)
    rows = []
    for k in range(400):
        good = rng.random() < 0.6
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        rows.append((k, " ".join(w) + "." if good or rng.random() < 0.2 else (" ".join(w[:4]) + "!! ") * 5, int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    x = np.array([quality.statistics(r[1]) for r in rows])
    y = np.array([r[2] for r in rows], float)
    fold = np.array([zlib.crc32(str(r[0]).encode()) % 4 for r in rows])
    fit = fold < 2
    mean, scale = x[fit].mean(0), x[fit].std(0)
    z = quality.fourier((x - mean) / np.where(scale > 1e-9, scale, 1.0))
    weights = np.linalg.solve(z[fit].T @ z[fit] + quality.RIDGE * fit.sum() * np.eye(z.shape[1]), z[fit].T @ y[fit])
    raw = z @ weights
    bins = np.round(np.clip(raw[fold == 3], -1, 2) * quality.BINS)
    at, place = np.unique(bins, return_inverse=True)
    count = np.bincount(place)
    steps = quality.isotonic(at / quality.BINS, np.bincount(place, y[fold == 3]) / count, count.astype(float))
    want = np.clip(np.interp(raw, *steps), 0, 1)
    got = {r.doc_id: r.score for r in quality.score_documents(spark, docs, labels).collect()}
    assert max(abs(got[k] - want[k]) for k in range(400)) < 1e-6
