"""Quality classifier on document statistics.

Statistics of the whole text are standardised and mapped to random Fourier features, whose inner products approximate a Gaussian
kernel. Partitions sum their parts of the ridge regression's normal equations, the driver adds a bounded number of such sums and
solves them, and isotonic regression on labelled rows that the regression did not see turns its output into a score.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: 0 and 1 fit the regression, 3 the calibration. Only the text is an input of
a score; doc_id, lang, source and labels are not. A null text counts as empty; empty texts get a score from their statistics like
others. Null labels are left out; a doc_id with several labels has their mean, 0.5 counting as 1. Repeated rows each get a row.
Without labels of both kinds the score is the share of good labels (0.5 without any). An empty table gives an empty result. Only
doc_id and text, and of labels doc_id and quality, are read by `score_documents`; `keep_good` keeps all columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._shared import bounded, settle, small_batches, text_of, through_arrow

FEATURES = 256
WIDTH = 6.0
RIDGE = 1e-3
SEED = 17
THRESHOLD = 0.7
FIT_PARTITIONS = 32
BINS = 2000

STATISTICS = ("log_bytes", "log_words", "upper", "digit", "mark", "bar", "bang", "wide", "lines", "word_length", "word_spread", "new_words", "same_next", "same_lines", "new_triples", "top_word", "entropy", "letters_only", "ends", "long_words")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text."""
    data = (text or "").encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = len(words)
    n1, w1 = max(1, n), max(1, w)
    upper, lower, digit = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    wide = int(counts[128:].sum())
    space = int(counts[9:14].sum() + counts[32])
    mark = n - upper - lower - digit - wide - space
    lengths = np.fromiter(map(len, words), np.float64, w)
    different = Counter(words)
    lines = data.split(b"\n")
    shown = counts[counts > 0] / n1
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, w - 2) if w > 2 else 1.0
    return [
        math.log1p(n), math.log1p(w), upper / n1, digit / n1, mark / n1, int(counts[124]) / w1, int(counts[33]) / w1, wide / n1, len(lines) / w1,
        float(lengths.mean()) if w else 0.0, float(lengths.std()) if w else 0.0, math.log(max(1, len(different))) / math.log(w1 + 1.0),
        sum(map(bytes.__eq__, words, words[1:])) / w1, 1 - len(set(lines)) / len(lines), triples, max(different.values(), default=0) / w1,
        float(-(shown * np.log(shown)).sum()), lower / n1, (int(counts[46]) + int(counts[63])) / w1, float((lengths > 14).mean()) if w else 0.0,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py()) for x in batch.column(1)], float).reshape(-1, len(STATISTICS))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])


@dataclass
class Model:
    """What a score needs; its size doesn't depend on the data."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        raw = fourier((x - self.mean) / self.scale) @ self.weights
        if self.steps is None:
            return np.clip(raw, 0, 1)
        return np.interp(raw, *self.steps)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of the given WIDTH, and a constant."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((z.shape[1], FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    features = np.cos(np.clip(z, -8, 8) @ directions + shift) * np.sqrt(2 / FEATURES)
    return np.concatenate([features, np.ones((len(z), 1))], axis=1)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x; the middle and value of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), weight.tolist()):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def fit(spark: SparkSession, described: DataFrame, labels: DataFrame) -> Model:
    """Fit on described documents (doc_id, x) that have labels and are not held out."""
    small_batches(spark)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = settle(spark, described.join(marks, "doc_id").select("x", "y", _fold().alias("fold")).filter("fold <> 2"), "labelled")
    d = len(STATISTICS)
    sums = rows.filter("fold < 2").select("y", *[F.element_at("x", k + 1).alias(f"x{k}") for k in range(d)])
    moments = sums.agg(F.count("*"), F.avg("y"), *[F.avg(f"x{k}") for k in range(d)], *[F.stddev_pop(f"x{k}") for k in range(d)]).first()
    n, prior = moments[0], moments[1]
    if not n or prior in (0.0, 1.0):
        return Model(0.5 if prior is None else float(prior))
    mean = np.array(moments[2 : 2 + d], float)
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in moments[2 + d :]], float)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = fourier((_matrix(batch) - mean) / scale)
                left += z.T @ z
                right += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["l", "r"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1) ** 2), np.zeros(FEATURES + 1)
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1)):
                left += np.frombuffer(one.as_buffer())
                right += np.frombuffer(other.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["l", "r"])

    # Every task sums what it reads; of many such sums, FIT_PARTITIONS tasks add some each, so the driver adds as many at most.
    parts = rows.filter("fold < 2").select("x", "y").mapInArrow(equations, "l binary, r binary")
    if rows.rdd.getNumPartitions() > FIT_PARTITIONS:
        parts = parts.repartition(FIT_PARTITIONS).mapInArrow(added, "l binary, r binary")
    left, right = np.eye(FEATURES + 1) * RIDGE * n, np.zeros(FEATURES + 1)
    for part in parts.toLocalIterator():
        left += np.frombuffer(part[0]).reshape(left.shape)
        right += np.frombuffer(part[1])
    model = Model(float(prior), mean, scale, np.linalg.solve(left, right))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(fourier((_matrix(batch) - mean) / scale) @ model.weights, -1, 2) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(values * BINS).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    # The calibration's points are sums by bin, at most 3 * BINS + 1 rows.
    points = rows.filter("fold = 3").select("x", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    if points:
        x, y, c = (np.array([p[k] for p in points], float) for k in range(3))
        model.steps = isotonic(x / BINS, y / c, c)
    return model


def score_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD)."""
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    described = settle(spark, rows.mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")
    model = fit(spark, described, labels)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(values, 0, 1), pa.float64())], names=["doc_id", "score"])

    scored = described.mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", (_fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier predicts to be good; the text decides, no row moves."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marked = labels.select("doc_id").distinct()
    model = fit(spark, rows.join(bounded(marked), "doc_id", "left_semi").mapInArrow(_statistics, "doc_id long, x array<double>"), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 1000):
                x = np.array([statistics(t.as_py()) for t in texts.slice(at, 1000)], float).reshape(-1, len(STATISTICS))
                yield batch.slice(at, 1000).filter(pa.array(model.score(x) >= THRESHOLD))

    return through_arrow(documents, good)
