"""Token files against the library itself, and what their footers hold."""

from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\n\n", "\n\n\n", "  ", "\t", "\r\n", "\x01", "\x02", "\x1c", "\x85", " ", "​", "　", "<|endoftext|>", "日", "é", "é", "...", "'s", "'S", "foo", "foo,", "foo.", "a,b", "3.14", "ⅷ", "٣", "_", "#", "&&&", "Ünïcode"]


@cache
def _library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return _library()


def _same(library, texts):
    stops, ids = token_orc._encoder(PATH).encode_rows(pa.array(texts, pa.string()), 2)
    for k, text in enumerate(texts):
        assert ids[stops[k] : stops[k + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


def test_rows_encode_as_the_library(library):
    rng = random.Random(4)
    for _ in range(60):
        _same(library, ["".join(rng.choice(ODD) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(40)])


@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_any_rows_encode_as_the_library(texts):
    _same(_library(), texts)


def test_long_texts_are_cut_safely(library, monkeypatch):
    monkeypatch.setattr(token_orc, "PIECE", 25)
    rng = random.Random(6)
    _same(library, ["".join(rng.choice([*ODD, *["word and more "] * 20]) for _ in range(rng.randint(0, 60))) for _ in range(200)])
    assert max(map(len, token_orc.pieces_of("ab cd " * 50))) <= 30 and "".join(token_orc.pieces_of("x" * 100 + " y")) == "x" * 100 + " y"


def test_units_are_forgotten_by_generations(library, monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE_BYTES", 3000)
    encoder = token_orc.Encoder(PATH)
    for k in range(40):
        text = " ".join(f"wort{'abcdefghij'[k % 10]}{'klmnopqrst'[j % 10]}x" for j in range(20))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder._units) + len(encoder._older) < 60


def test_start_follows_the_files(spark, library, tmp_path):
    """Rows with one doc_id and different texts, a null doc_id, and a text far longer than a batch's rows."""
    texts = [(1, "one two three"), (1, "a"), (1, None), (1, "x " * 40_000), (None, "null id"), (3, ""), (2, "<|endoftext|> tail"), (1, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(spark, docs, PATH, path)
    stream = []
    for file in sorted((tmp_path / "tokens").glob("part-*.orc")):
        for row in pa.orc.ORCFile(str(file)).read().to_pylist():
            stream.append((row["doc_id"], row["ids"]))
    assert [d for d, _ in stream] == [None, 1, 1, 1, 1, 1, 2, 3]
    assert sorted(tuple(i) for _, i in stream) == sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in texts)
    want, at = [], 0
    for doc, ids in stream:
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_orc.digest_tokens(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_footers_hold_indexes_and_filters(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(spark, docs, PATH, path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    ranges = []
    for file in sorted((tmp_path / "tokens").glob("part-*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_orc.INDEX_ROWS
        of = reader.getStripeStatistics()
        assert of.size() == reader.getStripes().size() > 0
        for k in range(of.size()):
            ids = of.get(k).getColumnStatistics()[1]
            ranges.append((ids.getMinimum(), ids.getMaximum()))
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            kinds = {(x.getColumn(), x.getKind().toString()) for x in rows.readStripeFooter(reader.getStripes().get(k)).getStreamsList()}
            assert (1, "ROW_INDEX") in kinds and (1, "BLOOM_FILTER_UTF8") in kinds
            assert not any(c > 1 and kind.startswith("BLOOM") for c, kind in kinds)
        rows.close()
    assert ranges == sorted(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and len(ranges) > 1
    plan = token_orc.read_tokens(spark, path).filter("doc_id = 77")
    assert plan.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan._jdf.queryExecution().toString()
