from __future__ import annotations

import hashlib
import random
import re
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from siftline.llm import hilbert, html_blocks, mixing, warc
from siftline.llm._shared import fresh_path
from tests.llm.conftest import make_rows

# --- mixing


def _plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, limit, target = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, {}
    free = set(order)
    while True:
        rest = total - sum(limit[s] for s in order if s not in free)
        whole = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / whole > limit[s] + 1e-9}
        if not over:
            return {s: rest * weight[s] / whole if s in free else limit[s] for s in order}
        free -= over


def test_mix_comes_near_its_targets(spark, documents, rows):
    got = mixing.taken_words(spark, documents).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = _plain_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        assert len(r.shards) * r.size == r.taken
        taken[s] += r.taken
    largest = max(size(r[1]) * sum(x == r for x in rows) for r in rows)  # repeated rows are drawn together
    assert all(abs(taken[s] - want[s]) <= max(largest / 2, 0.02 * want[s]) for s in sizes)
    again = mixing.taken_words(spark, documents.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixed_rows_are_the_draws(spark, documents):
    mixed = mixing.ordered(mixing.mix(spark, documents))
    assert mixed.columns == [*documents.columns, "mix_shard", "mix_key"]
    rows = mixed.groupBy("doc_id").count().collect()
    times = {r.doc_id: len(r.shards) for r in mixing.taken_words(spark, documents).dropDuplicates(["doc_id"]).collect()}
    twice = {9, 20}
    assert all(r["count"] == times[r.doc_id] * (2 if r.doc_id in twice else 1) for r in rows)
    assert mixed.agg(F.min("mix_shard"), F.max("mix_shard")).first()[1] < 16


def test_leaves_decide_what_shards_take(spark, documents):
    """The tree's leaves share all draws evenly, source by source they are what a shard's rows come from, and no text is shuffled."""
    sized = mixing.sized_documents(documents).cache()
    draws, _ = mixing.plan(spark, sized)
    draws = [tuple(r) for r in draws.select("source", "pass", "part", "sub", "shard").collect()]
    units = {(s, p, b, shard) for s, p, b, _, shard in draws}
    assert len(units) == len({u[:3] for u in units})
    size = [sum(u[3] == k for u in units) for k in range(16)]
    assert max(size) - min(size) <= 4  # a coin at each of the four levels
    want = {}
    for r in sized.collect():
        for s, _, b, sub, shard in draws:
            if s == r.source and b == r.part and sub in (None, r["sub"]):
                want[r.doc_id, shard] = want.get((r.doc_id, shard), 0) + 1
    mixed = mixing.mix(spark, documents)
    assert {(r.doc_id, r.mix_shard): r["count"] for r in mixed.groupBy("doc_id", "mix_shard").count().collect()} == want
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    stream = mixing.ordered(mixed).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert [(r.mix_shard, r.mix_key) for r in stream] == sorted((r.mix_shard, r.mix_key) for r in stream)


def test_many_sources_go_by_ranges(spark, documents, monkeypatch):
    """Sums over sources and draws by ranges give what one task gives."""
    from siftline.llm import _shared

    docs = documents.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 29)))
    one = sorted(map(str, mixing.taken_words(spark, docs).collect()))
    monkeypatch.setattr(_shared, "ONE_TASK", 3)
    monkeypatch.setattr(mixing, "ONE_TASK", 3)
    assert sorted(map(str, mixing.taken_words(spark, docs).collect())) == one
    numbers = spark.range(500).selectExpr("id", "id % 3 AS v")
    got = {r.id: r["before"] for r in _shared.running(spark, numbers, [F.col("id").desc()], "v", "before").collect()}
    assert got == {k: sum(x % 3 for x in range(k + 1, 500)) for k in range(500)}


# --- sharding


def test_shards_are_runs_of_the_curve(spark, documents, rows):
    got = hilbert.shard_documents(spark, documents, whole_rows=False).collect()
    assert len(got) == len(rows)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1 and len(counts) == 16
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)


def test_hot_cells_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE", 20)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    whole = hilbert.shard_documents(spark, docs)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    n = [r["count"] for r in whole.groupBy("shard").count().collect()]
    assert sorted(n) == [62] * 8 + [63] * 8 and whole.select("shard", "slot").distinct().count() == 1000


def test_order_does_not_depend_on_slices_or_ranges(spark, documents, monkeypatch):
    """Slices of any size and sums by ranges give the same slots; rows with one doc_id, or none, and different texts are dealt too."""
    from siftline.llm import _shared

    extra = spark.createDataFrame([(None if k % 2 else 3, f"text {k}", None, "hot", 0) for k in range(60)], documents.schema)
    docs = documents.unionByName(extra)
    one = sorted(map(str, hilbert.shard_documents(spark, docs, whole_rows=False).collect()))
    assert len(one) == documents.count() + 60
    monkeypatch.setattr(hilbert, "SLICE", 3)
    monkeypatch.setattr(_shared, "ONE_TASK", 5)
    assert sorted(map(str, hilbert.shard_documents(spark, docs, whole_rows=False).collect())) == one


def test_files_of_shards_prune(spark, tmp_path):
    """A shard's file covers few languages, sources and lengths, so that most files are excluded by a filter on two of them."""
    import pyarrow.parquet as pq

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(pow(2, id % 12) as int)) AS text", "concat('l', id % 4) AS lang", "concat('s', (id div 4) % 8) AS source", "id AS n_chars")
    path = str(tmp_path / "shards")
    hilbert.write_shards(hilbert.shard_documents(spark, docs), path)
    files = [f for f in sorted((tmp_path / "shards").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
    assert len(files) == 16
    kept = 0
    for file in files:
        table = pq.read_table(file)
        assert table.column("shard").unique().to_pylist().__len__() == 1 and table.column("slot").to_pylist() == list(range(table.num_rows))
        lang, source = table.column("lang").to_pylist(), table.column("source").to_pylist()
        kept += min(lang) <= "l1" <= max(lang) and min(source) <= "s2" <= max(source)
    assert kept <= 5


def test_curve_is_continuous():
    at = {i: cell for cell, i in enumerate(hilbert.curve())}
    point = lambda c: (c >> 8, (c >> 4) & 15, c & 15)
    assert all(sum(abs(a - b) for a, b in zip(point(at[i]), point(at[i + 1]))) == 1 for i in range(4095))


# --- pages

PAGES = [
    (1, "http://a.example/1", "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/x'>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three &lt;x&gt;.<p>Short.<script>var a='<p>no</p>'</script></article><aside>ad text that is long enough to be a sentence</aside><footer>&copy; us</footer></body></html>"),
    (2, None, "<div id='main'><p>" + "word " * 60 + "</p><div class='comments'><p>" + "nice one " * 20 + "</p></div><p>ok</p></div>"),
    (3, "http://a.example/3", None),
    (4, "http://a.example/4", ""),
    (5, "x\r\ny", "no markup here but many words to read " * 5),
    (6, "http://a.example/6", "<p>" + "z " * 80 + "<b unclosed <i>"),
    (7, "u", "same payload " * 20),
    (9, "u", "same payload " * 20),
    (8, "u", "same payload " * 20),
    (8, "u", "same payload " * 20),
    (None, "u", "same payload " * 20),
    (10, "u", "tiny"),
    (11, "u", "tiny"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit("clash"))


def test_main_text(spark, pages):
    got = {r.page_id: r for r in html_blocks.extract_pages(pages).collect()}
    assert got[1].text == "A & B\n\nOne two three <x>.\n\nShort."
    assert got[2].text == ("word " * 60).strip() + "\n\nok"
    assert got[3].text == got[4].text == ""
    assert got[5].text == ("no markup here but many words to read " * 5).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_blocks.extract_pages(pages.limit(0)).count() == 0


def test_tree_fits_its_table():
    import numpy as np

    table = np.array(html_blocks.LABELLED, float)
    assert [html_blocks.is_content(html_blocks.tree(), row) for row in table[:, :-1]] == (table[:, -1] == 1).tolist()


def test_extraction_is_linear():
    import time

    for bad in ("<div>" * 50_000, "<a href='x" * 20_000, "<script>" * 20_000, "<!--" * 20_000, "<p class=\"" + "x" * 200_000):
        began = time.time()
        html_blocks.main_text(bad)
        assert time.time() - began < 10


def test_archives_round_trip(spark, pages):
    got = warc.archive_pages(spark, pages).collect()
    assert len(got) == len(PAGES)
    payload = {p: (h or "").encode() for p, _, h in PAGES}
    for r in got:
        assert r.payload_bytes == len(payload[r.page_id]) and r.payload_digest == hashlib.sha256(payload[r.page_id]).hexdigest()
        revisit = r.page_id in (8, 9, None)
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 10])
def test_hot_and_small_payloads_are_dealt(spark, monkeypatch, few):
    """A third of all pages are one payload, a third are empty, and one is far longer than a batch; by broadcast and by salted keys."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    rows = [(k, f"u{k}", "hot payload " * 20 if k % 3 == 0 else "" if k % 3 == 1 else f"page {k} " * 30) for k in range(1, 300)]
    rows += [(400, None, "long " * 400_000), (401, None, "long " * 400_000), (402, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if not few:
        parts = warc.with_targets(spark, pages.drop("url").withColumn("url", F.lit("u"))).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 0.6 * len(rows)
    for r in warc.archive_pages(spark, pages).collect():
        want = 3 if 3 < r.page_id < 300 and r.page_id % 3 == 0 else 400 if r.page_id == 401 else None
        assert (r.refers_to, r.record_type) == (want, "revisit" if want else "response")


def test_archives_hold_a_dictionary(spark):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", f"<html><body><nav>menu of the site</nav><p>{' '.join(rng.choice(['alpha', 'beta', 'gamma']) for _ in range(80))}</p></body></html>") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(spark, pages, folder).orderBy("place").collect()
    store, path = pafs.FileSystem.from_uri(manifest[0].path)
    data = store.open_input_stream(path).read()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and manifest[0].place == 8 + int.from_bytes(data[4:8], "little")
    records = [warc.parse(r) for r in warc.read_frames(store.open_input_stream(path))]
    assert len(records) == 300 and {r["warc-type"] for r in records} == {"response"}
    assert sum(m.length for m in manifest) + manifest[0].place == len(data)


@pytest.mark.parametrize("table", ["empty", "clashing"])
def test_odd_tables(spark, table, request):
    docs = request.getfixturevalue(table)
    n = 0 if table == "empty" else len(make_rows())
    assert mixing.taken_words(spark, docs).count() == n
    assert hilbert.shard_documents(spark, docs, whole_rows=False).count() == n
    assert mixing.mix(spark, docs).count() >= 0
    assert hilbert.shard_documents(spark, docs).count() == n
