from __future__ import annotations

import json

import pytest

from siftline.sources import readers, sinks
from siftline.sources.html import parse_page
from siftline.sources.robots import allowed_by, parse_robots

NOW = 1_750_000_000


def test_lists(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("# note\nwach\tstrong\tx\nbzaf bzaf\tweak\ta b c\nthree word term\tstrong\nx\t0.7\n")
    assert sorted(map(tuple, readers.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect())) == [("bzaf bzaf", 0.5), ("wach", 1.0), ("x", 0.7)]
    (tmp_path / "seeds.tsv").write_text("a\thttp://a\tA\tn\nb\thttp://b\n")
    assert [r.tier for r in readers.read_seeds(spark, str(tmp_path / "seeds.tsv")).orderBy("id").collect()] == ["A", "B"]
    (tmp_path / "c.tsv").write_text("1\ta|b\t0.5\n2\tonly\n3\tx | y\n")
    assert [(r.id, list(r.variants), r.weight) for r in readers.read_concepts(spark, str(tmp_path / "c.tsv")).orderBy("id").collect()] == [("1", ["a", "b"], 0.5), ("3", ["x", "y"], 0.85)]
    (tmp_path / "p.txt").write_text("# c\n\nFree Money\n")
    assert [r.phrase for r in readers.read_phrases(spark, str(tmp_path / "p.txt")).collect()] == ["free money"]


def test_corpus_and_golden(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"1","title":"t","published_at":5}\n')
    assert readers.read_corpus(spark, str(tmp_path / "d.jsonl")).first().title == "t"
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        readers.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "g.jsonl").write_text('{"_meta":{"corpus_size":7}}\n{"id":"q","query":"x","judgements":{"d1":3}}\n')
    size, golden = readers.read_golden(spark, str(tmp_path / "g.jsonl"))
    assert size == 7 and golden.first().judgements == {"d1": 3}


def test_rules_and_sitemaps():
    assert readers.read_rules('[[domain]]\nhost = "a"\n') == [{"host": "a"}] and readers.read_rules("= bad") == []
    with pytest.raises(ValueError, match="two rules"):
        readers.read_rules('[[domain]]\nhost = "a"\n[[domain]]\nhost = "a"\n')
    xml = "<urlset><url><loc>http://a/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/1</loc></url><url><loc><![CDATA[http://a/2]]></loc></url></urlset>"
    assert readers.sitemap_entries(xml) == [("http://a/1", "2024-01-01"), ("http://a/2", None)]
    assert readers.sitemap_entries(xml[:60]) == [] or readers.sitemap_entries(xml[:60])[0][0] == "http://a/1"
    assert readers.sitemap_entries("<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/2</lo") == [("http://a/1", None)]
    assert readers.sitemap_entries('<feed><entry><link href="http://a/x"/></entry></feed>') == [("http://a/x", None)]


def test_bytes():
    assert readers.decode_bytes("سلام".encode("windows-1256"), "windows-1256") == "سلام"
    assert readers.decode_bytes(b'<meta charset="windows-1252">caf\xe9', None).endswith("café")
    assert readers.decode_bytes("é".encode(), "no-such-label") == "é"


def test_pages():
    body = "word " * 60
    page = f'<html><head><title>T</title><meta property="og:title" content="O"><script type="application/ld+json">{{"@graph":[{{"@type":"NewsArticle","headline":"H","datePublished":"2024-01-02","author":{{"name":"N"}}}}]}}</script><link rel="canonical" href="/c"></head><body><nav><a href="/n">n</a></nav><article><p>{body}</p><a href="/x#y">l</a><a href="mailto:a@b">m</a><img src="/i.png" width="300"></article></body></html>'
    got = parse_page(page, "http://a.com/p", NOW)
    assert (got["title"], got["method"], got["published_at"], got["precision"], got["author"], got["canonical_url"], got["error"]) == ("H", "block", 1704153600, "day", "N", "http://a.com/c", None)
    assert got["outlinks"] == ["http://a.com/n", "http://a.com/x#y"] and got["media"] == ["http://a.com/i.png"]
    assert parse_page('<meta name="robots" content="noindex"><a href="/x">x</a>', "http://a/", NOW)["error"] == "no_index"
    assert parse_page("<p>few</p>", "http://a/", NOW)["error"] == "too_little_content"
    assert parse_page("<div>" * 600, "http://a/", NOW)["error"] == "too_complex"
    assert parse_page(None, "http://a/", NOW)["error"] == "too_little_content"
    assert parse_page(f"<h1>h</h1><div hidden>{body}</div><p>shown {body}</p>", "http://a/", NOW)["body"].startswith("shown")


@pytest.mark.parametrize(
    ("robots", "path", "ok"),
    [("User-agent: *\nDisallow: /a", "/a/b", False), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b", True), ("User-agent: *\nDisallow: /\n\nUser-agent: siftline\nDisallow: /x", "/y", True), ("User-agent: *\nDisallow: /*.php$", "/a.php", False), ("User-agent: *\nDisallow: /*.php$", "/a.php5", True), ("User-agent: a\nUser-agent: *\nDisallow: /q", "/q", False), ("﻿User-agent: * # c\nDisallow:", "/z", True), ("", "/", True)],
)
def test_robots(robots, path, ok):
    assert allowed_by(200, robots, path) is ok


def test_robots_replies():
    assert allowed_by(404, None, "/") and not allowed_by(500, None, "/") and not allowed_by(None, None, "/")
    assert parse_robots("User-agent: *\nCrawl-delay: 9999\nSitemap: http://a/s")["delay"] == 3600


def test_jobs_and_upserts(spark, tmp_path):
    payloads = ["[1]", "nope", None, json.dumps({"id": "", "title": "x"}), json.dumps({"id": "1", "title": " ", "body": ""}), json.dumps({"id": "1", "title": "t"}), json.dumps({"id": "2", "body": "x" * (1 << 20)})]
    jobs = spark.createDataFrame([(p,) for p in payloads], "payload string")
    good, bad = sinks.split_jobs(jobs)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["empty", "missing_id", "not_an_object", "not_an_object", "not_an_object", "too_large"]
    sinks.bury(bad, str(tmp_path / "dead"))
    assert sinks.letters(spark, str(tmp_path / "dead")).count() == 6 and sinks.peek(sinks.letters(spark, str(tmp_path / "dead")), 2).count() == 2
    table = sinks.VersionedTable(spark, str(tmp_path / "tables"), "docs")
    assert table.read() is None
    table.put(spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "id string, payload string, indexed_at long"))
    table.put(spark.createDataFrame([("b", "y", 5)], "id string, payload string, indexed_at long"))
    assert table.versions() == [1, 2] and {(r.id, r.payload) for r in table.read().collect()} == {("a", "new"), ("b", "y")}
    assert sinks.delete(table.read(), spark.createDataFrame([("a",)], "id string")).count() == 1


def test_batches_close_by_rows_and_bytes(spark):
    jobs = spark.createDataFrame([(f"{k:05d}", "x" * (3 << 20 if k % 400 == 0 else 10)) for k in range(1200)], "id string, payload string")
    got = sinks.batches(jobs, lanes=1).groupBy("batch").agg({"*": "count", "bytes": "sum"}).collect()
    assert all(r["count(1)"] <= 500 and r["sum(bytes)"] <= 4 << 20 for r in got) and sum(r["count(1)"] for r in got) == 1200
    assert sinks.settings_diff({"a": 1, "b": [1]}, {"a": 1, "b": [2]}) == {"b": ([1], [2])}


def test_queue_validates_whole_texts(spark, tmp_path):
    from siftline import catalog

    rows = [(3, "x" * (2 << 20)), (4, " " * 60 + "late words"), (5, " " * 60), (6, None), (10, "words"), (1, "x" * (2 << 20)), (8, "words"), (7, "words"), (2, "words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.reason: r.n for r in catalog.queries()["queue_validation"](spark, str(tmp_path)).collect()}
    assert got == {"too_large": 2, "ok": 2, "empty": 3, "missing_id": 1, "not_an_object": 1}


def test_poison_is_isolated_by_halves():
    taken = []

    def sink(rows):
        if any(r % 7 == 3 for r in rows):
            raise ValueError
        taken.extend(rows)

    assert sinks.isolate(list(range(40)), sink) == [3, 10, 17, 24, 31, 38]
    assert sorted(taken) == [r for r in range(40) if r % 7 != 3] and sinks.isolate([], sink) == []


def test_versions_expire_and_late_rows_undo_nothing(spark, tmp_path):
    kept = sinks.VersionedTable(spark, str(tmp_path), "t")
    for k, at in enumerate([5, 9, 7, 8, 9]):
        kept.put(spark.createDataFrame([("a", at, k), (f"b{k}", 1, k)], "id string, indexed_at long, k int"))
    assert kept.versions() == [3, 4, 5]
    assert {r.id: (r.indexed_at, r.k) for r in kept.read().collect()} == {"a": (9, 4), **{f"b{k}": (1, k) for k in range(5)}}


def test_a_repeated_batch_buries_once(spark, tmp_path):
    bad = spark.createDataFrame([("p", "empty"), ("q", "empty")], "payload string, reason string")
    for batch in (1, 1, 2, None):
        sinks.bury(bad, str(tmp_path / "dead"), batch)
    assert sinks.letters(spark, str(tmp_path / "dead")).count() == 6


def test_queues_keep_their_newest(spark):
    queue = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "seq long, payload string")
    more = sinks.produce(queue, spark.createDataFrame([("n",)] * 5, "payload string"), 8)
    rows = sorted(tuple(r) for r in more.collect())
    assert [p for _, p in rows] == ["p7", "p8", "p9", *["n"] * 5] and len({s for s, _ in rows}) == 8
    empty = queue.limit(0)
    assert sinks.produce(empty, queue.select("payload"), 100).count() == 10
    assert sinks.lag(queue, queue.filter("seq < 4")).first()[0] == 6
    assert sinks.pending(queue, queue.filter("seq < 4"), queue.filter("seq = 2")).count() == 3
