from __future__ import annotations

from pyspark.sql import functions as F

from siftline.engine import Engine
from siftline.operators import registry, search
from siftline.plans import base

NOW = base.NOW


def make(spark):
    rows = [(1, "red car", "a red car for all", "http://a.com/1", "a.com", "s1", "en", NOW - 86400, "day", 0.5, 0.0), (2, "blue car", "no colour but blue", "http://b.com/2", "b.com", "s2", "en", NOW - 9 * 86400, "unknown", 0.9, 0.9), (3, "voiture", "une voiture rouge", "http://a.com/3", "a.com", "s1", "fr", NOW, "day", 0.1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, url string, domain string, source_id string, language string, published_at long, precision string, quality_score double, spam_score double")
    return Engine(spark, docs, spark.createDataFrame([("s1", 1.0)], "source_id string, trust double"), NOW)


def test_search_syntax_end_to_end(spark):
    e = make(spark)
    ids = lambda *a, **k: [r.doc_id for r in e.search(*a, **k).orderBy("rank").collect()]
    assert ids("car") == [1, 2] and ids("car -blue") == [1] and ids("car site:b.com") == [2] and ids('"red car"') == [1]
    assert ids("car", filters=search.Filters(languages=("en",))) == [1] and ids("car", page=2) == []
    golden = spark.createDataFrame([(7, 1, 3)], "query_id long, doc_id long, grade int")
    assert e.evaluate(golden, spark.createDataFrame([(7, "car")], "query_id long, query string")).first().ndcg == 1
    assert e.facets(["domain"]).count() == 2


def test_search_forgives_typos_in_titles_and_bodies(spark):
    ids = lambda q: [r.doc_id for r in make(spark).search(q).orderBy("rank").collect()]
    assert ids("voitures") == [3] and ids("colours") == [2] and ids("rouje") == [3] and ids("cat") == []


def test_ingest(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<article><p>" + "long words here " * 30 + "</p><a href='/x'>x</a></article>"), (2, "http://b/", "<p>few</p>")], "page_id long, url string, html string")
    good, links, refused = make(spark).ingest(pages)
    assert good.first().content_hash.startswith("s2:") and [r.link for r in links.collect()] == ["http://a/x"] and refused.first().error == "too_little_content"


def test_registry(spark):
    sources = spark.createDataFrame([("a", "http://a.com/", "A")], "source_id string, url string, tier string")
    new = spark.createDataFrame([("b", "http://b.com/", None), ("a", "http://a.com/", "B"), ("c", "http://127.0.0.1/", "A")], "source_id string, url string, tier string")
    kept, refused = registry.add_sources(sources, new)
    assert {(r.source_id, r.trust, r.crawl_trust) for r in registry.with_trust(kept).collect()} == {("a", 1.0, 100), ("b", 0.6, 60)}
    assert {(r.source_id, r.reason) for r in refused.collect()} == {("a", "exists"), ("c", "private_address")}
    frontier = spark.createDataFrame([("http://a.com/x", "a.com", -5, 0)], "url string, host string, priority long, due_at long")
    urls = spark.createDataFrame([("http://a.com/y?utm_source=q",)], "url string")
    assert registry.enqueue(frontier, urls, promote=True).orderBy("priority").first().url == "http://a.com/y"
    diff = registry.normalisation_diff(spark.createDataFrame([("Aـa",)], "t string"), "t").collect()
    assert {(r.character, r.before, r.after) for r in diff} == {("A", 1, 0), ("a", 1, 2), ("ـ", 1, 0)}
    noisy = registry.noisy(spark.createDataFrame([("words of length " * 20,)], "t string"), "t")
    from siftline.functions.text import normalize

    assert noisy.select(normalize(F.col("t")).alias("t")).first().t == ("words of length " * 20).strip()
    assert registry.depth(frontier, frontier, frontier).count() == 3 and registry.golden_queries(make(spark).docs).count() == 3
