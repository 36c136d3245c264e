from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.operators import crawl, dedup, evaluate, rank, search, suggest


def test_query_syntax():
    p = search.parse_query('a "b c" -d site:www.x.com/y « e f » "z - site:')
    assert (p.terms, p.phrases, p.site, p.excluded) == (("a", '"z', "-", "site:"), ("b c", "e f"), "x.com", ("d",))
    assert p.engine_query() == 'a "z - site: "b c" "e f"'
    with pytest.raises(ValueError, match="per_page"):
        search.Params("x", per_page=51)
    f = search.Filters(published_from=9, published_to=1).normalized()
    assert (f.published_from, f.published_to, f.known_dates) == (1, 9, True)


def test_retrieval_order(spark):
    docs = spark.createDataFrame([(1, "red car", "x", 5, 0.5), (2, "x", "a red fast car", 9, 0.5), (3, "red", "y", 1, 0.1), (4, "car red", "z", 7, 0.5)], "doc_id long, title string, body string, published_at long, quality_score double")
    asked = search.query_terms(spark.createDataFrame([(1, "Red car")], "query_id long, query string"))
    got = search.retrieve(asked, search.postings(docs), docs).orderBy("pos").collect()
    assert [r.doc_id for r in got] == [4, 1, 2, 3]
    phrases = spark.createDataFrame([(1, "red car")], "query_id long, phrase string")
    assert [r.doc_id for r in search.phrase_matches(phrases, search.postings(docs)).collect()] == [1]
    near = search.with_typos(search.query_terms(spark.createDataFrame([(1, "carr")], "query_id long, query string")), search.vocabulary(search.postings(docs)))
    assert [(r.word, r.typos) for r in near.collect()] == [("car", 1)]


def test_rerank(spark):
    now = 1_000_000_000
    rows = [(1, "q", k, k, "s1" if k < 5 else "s2", "d1", now - k * 86400, "day", None, None, 0xFFFF << (7 * k)) for k in range(1, 7)]
    hits = spark.createDataFrame(rows, "query_id long, query string, doc_id long, pos int, source_id string, domain string, published_at long, precision string, quality_score double, spam_score double, simhash long")
    trust = spark.createDataFrame([("s1", 0.3)], "source_id string, trust double")
    got = rank.rerank(hits, trust, now).orderBy("rank").collect()
    assert [r.doc_id for r in got][:3] == [1, 2, 3] and len(got) == 6
    copies = hits.withColumn("simhash", F.lit(7).cast("long"))
    assert [r.doc_id for r in rank.rerank(copies, trust, now).collect()] == [1]
    assert rank.explained(rank.signals(hits, trust, now)).select("explain.score").count() == 6
    spread = rank.cap_domains(rank.signals(hits, trust, now).withColumn("domain", F.when(F.col("doc_id") == 6, "d2").otherwise("d1")))
    assert [r.doc_id for r in spread.orderBy("rank").collect()] == [1, 2, 3, 6, 4, 5]


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "")], "doc_id long, content_hash string")
    seen = spark.createDataFrame([("b",)], "content_hash string")
    assert sorted(r.doc_id for r in dedup.new_only(rows, seen).collect()) == [1, 4, 5, 6]
    hashed = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, 0), (5, 15), (6, None)], "doc_id long, simhash long")
    assert sorted((r.doc_id, r.near_id, r.distance) for r in dedup.near_links(hashed).collect()) == [(1, 2, 3), (2, 5, 1)]
    c = spark.createDataFrame([("c", 1, "unknown", 1, 1.0, 9, 2), ("c", 2, "day", 5, 0.1, 5, 3), ("c", 3, "day", 5, 0.1, 9, 4)], "cluster_id string, doc_id long, precision string, published_at long, trust double, body_len long, engagement long")
    assert tuple(dedup.winners(c).first()) == ("c", 3, 9, 3)


def test_members_and_links_as_all_pairs(spark):
    rows = [(1, 0), (2, 7), (3, -1), (4, 0), (5, 15), (6, None), (7, 7), (8, 0), (9, None), (10, 1 << 40), (4, 0)]
    hashed = spark.createDataFrame(rows, "doc_id long, simhash long")
    links, members = ({(r.doc_id, r.near_id, r.distance) for r in f(hashed).collect()} for f in (dedup.near_links, dedup.hash_members))
    assert members == {(1, 4, 0), (1, 8, 0), (2, 7, 0)} and dedup.hash_members(hashed).count() == 3
    stands_for = {d: d for d, h in rows if h is not None} | {b: a for a, b, _ in members}
    linked = {(a, b): d for a, b, d in links}
    got = {(x, y, d) for x in stands_for for y in stands_for if x < y and (d := 0 if stands_for[x] == stands_for[y] else linked.get(tuple(sorted((stands_for[x], stands_for[y]))))) is not None}
    apart = lambda x, y: bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1")
    assert got == {(x, y, apart(h, k)) for x, h in rows for y, k in rows if None not in (h, k) and x < y and apart(h, k) <= 3}


def test_near_query_links_copies(spark, tmp_path):
    from siftline import catalog

    words = " ".join(f"w{k}" for k in range(40))
    spark.createDataFrame([(1, words), (2, words.upper()), (3, "too few"), (4, words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.queries()["dedup_near"](spark, str(tmp_path)).collect()} == {(1, 2, 0), (1, 4, 0)}


def test_near_links_make_no_broadcast(spark):
    hashed = spark.range(2000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("simhash"))
    for found in (dedup.near_links(hashed), dedup.hash_members(hashed)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_measures(spark):
    golden = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 0), (3, "d", 2)], "query_id long, doc_id string, grade int")
    results = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "c", 1)], "query_id long, doc_id string, pos int")
    got = {r.query_id: r for r in evaluate.measures(results, golden).collect()}
    assert got[1].mrr == 0.5 and got[1].recall == 0.5 and got[1].unjudged == 1 and 0 < got[1].ndcg < 1
    assert got[2].ndcg is None and got[2].recall is None and got[3].ndcg == 0 and got[3].results == 0
    assert evaluate.regressed(0.90, 0.95) and not evaluate.regressed(0.945, 0.95) and evaluate.drifted(100, 130)


def test_revisits_fold_in_order(spark):
    visits = [("u", 90, t, c) for t, c in enumerate([True] * 10)] + [("v", 90, t, False) for t in range(3)] + [("w", 10, 0, True)]
    got = {r.url: r for r in crawl.revisit(spark.createDataFrame(visits, "url string, trust int, ts long, changed boolean")).collect()}
    assert got["u"].volatile and got["u"].interval_s == 3 * 86400
    assert got["v"].interval_s == 86400 + 3 * 3600 and not got["v"].volatile and got["w"].interval_s == 43200


def test_politeness_and_limits(spark):
    replies = spark.createDataFrame([("h", 1, 429, None), ("h", 2, 503, None), ("h", 3, 200, None), ("k", 1, 429, 900)], "host string, ts long, status int, retry_after int")
    got = {r.host: r.delay_s for r in crawl.politeness(replies).collect()}
    assert got == {"h": pytest.approx(108.0), "k": 600.0}
    requests = spark.createDataFrame([("c", t, i) for i, t in enumerate([0, 10, 50, 59, 60, 61, 200])], "client string, ts long, request_id long")
    ok = {r.request_id: r.allowed for r in crawl.rate_limited(requests, limit=2).collect()}
    assert ok == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_frontier(spark):
    schema = "url string, host string, priority long, due_at long"
    waiting = spark.createDataFrame([("a1", "a", 1, 0)], schema)
    found = spark.createDataFrame([("a2", "a", 5, 0), ("a3", "a", 2, 0), ("a3", "a", 2, 0), ("b1", "b", 1, 0), ("s", "b", 0, 0)], schema)
    seen = spark.createDataFrame([("s",)], "url string")
    assert sorted(r.url for r in crawl.add_to_frontier(waiting, found, seen, cap=2).collect()) == ["a3", "b1"]
    hosts = spark.createDataFrame([("a", 5, 2), ("b", 99, 2)], "host string, due_at long, delay_s int")
    picked = crawl.claim(waiting.unionByName(found), hosts, now=10, most=5).collect()
    assert [(r.host, r.url, r.lease_until, r.next_due) for r in picked] == [("a", "a1", 130, 12)]
    claims = picked and spark.createDataFrame([("u", 5), ("v", 50)], "url string, lease_until long")
    assert [r.url for r in crawl.expired(claims, 10).collect()] == ["u"]
    assert crawl.stages_left(100, 70) == ["rerank", "summary"]


def test_suggestions(spark):
    curated = spark.createDataFrame([("Oran", 1.0), ("oran ville", 0.2)], "term string, weight double")
    titles = spark.createDataFrame([("ORAN | site",), ("orange",)], "title string")
    index = suggest.build(curated, titles)
    got = suggest.by_prefix(index, spark.createDataFrame([(1, "Ora"), (2, "x")], "query_id long, prefix string")).orderBy("rank").collect()
    assert [(r.key, r.weight) for r in got] == [("oran", 1.0), ("orange", 1.0), ("oran ville", pytest.approx(0.18))]
    legs = spark.createDataFrame([(1, "oranges", "oranges", 0.9), (1, "oran", "oran", 0.5), (1, "zed", "zed", 0.7)], "query_id long, key string, term string, weight double")
    assert [r.key for r in suggest.merge(legs).orderBy("rank").collect()] == ["oranges", "zed"]


def test_near_links_are_all_pairs(spark):
    """Hashes that differ in up to three bits anywhere, beside others: the keys lose no pair."""
    import random

    rng = random.Random(7)
    hashes = []
    for _ in range(60):
        base = rng.getrandbits(64)
        hashes += [base, *(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(3))]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    want = {(a, b, (x ^ y).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 3}
    assert {tuple(r) for r in dedup.near_links(rows).collect()} == want and len(want) > 60


def test_collapse_keeps_all_bits_beside_nulls(spark):
    big = (1 << 62) + 1
    rows = spark.createDataFrame([(1, 1, big), (1, 2, big ^ 0b1111), (1, 3, None), (1, 4, big ^ 0b111), (1, 5, None)], "query_id long, rank int, simhash long")
    assert sorted(r["rank"] for r in rank.collapse(rows).collect()) == [1, 2, 3, 5]


def test_index_reads_only_the_terms_asked(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}", f"word{k} common") for k in range(50)], "doc_id long, title string, body string")
    path = str(tmp_path / "index")
    search.build_index(spark, docs, path)
    found = search.read_index(spark, path, spark.createDataFrame([(1, "word7"), (1, "t9")], "query_id long, term string"))
    assert {(r.term, r.doc_id) for r in found.collect()} == {("word7", 7), ("t9", 9)}
    assert "PushedFilters: [In(term, [t9,word7])]" in found._jdf.queryExecution().executedPlan().toString().replace("[word7,t9]", "[t9,word7]")


def test_stop_words_and_recency(spark):
    terms = spark.createDataFrame([(1, "the"), (1, "cat"), (2, "the"), (2, "of")], "query_id long, term string")
    assert {tuple(r) for r in search.without_stop_words(terms, ["the", "of"]).select("query_id", "term").collect()} == {(1, "cat"), (2, "the"), (2, "of")}
    hits = spark.createDataFrame([(1, 10, 1, 5), (1, 11, 2, 9), (1, 12, 3, 9)], "query_id long, doc_id long, pos long, published_at long")
    assert [r.doc_id for r in search.by_recency(hits).orderBy("rank").collect()] == [11, 12, 10]
