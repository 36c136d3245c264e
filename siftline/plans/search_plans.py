"""Plans over the index: retrieval, ranking, facets, suggestions, evaluation, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import fold_plain, tokens
from siftline.operators import dedup, evaluate, rank, search, suggest
from siftline.operators.sizes import small
from siftline.plans.base import ASKED, CRAWLED, NOW, TERMS, Query, asked, crawled, table
from siftline.plans.text_plans import SQL as _TEXT_SQL
from siftline.sources.scratch import scratch

SIMHASH = _TEXT_SQL["text_simhash"]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_HITS = f"""{CRAWLED}, {ASKED},
post AS (SELECT term, doc_id, field, i - 1 AS pos FROM (SELECT doc_id, 0 AS field, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TERMS.format('title')} AS w FROM crawled)
         UNION ALL SELECT doc_id, 3, unnest(w), generate_subscripts(w, 1) FROM (SELECT doc_id, {TERMS.format('body')} AS w FROM crawled))),
q AS (SELECT DISTINCT query_id, unnest({TERMS.format('query')}) AS term FROM asked),
firsts AS (SELECT query_id, doc_id, q.term, min(field) AS field, min(pos) AS pos FROM q JOIN post USING (term) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, count(*) AS words, max(pos) - min(pos) AS spread, min(field) AS attribute FROM firsts GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, spread, attribute, published_at DESC, quality_score DESC, doc_id) AS pos
         FROM scored JOIN crawled USING (doc_id) QUALIFY pos <= 200)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crawled(spark, sf_dir)
    return search.retrieve(search.query_terms(asked(spark, sf_dir)), search.postings(docs), docs)


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust by source, as a dimension."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().withColumn("trust", F.when(F.substring("source_id", 4, 2).cast("int") % 3 == 0, 1.0).when(F.substring("source_id", 4, 2).cast("int") % 3 == 1, 0.6).otherwise(0.3))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).select("query_id", "doc_id", "pos").join(crawled(spark, sf_dir).drop("title", "body"), "doc_id").join(small(asked(spark, sf_dir)), "query_id")
    return rank.cap_domains(rank.signals(hits, _trust(spark, sf_dir), NOW))


_RANKED = f"""{_HITS},
aged AS (SELECT h.*, a.query, avg(CASE WHEN {NOW} - published_at < 604800 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY h.query_id) AS recent FROM hits h JOIN asked a USING (query_id)),
sig AS (SELECT *, CASE WHEN regexp_matches(lower(query), '{"|".join(["aujourd", "maintenant", "urgent", "hier", "direct", "dernier", "actualite", "today", "now", "breaking", "latest", "live"])}') THEN 3.0
                       WHEN regexp_matches(lower(query), '{"|".join(["kifach", "comment", "procedure", "conditions", "documents", "guide", "demarche", "how", "what is", "steps", "requirements"])}') THEN 90.0
                       WHEN recent >= 0.4 THEN 3.0 ELSE 30.0 END AS tau FROM aged),
sc AS (SELECT *, 0.55 * exp(-(pos - 1) / 10.0) + 0.15 * exp(-(greatest(0, {NOW} - published_at) / 86400.0) / tau) * CASE WHEN precision = 'unknown' THEN 0.5 ELSE 1.0 END
                 + 0.10 * CASE CAST(substr(source_id, 4, 2) AS INTEGER) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END + 0.07 * quality_score - 0.15 * spam_score AS score FROM sig),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r0 FROM sc),
cap AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY r0) AS turn FROM rk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN turn > 3 THEN 1 ELSE 0 END, r0) AS rank FROM cap)"""


@plan
def search_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every query: retrieval, second ranking, domain cap."""
    return search.page_of(_ranked(spark, sf_dir), 1, 20).select("query_id", "doc_id", "domain", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL["search_flagship"] = f"WITH {_RANKED} SELECT query_id, doc_id, domain, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank BETWEEN 1 AND 20"


@plan
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole second ranking: signals, collapse of near copies by SimHash, domain cap. Hashes are made of the hits' texts only."""
    from siftline.functions.text import normalize, simhash

    hits = _hits(spark, sf_dir).select("query_id", "doc_id", "pos")
    docs = crawled(spark, sf_dir)
    hashed = docs.join(small(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", simhash(normalize(F.col("body"))).alias("simhash"))
    whole = hits.join(docs.drop("title", "body"), "doc_id").join(hashed, "doc_id").join(small(asked(spark, sf_dir)), "query_id")
    return search.page_of(rank.rerank(whole, _trust(spark, sf_dir), NOW), 1, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL["search_reranked"] = f"""WITH RECURSIVE sh AS ({SIMHASH}), {_RANKED.removeprefix('WITH ')},
near AS (SELECT rk.*, CAST('0x' || simhash AS UBIGINT) AS h FROM rk JOIN sh USING (doc_id)),
fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS r, CAST([] AS UBIGINT[]) AS kept, CAST(NULL AS BIGINT) AS doc_id, false AS stays FROM near
  UNION ALL SELECT n.query_id, n.r0, CASE WHEN n.h IS NOT NULL AND len(list_filter(f.kept, lambda x: bit_count(xor(x, n.h)) <= 3)) = 0 THEN list_append(f.kept, n.h) ELSE f.kept END, n.doc_id,
    n.h IS NULL OR len(list_filter(f.kept, lambda x: bit_count(xor(x, n.h)) <= 3)) = 0 FROM fold f JOIN near n ON n.query_id = f.query_id AND n.r0 = f.r + 1),
left_in AS (SELECT n.query_id, n.doc_id, n.score, n.r0, row_number() OVER (PARTITION BY n.query_id, n.domain ORDER BY n.r0) AS turn FROM near n JOIN fold f ON f.query_id = n.query_id AND f.doc_id = n.doc_id WHERE f.stays)
SELECT query_id, doc_id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN turn > 3 THEN 1 ELSE 0 END, r0) AS rank FROM left_in QUALIFY rank <= 20"""


@plan
def search_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every query, the newest first."""
    return search.by_recency(_hits(spark, sf_dir)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


SQL["search_recency"] = f"WITH {_HITS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, pos) AS rank FROM hits"


@plan
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval over an index that was written before: only the ranges of the batch's terms are read."""
    docs, terms = crawled(spark, sf_dir), search.query_terms(asked(spark, sf_dir))
    path = scratch(spark, "index")
    search.build_index(spark, docs, path)
    return search.retrieve(terms, search.read_index(spark, path, terms), docs).select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))


SQL["search_indexed"] = f"WITH {_HITS} SELECT query_id, doc_id, CAST(pos AS BIGINT) AS pos FROM hits"


@plan
def search_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "doc_id", F.col("words").cast("long").alias("words"), F.col("spread").cast("long").alias("spread"), F.col("attribute").cast("long").alias("attribute"), F.col("pos").cast("long").alias("pos"))


SQL["search_retrieve"] = f"WITH {_HITS} SELECT query_id, doc_id, CAST(words AS BIGINT) AS words, CAST(spread AS BIGINT) AS spread, CAST(attribute AS BIGINT) AS attribute, CAST(pos AS BIGINT) AS pos FROM hits"


@plan
def search_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(search.postings(crawled(spark, sf_dir), ("title",)))


SQL["search_vocabulary"] = f"WITH {CRAWLED}, t AS (SELECT doc_id, unnest({TERMS.format('title')}) AS term FROM crawled) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM t GROUP BY term"


@plan
def search_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.vocabulary(search.postings(crawled(spark, sf_dir), ("title",)))
    return search.with_typos(search.query_terms(asked(spark, sf_dir)), words).select("query_id", "term", "word", F.col("typos").cast("long").alias("typos"))


# DuckDB's edit distance counts bytes, so tests hold this one.


@plan
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = asked(spark, sf_dir).select("query_id", F.array_join(F.slice(F.split("query", " "), 1, 2), " ").alias("phrase"))
    return search.phrase_matches(phrases, search.postings(crawled(spark, sf_dir), ("body",)))


SQL["search_phrases"] = rf"""
WITH {CRAWLED}, {ASKED}, p AS (SELECT query_id, ' ' || array_to_string({TERMS.format("array_to_string(string_split(query, ' ')[1:2], ' ')")}, ' ') || ' ' AS p FROM asked),
b AS (SELECT doc_id, ' ' || array_to_string({TERMS.format('body')}, ' ') || ' ' AS b FROM crawled)
SELECT query_id, doc_id FROM p JOIN b ON contains(b, p) WHERE trim(p) <> ''"""


@plan
def search_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.excluding(crawled(spark, sf_dir), ["the", "und"]).select("doc_id")


SQL["search_exclusion"] = rf"WITH {CRAWLED}, f AS (SELECT doc_id, trim(regexp_replace(lower(title || ' ' || body), '\s+', ' ', 'g')) AS t FROM crawled) SELECT doc_id FROM f WHERE NOT contains(t, 'the') AND NOT contains(t, 'und')"


@plan
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crawled(spark, sf_dir).withColumnRenamed("precision", "published_at_precision")
    f = search.Filters(languages=("en", "fr"), published_from=NOW, published_to=NOW - 90 * 86400, spam_below=0.8)
    return docs.filter(f.predicate()).select("doc_id", "language", "published_at")


SQL["search_filters"] = f"WITH {CRAWLED} SELECT doc_id, language, published_at FROM crawled WHERE language IN ('en', 'fr') AND published_at BETWEEN {NOW - 90 * 86400} AND {NOW} AND spam_score < 0.8 AND precision <> 'unknown'"


@plan
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(crawled(spark, sf_dir), ["domain", "language"])


SQL["search_facets"] = f"WITH {CRAWLED} SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM crawled GROUP BY domain UNION ALL SELECT 'language', language, count(*) FROM crawled GROUP BY language"


@plan
def search_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))
    first, second = hits.filter("doc_id % 7 = 0"), hits.filter("doc_id % 3 = 0")
    merged = search.merge_legs(first, second)
    return merged.select("query_id", "doc_id", F.col("leg").cast("long").alias("leg"), F.col("pos").cast("long").alias("pos"))


SQL["search_legs"] = f"""
WITH {_HITS}, one AS (SELECT query_id, doc_id, pos FROM hits WHERE doc_id % 7 = 0), few AS (SELECT query_id FROM one GROUP BY 1 HAVING count(*) >= 5),
two AS (SELECT query_id, doc_id, pos FROM hits WHERE doc_id % 3 = 0 AND query_id NOT IN (SELECT query_id FROM few)),
u AS (SELECT *, 0 AS leg FROM one UNION ALL SELECT *, 1 FROM two),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY leg, pos) AS n FROM u)
SELECT query_id, doc_id, CAST(leg AS BIGINT) AS leg, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos, doc_id) AS pos FROM k WHERE n = 1"""


@plan
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _hits(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    return n.select("query_id", "n", search.count_bucket(F.col("n")).alias("bucket"), search.page_count(F.col("n"), 20).cast("long").alias("pages"))


SQL["search_counts"] = f"WITH {_HITS} SELECT query_id, count(*) AS n, CASE WHEN count(*) <= 10 THEN '1-10' WHEN count(*) <= 100 THEN '11-100' ELSE '101-1000' END AS bucket, CAST(least(100, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM hits GROUP BY query_id"


@plan
def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listing(crawled(spark, sf_dir).withColumn("crawled_at", F.col("published_at")), "src1", None, 1, 10).select("doc_id", "crawled_at")


SQL["search_listing"] = f"WITH {CRAWLED} SELECT doc_id, published_at AS crawled_at FROM crawled WHERE domain = 'src1' ORDER BY published_at DESC, doc_id LIMIT 10"


@plan
def search_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    concepts = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("variants"))
    return search.synonyms(concepts).select("term", F.array_join("synonyms", "|").alias("synonyms"))


SQL["search_synonyms"] = "SELECT a.n_name AS term, string_agg(DISTINCT b.n_name, '|' ORDER BY b.n_name) AS synonyms FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY a.n_name"


@plan
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = crawled(spark, sf_dir).select("title")
    curated = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit(0.8).alias("weight"))
    prefixes = asked(spark, sf_dir).select("query_id", F.left("query", F.lit(3)).alias("prefix"))
    found = suggest.by_prefix(suggest.build(curated, titles), prefixes)
    return found.select("query_id", "key", "weight", F.col("rank").cast("long").alias("rank"))


SQL["suggest_prefix"] = rf"""
WITH {CRAWLED}, {ASKED}, t AS (SELECT rtrim(left(trim(split_part(split_part(title, ' | ', 1), ' - ', 1)), 70)) AS term, 1.0 AS weight FROM crawled UNION ALL SELECT n_name, 0.8 * 0.9 FROM nation),
k AS (SELECT trim(regexp_replace(lower(term), '\s+', ' ', 'g')) AS key, term, weight FROM t),
i AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY weight DESC, term DESC) = 1),
p AS (SELECT query_id, trim(regexp_replace(lower(left(query, 3)), '\s+', ' ', 'g')) AS f FROM asked),
s AS (SELECT query_id, key, term, weight FROM p JOIN i ON starts_with(key, f) WHERE length(f) >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key) <= 64)
SELECT query_id, key, CAST(weight AS DOUBLE) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, length(term), term) AS rank FROM s QUALIFY rank <= 8"""


@plan
def suggest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crawled(spark, sf_dir)
    legs = d.select((F.col("doc_id") % 20).alias("query_id"), F.explode(F.array(F.substring("title", 1, 4), F.substring("title", 1, 8))).alias("term"), (F.col("doc_id") % 9 / 9.0).alias("weight")).withColumn("key", fold_plain(F.col("term")))
    return suggest.merge(legs).select("query_id", "key", F.col("rank").cast("long").alias("rank"))


SQL["suggest_merge"] = rf"""
WITH {CRAWLED}, l AS (SELECT doc_id % 20 AS query_id, unnest([left(title, 4), left(title, 8)]) AS term, (doc_id % 9) / 9.0::DOUBLE AS weight FROM crawled),
k AS (SELECT *, trim(regexp_replace(lower(term), '\s+', ' ', 'g')) AS key FROM l),
o AS (SELECT query_id, key, max(row(weight, term)) AS x FROM k GROUP BY ALL),
p AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY x[1] DESC, length(x[2]), x[2]) AS place FROM o QUALIFY place <= 64),
s AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.query_id = p.query_id AND b.place < p.place AND length(b.key) > length(p.key) AND starts_with(b.key, p.key)))
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM s QUALIFY rank <= 8"""


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir).select("query_id")
    labels = table(spark, sf_dir, "labels")
    return labels.join(q, F.col("doc_id") % 20 == F.col("query_id") % 20).select("query_id", "doc_id", (F.col("quality") * 2 + (F.col("doc_id") % 2) * F.col("quality")).cast("int").alias("grade"))


_GOLDEN = "golden AS (SELECT query_id, doc_id, quality * 2 + (doc_id % 2) * quality AS grade FROM labels JOIN asked ON doc_id % 20 = query_id % 20)"


@plan
def evaluate_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _hits(spark, sf_dir).select("query_id", "doc_id", "pos")
    m = evaluate.measures(results, _golden(spark, sf_dir))
    return m.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"), F.col("results").cast("long").alias("results"), F.col("unjudged").cast("long").alias("unjudged"))


_MEASURES = f"""{_HITS}, {_GOLDEN},
top AS (SELECT h.query_id, h.doc_id, h.pos, g.grade FROM hits h LEFT JOIN golden g USING (query_id, doc_id) WHERE h.pos <= 10),
got AS (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(pos + 1)) AS dcg, min(CASE WHEN grade >= 2 THEN pos END) AS fg, sum(CASE WHEN coalesce(grade, 0) > 0 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN grade IS NULL THEN 1 ELSE 0 END) AS unjudged, count(*) AS results FROM top GROUP BY query_id),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM golden),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS idcg, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS relevant FROM pl GROUP BY query_id),
m AS (SELECT query_id, CASE WHEN idcg > 0 THEN least(1.0, coalesce(dcg, 0) / idcg) END AS ndcg, coalesce(1.0 / fg, 0.0) AS mrr, CASE WHEN relevant > 0 THEN coalesce(good, 0) / CAST(relevant AS DOUBLE) END AS recall,
             CAST(coalesce(results, 0) AS BIGINT) AS results, CAST(coalesce(unjudged, 0) AS BIGINT) AS unjudged FROM ideal LEFT JOIN got USING (query_id))"""
SQL["evaluate_measures"] = f"WITH {_MEASURES} SELECT query_id, round(CAST(ndcg AS DOUBLE), 6) AS ndcg, round(CAST(mrr AS DOUBLE), 6) AS mrr, round(CAST(recall AS DOUBLE), 6) AS recall, results, unjudged FROM m"


@plan
def evaluate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.measures(_hits(spark, sf_dir).select("query_id", "doc_id", "pos"), _golden(spark, sf_dir)).withColumn("lang", F.concat(F.lit("g"), (F.col("query_id") % 3).cast("string")))
    r = evaluate.report(m, "lang")
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang"), "queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall", "zero_rate")], F.col("unjudged").cast("long").alias("unjudged"))


SQL["evaluate_report"] = f"""
WITH {_MEASURES}, g AS (SELECT *, 'g' || CAST(query_id % 3 AS VARCHAR) AS lang FROM m)
SELECT coalesce(lang, 'all') AS lang, count(*) AS queries, round(CAST(avg(ndcg) AS DOUBLE), 6) AS ndcg, round(CAST(avg(mrr) AS DOUBLE), 6) AS mrr, round(CAST(avg(recall) AS DOUBLE), 6) AS recall,
       round(CAST(avg(CASE WHEN results = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS zero_rate, CAST(sum(unjudged) AS BIGINT) AS unjudged FROM g GROUP BY ROLLUP (lang)"""


@plan
def evaluate_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crawled(spark, sf_dir)
    return d.groupBy(evaluate.age_bucket(F.lit(NOW), F.col("published_at")).alias("bucket")).agg(F.count("*").alias("n"))


SQL["evaluate_age"] = f"""
WITH {CRAWLED}, a AS (SELECT ({NOW} - published_at) // 86400 AS d, published_at FROM crawled)
SELECT CASE WHEN published_at <= 0 THEN 'unknown' WHEN d < 0 THEN 'future' WHEN d <= 1 THEN '0-1d' WHEN d <= 7 THEN '2-7d' WHEN d <= 30 THEN '8-30d' WHEN d <= 365 THEN '31-365d' ELSE '365d+' END AS bucket, count(*) AS n FROM a GROUP BY 1"""


@plan
def evaluate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("found")), "doc_id").withColumn("truth", F.col("quality") == 1)
    c = dedup.confusion(pairs, "truth", "found")
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "accuracy", "f1")])


SQL["evaluate_confusion"] = """
WITH p AS (SELECT quality = 1 AS t, n_chars > 500 AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CAST(count(*) FILTER (t AND f) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT t AND f) AS BIGINT) AS fp, CAST(count(*) FILTER (t AND NOT f) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT t AND NOT f) AS BIGINT) AS tn FROM p),
r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r"""


@plan
def evaluate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = asked(spark, sf_dir).select("query_id", F.explode(tokens(F.lower("query"))).alias("w"))
    held = crawled(spark, sf_dir).select("doc_id", F.lower("title").alias("title"))
    share = held.join(small(words), F.contains("title", "w"))
    n = words.groupBy("query_id").agg(F.count("*").alias("n"))
    graded = share.groupBy("query_id", "doc_id").agg(F.count("*").alias("k")).join(small(n), "query_id")
    return graded.select("query_id", "doc_id", evaluate.grade_by_coverage(F.col("k") / F.col("n")).cast("long").alias("grade"))


SQL["evaluate_coverage"] = f"""
WITH {CRAWLED}, {ASKED}, w AS (SELECT query_id, unnest(list_filter(string_split(lower(query), ' '), lambda t: t <> '')) AS w FROM asked),
s AS (SELECT query_id, doc_id, count(*) AS k FROM w JOIN crawled ON contains(lower(title), w) GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1)
SELECT query_id, doc_id, CAST(CASE WHEN k / CAST(n AS DOUBLE) >= 0.99 THEN 3 WHEN k / CAST(n AS DOUBLE) >= 0.6 THEN 2 ELSE 1 END AS BIGINT) AS grade FROM s JOIN n USING (query_id)"""


@plan
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return dedup.new_only(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0")).select("doc_id", "content_hash")


SQL["dedup_exact"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents)
SELECT min(doc_id) AS doc_id, content_hash FROM d WHERE doc_id % 10 <> 0 AND content_hash NOT IN (SELECT content_hash FROM d WHERE doc_id % 10 = 0) GROUP BY content_hash"""


@plan
def dedup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.functions.text import normalize, simhash

    # Hashed once: the few bytes of each document are written for both sides of the joins, which would start on a cache before it is filled.
    hashed = table(spark, sf_dir, "documents").select("doc_id", simhash(normalize(F.coalesce("text", F.lit("")))).alias("simhash"))
    hashed.write.parquet(path := scratch(spark, "simhashes"))
    hashed = spark.read.schema(hashed.schema).parquet(path)
    return dedup.near_links(hashed).unionByName(dedup.hash_members(hashed))


SQL["dedup_near"] = f"""
WITH s AS ({SIMHASH}), h AS (SELECT doc_id, CAST('0x' || simhash AS UBIGINT) AS h FROM s WHERE simhash IS NOT NULL), f AS (SELECT h, min(doc_id) AS doc_id FROM h GROUP BY h)
SELECT a.doc_id, b.doc_id AS near_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM f a JOIN f b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 3
UNION ALL SELECT DISTINCT f.doc_id, h.doc_id, 0 FROM h JOIN f USING (h) WHERE f.doc_id < h.doc_id"""


@plan
def dedup_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crawled(spark, sf_dir).withColumns({"cluster_id": F.sha2("body", 256), "trust": F.col("doc_id") % 3, "engagement": F.col("doc_id") % 100})
    return dedup.winners(d).select("doc_id", F.col("engagement").cast("long").alias("engagement"), "members")


SQL["dedup_winner"] = f"""
WITH {CRAWLED}, r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY precision = 'unknown', published_at, -(doc_id % 3), -body_len, doc_id) AS k, sum(doc_id % 100) OVER (PARTITION BY body) AS engagement, count(*) OVER (PARTITION BY body) AS members FROM crawled)
SELECT doc_id, CAST(engagement AS BIGINT) AS engagement, members FROM r WHERE k = 1"""
