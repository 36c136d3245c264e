"""Plans over crawl logs: revisits, politeness, the frontier, limits, queues, windows, instant answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import urls
from siftline.functions.answers import answers
from siftline.functions.fixed import LEADING_ONLY, QUESTION_PHRASES, QUESTION_WORDS
from siftline.functions.language import is_question
from siftline.operators import crawl
from siftline.plans.base import Query, table
from siftline.sources.sinks import batches, job_error

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))


@plan
def crawl_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type in ('view', 'purchase')")
    visits = e.select(F.concat(F.lit("u"), "user_id").alias("url"), (F.col("user_id") % 100).alias("trust"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("changed"))
    return crawl.revisit(visits).withColumn("visits", F.col("visits").cast("long"))


# A page's history folded visit by visit: changes halve the interval, others add the floor; both stay in the trust's bounds.
SQL["crawl_revisit"] = """
WITH RECURSIVE v AS (SELECT 'u' || user_id AS url, user_id % 100 AS trust, event_type = 'purchase' AS changed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'purchase')),
b AS (SELECT url, CASE WHEN trust >= 80 THEN 3600 WHEN trust >= 50 THEN 7200 ELSE 21600 END AS lo, CASE WHEN trust >= 80 THEN 259200 WHEN trust >= 50 THEN 1209600 ELSE 2592000 END AS hi, max(k) AS visits FROM v GROUP BY ALL),
f AS (SELECT url, CAST(0 AS BIGINT) AS k, CAST(least(greatest(86400, lo), hi) AS BIGINT) AS i, CAST(0 AS BIGINT) AS streak, false AS volatile FROM b
  UNION ALL SELECT url, k, CASE WHEN volatile THEN hi ELSE least(greatest(moved, lo), hi) END, streak, volatile FROM (
    SELECT f.url, v.k, b.lo, b.hi, CASE WHEN v.changed AND f.i <= b.lo THEN f.streak + 1 ELSE 0 END AS streak, f.volatile OR (v.changed AND f.i <= b.lo AND f.streak >= 3) AS volatile,
           CASE WHEN v.changed THEN f.i // 2 ELSE f.i + b.lo END AS moved FROM f JOIN v ON v.url = f.url AND v.k = f.k + 1 JOIN b ON b.url = f.url))
SELECT url, i AS interval_s, CAST(streak AS INTEGER) AS streak, volatile, visits FROM f JOIN b USING (url) WHERE k = visits"""


@plan
def crawl_politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, 429).otherwise(503)).otherwise(200)
    replies = e.select(F.concat(F.lit("h"), "user_id").alias("host"), F.col("event_id").alias("ts"), status.alias("status"), F.lit(None).cast("int").alias("retry_after"))
    return crawl.politeness(replies).select("host", F.round("delay_s", 6).alias("delay_s"), F.col("replies").cast("long").alias("replies"))


SQL["crawl_politeness"] = """
WITH RECURSIVE v AS (SELECT 'h' || user_id AS host, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 429 ELSE 503 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
b AS (SELECT host, max(k) AS replies FROM v GROUP BY host),
f AS (SELECT host, CAST(0 AS BIGINT) AS k, CAST(1.5 AS DOUBLE) AS delay FROM b
  UNION ALL SELECT f.host, v.k, CAST(CASE v.status WHEN 429 THEN least(greatest(f.delay * 4, 60), 600) WHEN 503 THEN least(f.delay * 2, 300) ELSE greatest(f.delay * 0.9::DOUBLE, 1.5) END AS DOUBLE) FROM f JOIN v ON v.host = f.host AND v.k = f.k + 1)
SELECT host, round(delay, 6) AS delay_s, replies FROM f JOIN b USING (host) WHERE k = replies"""


@plan
def crawl_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 304).otherwise(200)
    seen = e.select(F.col("user_id").alias("url"), F.col("event_id").alias("ts"), status.alias("status"), F.col("event_type").alias("content_hash"))
    return crawl.observations(seen).groupBy("url").agg(F.sum(F.col("changed").cast("long")).alias("changes"))


SQL["crawl_observations"] = """
WITH h AS (SELECT user_id AS url, event_id, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hash FROM events),
w AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY event_id) AS was FROM h)
SELECT url, CAST(sum(CASE WHEN hash <> was THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM w GROUP BY url"""


@plan
def crawl_sitemap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.when(F.col("c_custkey") % 4 > 0, 1_705_000_000 + F.col("c_custkey") * 1000).alias("lastmod"))
    visits = e.select(F.col("user_id").alias("url"), F.col("s").alias("visited_at"))
    return crawl.sitemap_verdicts(entries, visits).groupBy("verdict").agg(F.count("*").alias("n"))


SQL["crawl_sitemap_verdict"] = """
WITH v AS (SELECT user_id AS url, max(epoch(date_trunc('second', ts))) AS seen_at FROM events GROUP BY 1), e AS (SELECT c_custkey AS url, CASE WHEN c_custkey % 4 > 0 THEN 1705000000 + c_custkey * 1000 END AS lastmod FROM customer)
SELECT CASE WHEN lastmod IS NULL OR seen_at IS NULL THEN 'unknown' WHEN lastmod > seen_at THEN 'changed' ELSE 'unchanged' END AS verdict, count(*) AS n FROM e LEFT JOIN v USING (url) GROUP BY 1"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("url", urls.host_of(F.col("url")).alias("host"), (F.length("url") * 10).cast("long").alias("priority"), (F.col("page_id") * 7 % 1000).cast("long").alias("due_at"), "page_id")


@plan
def crawl_frontier_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    return crawl.add_to_frontier(q.filter("page_id % 3 = 0").drop("page_id"), q.filter("page_id % 3 > 0").drop("page_id"), q.filter("page_id % 5 = 0").select("url"), cap=3).select("url", "host", "priority")


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
SQL["crawl_frontier_add"] = f"""
WITH q AS (SELECT url, {_HOST} AS host, CAST(length(url) * 10 AS BIGINT) AS priority, page_id FROM pages),
f AS (SELECT DISTINCT url, host, priority FROM q WHERE page_id % 3 > 0 AND url NOT IN (SELECT url FROM q WHERE page_id % 5 = 0)),
w AS (SELECT host, count(*) AS w FROM q WHERE page_id % 3 = 0 GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, url) AS turn FROM f)
SELECT url, host, priority FROM t LEFT JOIN w USING (host) WHERE turn <= 3 AND turn + coalesce(w, 0) <= 3"""


@plan
def crawl_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    hosts = q.groupBy("host").agg(F.min("due_at").alias("due_at")).withColumn("delay_s", F.lit(2))
    return crawl.claim(q, hosts, now=500, most=20).select("host", "url", F.col("lease_until").cast("long").alias("lease_until"))


SQL["crawl_claim"] = f"""
WITH q AS (SELECT url, {_HOST} AS host, length(url) * 10 AS priority, page_id * 7 % 1000 AS due_at FROM pages), h AS (SELECT host, min(due_at) AS due_at FROM q GROUP BY 1),
b AS (SELECT host, url FROM q QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority, url) = 1)
SELECT host, url, CAST(620 AS BIGINT) AS lease_until FROM h JOIN b USING (host) WHERE due_at <= 500 ORDER BY due_at, host LIMIT 20"""


@plan
def crawl_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    judged = crawl.rate_limited(e.select(F.col("user_id").alias("client"), F.col("s").alias("ts"), F.col("event_id").alias("request_id")), limit=1, window_s=7200)
    return judged.groupBy("client").agg(F.sum(F.col("allowed").cast("long")).alias("allowed"), F.count("*").alias("n"))


SQL["crawl_rate_limit"] = """
WITH RECURSIVE e AS (SELECT user_id AS client, epoch(date_trunc('second', ts)) AS s FROM events),
w AS (SELECT client, min(s) AS o FROM e GROUP BY 1 UNION ALL SELECT w.client, (SELECT min(s) FROM e WHERE e.client = w.client AND e.s >= w.o + 7200) FROM w WHERE o IS NOT NULL),
a AS (SELECT client, count(*) AS allowed FROM w WHERE o IS NOT NULL GROUP BY 1)
SELECT client, CAST(allowed AS BIGINT) AS allowed, n FROM a JOIN (SELECT client, count(*) AS n FROM e GROUP BY 1) USING (client)"""


@plan
def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "click", 304).when(F.col("event_type") == "signup", 429).otherwise(200)
    rows = e.select(crawl.outcome(status, F.lit(None).cast("string")).alias("reason"), urls.retryable(status).alias("retryable"))
    return rows.groupBy("reason", "retryable").agg(F.count("*").alias("n"))


SQL["crawl_outcomes"] = "SELECT CASE event_type WHEN 'error' THEN 'server_error' WHEN 'click' THEN 'not_modified' WHEN 'signup' THEN 'rate_limited' ELSE 'fetched' END AS reason, event_type IN ('error', 'signup') AS retryable, count(*) AS n FROM events GROUP BY ALL"


@plan
def crawl_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), F.col("ts").alias("at"), F.col("event_id").alias("url"), F.col("user_id").alias("host"))
    return crawl.counters(log)["recent"].select("url", "reason")


SQL["crawl_recent"] = "SELECT event_id AS url, event_type AS reason FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"


@plan
def crawl_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = crawl.histogram(table(spark, sf_dir, "events"), "value", [1, 10, 50, 100])
    return h.select("le_1", "le_10", "le_50", "le_100", F.col("count").alias("n"))


SQL["crawl_histogram"] = "SELECT " + ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{b}" for b in (1, 10, 50, 100)) + ", count(value) AS n FROM events"


@plan
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    w = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


SQL["stream_tumbling"] = "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL"


@plan
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    s = e.groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


SQL["stream_sessions"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k"""


@plan
def queue_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 7 == 0, F.lit("[1, 2]")).when(F.col("doc_id") % 7 == 1, F.to_json(F.struct(F.lit("").alias("id"), F.col("text").alias("body")))).when(F.col("doc_id") % 7 == 2, F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(" ").alias("body")))).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))))
    return d.select(F.coalesce(job_error(payload), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


SQL["queue_validation"] = "SELECT CASE doc_id % 7 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'missing_id' WHEN 2 THEN 'empty' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1"


@plan
def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("payload"))
    return batches(jobs).groupBy("lane", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


# Lane by lane, a batch closes before the row that would make it too large.
SQL["queue_batches"] = """
WITH RECURSIVE j AS (SELECT CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 6) AS BIGINT) % 64 AS INTEGER) AS lane, CAST(doc_id AS VARCHAR) AS id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes, text IS NULL AS none FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) AS k FROM j),
f AS (SELECT lane, k, CAST(0 AS INTEGER) AS batch, CAST(1 AS BIGINT) AS n, bytes AS size FROM r WHERE k = 1
  UNION ALL SELECT r.lane, r.k, CAST(f.batch + CASE WHEN f.n >= 500 OR f.size + r.bytes > 4194304 THEN 1 ELSE 0 END AS INTEGER), CASE WHEN f.n >= 500 OR f.size + r.bytes > 4194304 THEN 1 ELSE f.n + 1 END,
            CASE WHEN f.n >= 500 OR f.size + r.bytes > 4194304 THEN r.bytes ELSE f.size + r.bytes END FROM f JOIN r ON r.lane = f.lane AND r.k = f.k + 1)
SELECT lane, batch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM f JOIN r USING (lane, k) GROUP BY lane, batch"""


@plan
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", is_question(F.coalesce("text", F.lit(""))).alias("question"))


SQL["questions"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS raw, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS n FROM conversations),
w AS (SELECT *, list_transform(list_filter(string_split(n, ' '), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS w FROM t)
SELECT conv_id, turn, regexp_matches(trim(raw), '[?؟]$') OR """ + " OR ".join(f"contains(n, '{p.replace(chr(39), chr(39) * 2)}')" for p in QUESTION_PHRASES) + """
  OR (len(w) >= 2 AND (list_has_any(w, [""" + ", ".join(f"'{w}'" for w in QUESTION_WORDS if w not in LEADING_ONLY) + "]) OR list_contains([" + ", ".join(f"'{w}'" for w in QUESTION_WORDS) + "], w[1]))) AS question FROM w"


@plan
def instant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_size").distinct()
    q = p.select("p_size", F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("km in m")).alias("query"))
    return q.select("p_size", answers(F.col("query"), F.lit("en")).alias("a")).select("p_size", "a.tool", "a.value")


SQL["instant_answers"] = "SELECT DISTINCT p_size, 'units' AS tool, CAST(p_size * 1000 AS VARCHAR) || ' m' AS value FROM part"


@plan
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


SQL["corpus_counts"] = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY lang"
