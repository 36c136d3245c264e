"""Plans over readers, sinks, queues, streams and crawl tables: tables are written in a reader's format and read back, queues are filled and
drained, streams run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dates, text, urls
from siftline.operators import crawl, registry, search
from siftline.operators.sizes import small
from siftline.plans.base import ASKED, CRAWLED, NOW, TERMS, Query, asked, crawled, table
from siftline.plans.crawl_plans import SQL as _CRAWL_SQL
from siftline.sources import readers, sinks
from siftline.sources.scratch import scratch
from siftline.streaming import streams

_REVISIT = _CRAWL_SQL["crawl_revisit"]
#: So many URLs are put into one sitemap on average.
_SITEMAP_URLS = 1_000
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _lines(spark: SparkSession, rows: DataFrame, tag: str) -> str:
    """The path of a text file with the rows' first column, line by line."""
    path = scratch(spark, tag)
    rows.toDF("value").write.text(path)
    return path


# --- readers


@plan
def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines, read by the corpus reader."""
    d = crawled(spark, sf_dir)
    path = _lines(spark, d.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "title", "body", "language", "published_at", "body_len")).alias("value")), "corpus")
    return readers.read_corpus(spark, path).select("id", "title", F.length("body").cast("long").alias("chars"), F.md5("body").alias("digest"), "language", "published_at", "body_len")


SQL["read_corpus"] = f"WITH {CRAWLED} SELECT CAST(doc_id AS VARCHAR) AS id, title, CAST(length(body) AS BIGINT) AS chars, md5(body) AS digest, language, published_at, CAST(body_len AS BIGINT) AS body_len FROM crawled"


@plan
def read_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds: a comment, spaces around fields, tiers in lower case or missing, lines without a URL."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    line = F.concat_ws("\t", key, F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit(" https://s"), key, F.lit(".example/ "))).otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, "a").when(F.col("s_suppkey") % 3 == 1, "C").otherwise(""), F.lit("note"))
    path = _lines(spark, s.select(F.when(F.col("s_suppkey") % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")), "seeds")
    return readers.read_seeds(spark, path).select("id", "url", "tier")


SQL["read_seeds"] = """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'https://s' || s_suppkey || '.example/' AS url, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'B' END AS tier
FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0"""


@plan
def read_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the parts' names, graded by words, numbers, or nonsense."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"))
    k = F.col("p_partkey")
    grade = F.when(k % 4 == 0, "strong").when(k % 4 == 1, "weak").when(k % 4 == 2, (k % 5 / 10.0).cast("string")).otherwise("unknown")
    path = _lines(spark, p.select(F.concat_ws("\t", "name", grade, F.lit("gloss")).alias("value")), "lexicon")
    return readers.read_lexicon(spark, path).select("term", "weight")


SQL["read_lexicon"] = """SELECT lower(p_name) AS term, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE CAST((p_partkey % 5) / 10.0 AS DOUBLE) END::DOUBLE AS weight
FROM part WHERE p_partkey % 4 < 3 AND len(string_split_regex(lower(p_name), ' +')) <= 2"""


@plan
def read_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    variants = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit(" | "), F.lower("n_name"), F.lit("||")))
    weight = F.when(F.col("n_nationkey") % 2 == 0, "0.5").otherwise("x")
    path = _lines(spark, n.select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), variants, weight, F.lit("")).alias("value")), "concepts")
    return readers.read_concepts(spark, path).select("id", F.array_join("variants", "/").alias("variants"), "weight")


SQL["read_concepts"] = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || '/' || lower(n_name) AS variants, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.85 END AS DOUBLE) AS weight FROM nation WHERE n_nationkey % 5 <> 0"


@plan
def read_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valences, phrases and curated suggestions, each from a file of its own kind."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    valence = readers.read_valence(spark, _lines(spark, n.select(F.concat_ws("\t", "n_name", F.when(key % 3 > 0, (key - 10).cast("string")).otherwise("?"), F.lit("g"))), "valence"))
    phrases = readers.read_phrases(spark, _lines(spark, n.select(F.when(key % 4 == 0, F.concat(F.lit("# "), "n_name")).when(key % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))), "phrases"))
    curated = readers.read_suggestions(spark, _lines(spark, n.select(F.concat_ws("\t", "n_name", F.lit("en"), (key / 4.0).cast("string"))), "suggestions"))
    one = valence.select(F.lit("valence").alias("list"), "term", F.col("valence").alias("value"))
    two = phrases.select(F.lit("phrase").alias("list"), F.col("phrase").alias("term"), F.lit(None).cast("double").alias("value"))
    return one.unionByName(two).unionByName(curated.select(F.lit("suggestion").alias("list"), "term", F.col("weight").alias("value")))


SQL["read_lists"] = """SELECT 'valence' AS list, lower(n_name) AS term, CAST(n_nationkey - 10 AS DOUBLE) AS value FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'phrase', lower(n_name), NULL FROM nation WHERE n_nationkey % 4 > 1 UNION ALL SELECT 'suggestion', n_name, CAST(n_nationkey / 4.0 AS DOUBLE) FROM nation"""


@plan
def read_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction rules of a TOML text, one for each of the few regions."""
    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    toml = "\n".join(f'[[domain]]\nhost = "{n.lower().replace(" ", "-")}.example"\nbody = "div.{len(n)}"\n' for n in names)
    return spark.createDataFrame([(r["host"], r["body"]) for r in readers.read_rules(toml)], "host string, body string")


SQL["read_rules"] = "SELECT replace(lower(r_name), ' ', '-') || '.example' AS host, 'div.' || length(r_name) AS body FROM region"


@plan
def read_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged queries behind a header with the corpus size."""
    b = table(spark, sf_dir, "benchmark")
    judged = b.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.left("text", F.lit(20)).alias("query"), F.lit("en").alias("lang"), F.create_map(F.lit("d1"), (F.col("item_id") % 4).cast("int")).alias("judgements"))).alias("value"))
    header = spark.createDataFrame([('{"_meta": {"corpus_size": 77}}',)], "value string")
    size, rows = readers.read_golden(spark, _lines(spark, header.unionByName(judged), "golden"))
    return rows.select("id", "query", F.element_at("judgements", "d1").alias("grade"), F.lit(size).alias("corpus_size"))


SQL["read_golden"] = "SELECT CAST(item_id AS VARCHAR) AS id, left(text, 20) AS query, CAST(item_id % 4 AS INTEGER) AS grade, CAST(77 AS BIGINT) AS corpus_size FROM benchmark"


@plan
def read_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps for each host, of all its pages, with dates by day or second. A URL of several pages has the date of the first one; a host's
    URLs are dealt by their hash to as many sitemaps as keep each far below the 50,000 URLs that the reader takes of one."""
    p = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    p = p.select("page_id", F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("url"), urls.host_of(F.col("url")).alias("host"))
    parts = p.groupBy(F.col("host").alias("of")).agg(F.ceil(F.count("*") / _SITEMAP_URLS).alias("parts"))
    p = p.join(small(parts), F.col("host").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")))
    when = F.when(F.col("page_id") % 3 == 0, "<lastmod>2023-05-06</lastmod>").when(F.col("page_id") % 3 == 1, "<lastmod>2023-05-06T01:02:03Z</lastmod>").otherwise("")
    by_host = p.groupBy("host", "part").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc>"), when, F.lit("</url>")))).alias("body"))
    xml = by_host.select("host", F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</urlset>")).alias("xml"))
    # Read before it is exploded: beside explode, the test for an index would run over the whole XML again for each entry.
    read = xml.select("host", readers.is_sitemap_index(F.col("xml")).alias("is_index"), readers.sitemap(F.col("xml")).alias("entries"))
    entries = read.select("host", "is_index", F.explode("entries").alias("e"))
    return entries.select("host", "is_index", "e.url", dates.w3c_date(F.col("e.lastmod")).alias("lastmod"))


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
SQL["read_sitemaps"] = f"""SELECT {_HOST} AS host, false AS is_index, url, CAST(min(CASE page_id % 3 WHEN 0 THEN epoch(TIMESTAMP '2023-05-06') WHEN 1 THEN epoch(TIMESTAMP '2023-05-06 01:02:03') END) AS BIGINT) AS lastmod
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages) WHERE k = 1 GROUP BY ALL"""


@plan
def read_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as bytes of three encodings, decoded by label, by the page's own label, or without any."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-16")).when(k == 1, F.encode(F.concat(F.lit('<meta charset="utf-8">'), "text"), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    label = F.when(k == 0, "utf-16")
    found = d.select("doc_id", readers.decoded(data, label).alias("text"))
    return found.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


SQL["read_charsets"] = """SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '<meta charset="utf-8">' ELSE '' END || coalesce(text, '') AS t FROM documents)"""


@plan
def read_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fetched pages those that are neither old nor large, the newest of each URL."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_type").alias("body"))
    last = F.unix_timestamp(F.lit("2024-01-20").cast("timestamp"))
    return readers.fresh_pages(e, last, 10 * 86400, most_bytes=6).groupBy("url").agg(F.max(F.unix_timestamp("fetched_at")).alias("at"), F.count("*").alias("n"))


SQL["read_raw_pages"] = """WITH l AS (SELECT 'u' || user_id AS url, ts, event_type FROM events WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-20') - 864000 AND octet_length(encode(event_type)) <= 6)
SELECT url, CAST(floor(epoch(max(ts))) AS BIGINT) AS at, count(*) AS n FROM l JOIN (SELECT url, max(ts) AS ts FROM l GROUP BY url) USING (url, ts) GROUP BY url"""


@plan
def read_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    reply = F.concat(F.lit('{"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": ['), key, F.lit(".5, 3], \"temperature_2m_min\": [1, -"), key, F.lit('.5], "weather_code": [1, 61]}}'))
    return n.select("n_name", F.explode(readers.weather_forecast(reply)).alias("d")).select("n_name", "d.day", "d.high", "d.low", "d.code")


SQL["read_forecasts"] = """SELECT n_name, '2024-01-01' AS day, n_nationkey + 0.5::DOUBLE AS high, 1::DOUBLE AS low, 1::INTEGER AS code FROM nation UNION ALL SELECT n_name, '2024-01-02', 3, -(n_nationkey + 0.5)::DOUBLE, 61 FROM nation"""


@plan
def text_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with stretched letters, diacritics and Arabic digits put in: normalising takes them out again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    noisy = registry.noisy(d, "text")
    return noisy.select("doc_id", text.normalize(F.col("text")).alias("normal"), text.content_hash(F.col("text")).alias("content_hash"))


_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
SQL["text_noise"] = f"SELECT doc_id, {_NORMAL} AS normal, 's2:' || sha256({_NORMAL}) AS content_hash FROM documents"


# --- sinks and queues


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as jobs, every seventh without an id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.to_json(F.struct(F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("k"), (F.col("doc_id") % 100).cast("string"))).otherwise("").alias("id"), F.lit("t").alias("title"), F.col("doc_id").alias("indexed_at"))).alias("payload"))


@plan
def sink_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table through two puts and a deletion, read by its newest version."""
    good, _ = sinks.split_jobs(_jobs(spark, sf_dir))
    rows = good.select(F.get_json_object("payload", "$.id").alias("id"), F.col("doc_id").alias("indexed_at"))
    kept = sinks.VersionedTable(spark, scratch(spark, "versions"), "index")
    kept.put(rows.filter("indexed_at % 2 = 0"))
    kept.put(rows)
    kept.write(sinks.delete(kept.read(), rows.filter("indexed_at % 5 = 0").select("id")))
    return kept.read().withColumn("version", F.lit(kept.versions()[-1]))


SQL["sink_upserts"] = """WITH j AS (SELECT 'k' || doc_id % 100 AS id, doc_id FROM documents WHERE doc_id % 7 > 0)
SELECT id, max(doc_id) AS indexed_at, 3 AS version FROM j WHERE id NOT IN (SELECT id FROM j WHERE doc_id % 5 = 0) GROUP BY id"""


@plan
def sink_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad jobs are buried, counted, and replayed."""
    _, bad = sinks.split_jobs(_jobs(spark, sf_dir))
    path = scratch(spark, "dead")
    sinks.bury(bad, path)
    dead = sinks.letters(spark, path)
    again = sinks.replay(dead, 1_000_000).join(bad.select("payload", "doc_id"), "payload")
    counted = dead.groupBy("reason").agg(F.count("*").alias("n"))
    return counted.unionByName(again.agg(F.count("*").alias("n")).select(F.lit("replayed").alias("reason"), "n")).unionByName(sinks.dead_count(dead).select(F.lit("all").alias("reason"), "n"))


SQL["sink_dead_letters"] = """SELECT 'missing_id' AS reason, count(*) AS n FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'replayed', count(*) FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'all', count(*) FROM documents WHERE doc_id % 7 = 0"""


@plan
def queue_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of at most 150 rows: what is kept, delivered, acknowledged, pending and lagging."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("x").alias("payload"))
    queue = sinks.produce(sinks.trim(d, 140), spark.range(100).select(F.concat(F.lit("new "), F.col("id")).alias("payload")), 150)
    delivered, acked = queue.filter("payload = 'x'"), queue.filter("payload = 'x' and seq % 2 = 0")
    count = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = count(queue, "kept").unionByName(count(queue.filter("payload <> 'x'"), "new")).unionByName(count(sinks.pending(queue, delivered, acked), "pending")).unionByName(count(acked, "acked"))
    lagging = sinks.lag(queue, delivered)
    return out.unionByName(lagging.select(F.lit("lag").alias("what"), "n")).unionByName(lagging.select(F.when(crawl.paused(F.col("n"), 100), "paused").otherwise("open").alias("what"), F.lit(1).cast("long").alias("n")))


SQL["queue_cycle"] = """WITH k AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50)
SELECT 'kept' AS what, (SELECT count(*) FROM k) + 100 AS n UNION ALL SELECT 'new', 100 UNION ALL SELECT 'pending', count(*) FILTER (doc_id % 2 = 1) FROM k
UNION ALL SELECT 'acked', count(*) FILTER (doc_id % 2 = 0) FROM k UNION ALL SELECT 'lag', 100 UNION ALL SELECT 'paused', 1"""


# --- streams


def _parts(spark: SparkSession, frame: DataFrame, tag: str, order: str) -> str:
    """A folder of four files that a stream reads one by one, in order."""
    path = scratch(spark, tag)
    frame.repartitionByRange(4, order).write.parquet(path)
    return path


def _ended(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@plan
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from files of lines, a file a batch, into a versioned table; bad ones to the dead letters. A restart from the checkpoint changes nothing."""
    folder, state, dead = scratch(spark, "jobs"), scratch(spark, "state"), scratch(spark, "dead")
    _jobs(spark, sf_dir).select(F.col("payload").alias("value")).repartition(3).write.text(folder)
    kept = sinks.VersionedTable(spark, scratch(spark, "index"), "index")
    for _ in range(2):
        jobs = readers.read_queue(spark, folder, 1).select(F.col("value").alias("payload"))
        _ended(jobs.writeStream.foreachBatch(streams.index_sink(kept, dead)).option("checkpointLocation", state).trigger(availableNow=True).start())
    bad = sinks.letters(spark, dead).agg(F.count("*").alias("n")).select(F.lit("dead letters").alias("id"), F.col("n").alias("indexed_at"))
    return kept.read().select("id", "indexed_at").unionByName(bad)


SQL["stream_index"] = """SELECT 'k' || doc_id % 100 AS id, max(doc_id) AS indexed_at FROM documents WHERE doc_id % 7 > 0 GROUP BY 1 UNION ALL SELECT 'dead letters', count(*) FROM documents WHERE doc_id % 7 = 0"""


@plan
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of each user and day, batch by batch."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date")).alias("content_hash"))
    source, out = _parts(spark, e, "events", "ts"), scratch(spark, "dedup")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    once = streams.dedup(stream.select("ts", "content_hash"), late="400 days")
    _ended(once.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start())
    return spark.read.schema(e.schema).parquet(out).groupBy("content_hash").agg(F.count("*").alias("n"))


SQL["stream_dedup"] = "SELECT DISTINCT user_id || '/' || CAST(ts AS DATE) AS content_hash, CAST(1 AS BIGINT) AS n FROM events"


@plan
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by day and kind as a stream with a watermark, from files in order of time."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source, out = _parts(spark, e, "events", "ts"), scratch(spark, "windows")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = streams.windows(stream, late="400 days", size="1 day").select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    # In complete mode each batch has all windows so far; the last one is the result.
    _ended(counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start())
    return spark.read.schema("start_s long, event_type string, n long").parquet(out)


SQL["stream_windows"] = "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL"


@plan
def stream_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisit intervals kept as a stream's state, over files in order of the visits: the last state of each URL, with the bounds of its trust."""
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')")
    visits = e.select(F.concat(F.lit("u"), "user_id").alias("url"), (F.col("user_id") % 100).alias("trust"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("changed"))
    source, out = scratch(spark, "visits"), scratch(spark, "states")
    # One file after the other, as a stream takes the oldest first and the rule depends on the order of visits.
    cuts = [float("-inf"), *visits.approxQuantile("ts", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        visits.filter((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _ended(streams.revisit_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start())
    states = spark.read.schema("url string, interval_s long, volatile boolean, at long, batch string").parquet(out)
    return states.groupBy("url").agg(F.max(F.struct("at", "interval_s", "volatile")).alias("x")).select("url", "x.interval_s", "x.volatile")


SQL["stream_revisits"] = f"SELECT url, interval_s, volatile FROM ({_REVISIT})"


# --- crawl tables


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"))


@plan
def crawl_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all pages against lists of hosts and parent domains, one of them on two lists."""
    lists = spark.createDataFrame([("host_opt_out", "WWW.Example.org."), ("takedown", "example.net"), ("global", "m.example.net"), ("global", "spam-farm.example.org"), ("other", "example.com")], "tier string, host string")
    return crawl.blocked(_hosts(spark, sf_dir), lists)


SQL["crawl_blocklist"] = f"""SELECT DISTINCT host, CASE WHEN h = 'm.example.net' OR h LIKE '%.m.example.net' OR h = 'spam-farm.example.org' OR h LIKE '%.spam-farm.example.org' THEN 'global'
  WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'takedown' ELSE 'host_opt_out' END AS tier
FROM (SELECT {_HOST} AS host, regexp_replace({_HOST}, '^(www\\.)+', '') AS h FROM pages) WHERE h = 'example.net' OR h LIKE '%.example.net' OR h = 'example.org' OR h LIKE '%.example.org'"""


@plan
def crawl_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rule of each host: its own, or that of its nearest parent domain."""
    own = _hosts(spark, sf_dir).distinct().filter(F.length("host") % 3 == 0).select(crawl.plain_host(F.col("host")).alias("rule_host")).distinct().withColumn("rule", F.lit("own"))
    rules = own.unionByName(spark.createDataFrame([("example.com", "com"), ("com", "top"), ("org", "org")], "rule_host string, rule string"))
    return crawl.by_suffix(_hosts(spark, sf_dir), rules).select("host", "rule_host", "rule")


SQL["crawl_host_rules"] = f"""WITH h AS (SELECT DISTINCT {_HOST} AS host, regexp_replace({_HOST}, '^(www\\.)+', '') AS h FROM pages),
r AS (SELECT DISTINCT h AS rule_host, 'own' AS rule FROM h WHERE length(host) % 3 = 0 UNION ALL VALUES ('example.com', 'com'), ('com', 'top'), ('org', 'org'))
SELECT host, rule_host, rule FROM h JOIN r ON h = rule_host OR h LIKE '%.' || rule_host QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(rule_host) DESC) = 1"""


@plan
def crawl_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps that are due, and which of their entries go to the frontier."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), (F.col("c_nationkey")).alias("sitemap"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") * 10).alias("lastmod"))
    maps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sitemap"), F.when(F.col("n_nationkey") % 5 > 0, F.lit(NOW) - F.col("n_nationkey") * 1800).alias("polled_at"))
    visits = c.filter("url % 3 > 0").select("url", F.lit(500).alias("visited_at"))
    return crawl.poll_sitemaps(maps, c, visits, NOW).select("url", "verdict")


SQL["crawl_poll"] = """SELECT DISTINCT c_custkey AS url, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'unknown' ELSE 'changed' END AS verdict
FROM customer WHERE (c_nationkey % 5 = 0 OR c_nationkey * 1800 >= 21600) AND (c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR c_custkey * 10 > 500)"""


@plan
def crawl_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round: claims, listed hosts left out, replies with links of which the unseen go to the frontier."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("host"))
    frontier = p.filter("page_id % 2 = 0").select("url", "host", F.col("page_id").alias("priority"), F.lit(0).cast("long").alias("due_at"))
    hosts = p.select("host").distinct().withColumns({"due_at": F.lit(0).cast("long"), "delay_s": F.lit(2)})
    status = F.when(F.col("page_id") % 4 == 0, 200).when(F.col("page_id") % 8 == 2, 304)
    links = F.array(F.concat(F.lit("http://new.example/"), F.col("page_id")), F.col("url"), F.lit("http://seen.example/"))
    fetched = p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("url", status.alias("status"), F.lit("h").alias("content_hash"), links.alias("links")).filter("status is not null")
    lists = spark.createDataFrame([("global", "example.net")], "tier string, host string")
    step = crawl.crawl_step(frontier, hosts, fetched, lists, spark.createDataFrame([("http://seen.example/",)], "url string"), NOW, 1_000_000)
    return step["outcomes"].select("url", "reason").unionByName(step["found"].select("url", F.lit("found").alias("reason"))).unionByName(step["emitted"].select("url", F.lit("emitted").alias("reason")))


SQL["crawl_round"] = f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages), b AS (SELECT url, host FROM p WHERE page_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id, url) = 1),
c AS (SELECT * FROM b WHERE NOT (host = 'example.net' OR host LIKE '%.example.net')), f AS (SELECT url, min(page_id) AS page_id FROM p GROUP BY url),
r AS (SELECT url, page_id, CASE WHEN page_id % 4 = 0 THEN 'fetched' WHEN page_id % 8 = 2 THEN 'not_modified' ELSE 'error_unreachable' END AS reason FROM c JOIN f USING (url))
SELECT url, reason FROM r UNION ALL SELECT 'http://new.example/' || page_id, 'found' FROM r WHERE reason = 'fetched' UNION ALL SELECT url, 'emitted' FROM r WHERE reason = 'fetched'"""


@plan
def crawl_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose lease ran out, deferred URLs that are due again, robots files that are stale, and what waits."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(NOW - 500) + F.col("page_id")).alias("lease_until"), (F.lit(NOW - 100) + F.col("page_id")).alias("due_at"), (F.lit(NOW - 87_000) + F.col("page_id")).alias("fetched_at"))
    expired, due, stale = crawl.expired(p, NOW), crawl.due_again(p, NOW, 60), registry.stale(p, NOW)
    one = lambda frame, name: frame.select("page_id", F.lit(name).alias("list"))
    waiting = registry.depth(p, expired, due).select(F.col("n").alias("page_id"), F.concat(F.lit("depth "), "queue").alias("list"))
    return one(expired, "expired").unionByName(one(due, "due")).unionByName(one(stale, "stale")).unionByName(waiting)


SQL["crawl_leases"] = """WITH e AS (SELECT page_id FROM pages WHERE page_id < 500), d AS (SELECT page_id FROM pages WHERE page_id <= 100 ORDER BY page_id, url LIMIT 60), s AS (SELECT page_id FROM pages WHERE page_id <= 600)
SELECT page_id, 'expired' AS list FROM e UNION ALL SELECT page_id, 'due' FROM d UNION ALL SELECT page_id, 'stale' FROM s UNION ALL SELECT count(*), 'depth waiting' FROM pages
UNION ALL SELECT count(*), 'depth in_flight' FROM e UNION ALL SELECT count(*), 'depth deferred' FROM d"""


@plan
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are added unless unsafe or known, and removed; trust follows from the tier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.concat(F.when(F.col("s_suppkey") % 5 == 0, "ftp").otherwise("https"), F.lit("://s"), F.col("s_suppkey"), F.lit(".example.org/")).alias("url"), F.element_at(F.lit(["a", "B", "x"]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("tier"))
    known = s.filter("cast(source_id as int) % 4 = 0 and url like 'https%'")
    added, refused = registry.add_sources(known, s)
    left = registry.with_trust(registry.remove_sources(added, s.filter("cast(source_id as int) % 9 = 0")))
    return left.select("source_id", F.lit("kept").alias("state"), "trust", "crawl_trust").unionByName(refused.select("source_id", F.col("reason").alias("state"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("int").alias("crawl_trust")))


SQL["source_registry"] = """SELECT CAST(s_suppkey AS VARCHAR) AS source_id, 'kept' AS state, CASE s_suppkey % 3 WHEN 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS trust, CASE s_suppkey % 3 WHEN 0 THEN 100 ELSE 60 END::INTEGER AS crawl_trust
FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 9 <> 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 5 = 0 THEN 'scheme' ELSE 'exists' END, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 4 = 0"""


@plan
def queue_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs put into the frontier, promoted before all others of their host."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("host"))
    frontier = p.groupBy("url").agg(F.min("host").alias("host"), F.min("page_id").alias("priority")).withColumn("due_at", F.lit(0).cast("long"))
    return registry.enqueue(frontier, spark.createDataFrame([("http://new.example.org/a/#x",), ("http://new.example.org/a?utm_source=y",), ("not a url",)], "url string"), promote=True, priority=-5).select("url", "host", "priority")


SQL["queue_front"] = f"SELECT url, {_HOST} AS host, min(page_id) AS priority FROM pages GROUP BY ALL UNION ALL SELECT 'http://new.example.org/a', 'new.example.org', -5"


@plan
def dataset_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.unix_timestamp(F.max("o_orderdate").cast("timestamp")).alias("updated_at"))
    return registry.oldest(o, NOW)


SQL["dataset_age"] = f"SELECT count(*) AS n, CAST({NOW} - min(u) AS BIGINT) AS oldest_s FROM (SELECT epoch(CAST(max(o_orderdate) AS TIMESTAMP)) AS u FROM orders GROUP BY o_orderpriority)"


# --- search


@plan
def search_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms without stop words; a query of stop words alone keeps them."""
    return search.without_stop_words(search.query_terms(asked(spark, sf_dir)), ["the", "of", "and", "de", "la"]).select("query_id", "term")


SQL["search_stop_words"] = f"""WITH {ASKED}, q AS (SELECT DISTINCT query_id, unnest({TERMS.format('query')}) AS term FROM asked), m AS (SELECT *, term IN ('the', 'of', 'and', 'de', 'la') AS stop FROM q),
o AS (SELECT query_id, bool_and(stop) AS only_stop FROM m GROUP BY query_id) SELECT query_id, term FROM m JOIN o USING (query_id) WHERE NOT stop OR only_stop"""


@plan
def search_vocabulary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of titles and bodies, against which misspelt words are held."""
    return search.vocabulary(search.postings(crawled(spark, sf_dir)))


SQL["search_vocabulary_fields"] = f"""WITH {CRAWLED}, t AS (SELECT doc_id, unnest({TERMS.format('title')}) AS term FROM crawled UNION ALL SELECT doc_id, unnest({TERMS.format('body')}) FROM crawled)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM t GROUP BY term"""


@plan
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by cosine of every fiftieth vector, among all."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest(queries, e, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


SQL["vector_nearest"] = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS similarity FROM p QUALIFY rank <= 10"""
