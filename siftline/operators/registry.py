"""The source registry, the queue's front, counts, spelling differences, and generators of test corpora and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import normalize
from siftline.functions.urls import canonical, host_of, unsafe
from siftline.schema import CRAWL_TRUST, TRUST


def with_trust(sources: DataFrame) -> DataFrame:
    """Trust for ranking and for crawling by tier; unknown tiers count as B."""
    tier = F.coalesce(F.upper("tier"), F.lit("B"))

    def of(table: dict[str, float]) -> Column:
        out = F.lit(table["B"])
        for name, value in table.items():
            out = F.when(tier == name, value).otherwise(out)
        return out

    return sources.withColumns({"trust": of(TRUST).cast("double"), "crawl_trust": of(CRAWL_TRUST).cast("int")})


def add_sources(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with new sources (source_id, url, tier), and the refused ones with a reason: an unsafe URL, or one that is there."""
    known = registry.select(F.col("source_id").alias("known_id"))
    judged = new.join(known, F.col("source_id") == F.col("known_id"), "left").withColumn("reason", F.coalesce(unsafe(F.col("url")), F.when(F.col("known_id").isNotNull(), "exists"))).drop("known_id")
    return registry.unionByName(judged.filter("reason is null").drop("reason")), judged.filter("reason is not null")


def remove_sources(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("source_id"), "source_id", "left_anti")


def enqueue(frontier: DataFrame, urls: DataFrame, promote: bool = False, priority: int = 0) -> DataFrame:
    """The frontier with URLs put in; promoted ones go before all others of their host."""
    rows = urls.select(canonical(F.col("url")).alias("url")).filter("url is not null").distinct().withColumn("host", host_of(F.col("url")))
    if promote:
        lowest = frontier.groupBy("host").agg(F.min("priority").alias("lowest"))
        rows = rows.join(lowest, "host", "left").withColumn("priority", F.least(F.coalesce("lowest", F.lit(0)) - 1, F.lit(priority)).cast("long")).drop("lowest")
    else:
        rows = rows.withColumn("priority", F.lit(priority).cast("long"))
    waiting = frontier.join(rows.select("url"), "url", "left_anti")
    return waiting.unionByName(rows.withColumn("due_at", F.lit(0).cast("long")).select("url", "host", "priority", "due_at"))


def depth(frontier: DataFrame, claims: DataFrame, deferred: DataFrame) -> DataFrame:
    """How many URLs wait, are claimed, and are deferred."""
    count = lambda frame, name: frame.agg(F.count("*").alias("n")).withColumn("queue", F.lit(name))
    return count(frontier, "waiting").unionByName(count(claims, "in_flight")).unionByName(count(deferred, "deferred"))


def normalisation_diff(texts: DataFrame, column: str) -> DataFrame:
    """(character, before, after) of those that normalising makes more or fewer of."""
    def chars(c: Column, name: str) -> DataFrame:
        return texts.select(F.explode(F.split(c, "")).alias("character")).filter("character <> ''").groupBy("character").agg(F.count("*").alias(name))

    both = chars(F.col(column), "before").join(chars(normalize(F.col(column)), "after"), "character", "full_outer").na.fill(0, ["before", "after"])
    return both.filter("before <> after")


def document_id(url: Column) -> Column:
    """A stable id: a function of the canonical URL, so that a page fetched again replaces itself."""
    return F.left(F.sha2(url, 256), F.lit(26))


def stale(cache: DataFrame, now: int, ttl_s: int = 86_400) -> DataFrame:
    """Entries of a cache, such as robots files, that must be fetched again."""
    return cache.filter(F.col("fetched_at") <= now - ttl_s)


def noisy(texts: DataFrame, column: str, seed: int = 1) -> DataFrame:
    """Texts with the noise of real ones, drawn by a hash of each word's place: stretched letters, diacritics, Arabic digits."""
    def word(w: Column, k: Column) -> Column:
        draw = F.pmod(F.xxhash64(w, k, F.lit(seed)), F.lit(100))
        stretched = F.concat(F.left(w, F.lit(2)), F.lit("ـ"), F.substr(w, F.lit(3)))
        return F.when((draw < 25) & (F.length(w) > 4), stretched).when(draw < 40, F.concat(F.left(w, F.lit(1)), F.lit("َ"), F.substr(w, F.lit(2)))).when(draw < 50, F.translate(w, "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(w)

    return texts.withColumn(column, F.array_join(F.transform(F.split(column, " "), word), " "))


def oldest(datasets: DataFrame, now: int) -> DataFrame:
    """How many data sets (name, updated_at) there are, and the age in seconds of the oldest."""
    return datasets.agg(F.count("*").alias("n"), (F.lit(now) - F.min("updated_at")).alias("oldest_s"))


def golden_queries(docs: DataFrame, per_language: int = 20, words: int = 3) -> DataFrame:
    """(id, query, lang) from titles, a quota for each language, by a hash of the id."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = docs.filter(F.length("title") > 0).withColumn("turn", turn).filter(F.col("turn") <= per_language)
    return chosen.select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("title", r"\s+"), 1, words), " ").alias("query"), F.col("language").alias("lang"))


def snapshot(spark: SparkSession, frame: DataFrame, name: str) -> None:
    """Replace a view that readers use by a new one, such as after an index was rebuilt."""
    frame.createOrReplaceTempView(name)
