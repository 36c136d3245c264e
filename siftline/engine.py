"""One object for the common ways to use the engine. Everything is lazy and takes and gives DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import dedup, evaluate, rank, search, suggest
from siftline.operators.sizes import small
from siftline.sources.html import outlinks, parse_pages


@dataclass
class Engine:
    """docs: doc_id, title, body, url, domain, source_id, language, published_at, precision, quality_score, spam_score and perhaps simhash."""

    spark: SparkSession
    docs: DataFrame
    trust: DataFrame
    now: int
    weights: rank.Weights = field(default_factory=rank.Weights)

    def index(self, fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
        return search.postings(self.docs, fields)

    def search(self, queries: DataFrame | str, filters: search.Filters | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
        """A page of results for each of (query_id, query), or for one query in full syntax."""
        docs = self.docs
        if isinstance(queries, str):
            search.Params(queries, page, per_page)
            parsed = search.parse_query(queries)
            docs = docs.filter(F.col("domain") == parsed.site) if parsed.site else docs
            docs = search.excluding(docs, list(parsed.excluded))
            for phrase in parsed.phrases:
                asked = self.spark.createDataFrame([(0, phrase)], "query_id long, phrase string")
                docs = docs.join(search.phrase_matches(asked, search.postings(docs)).select("doc_id"), "doc_id", "left_semi")
            queries = self.spark.createDataFrame([(0, " ".join([*parsed.terms, *parsed.phrases]))], "query_id long, query string")
        if filters:
            docs = docs.withColumn("published_at_precision", F.col("precision")).filter(filters.predicate()).drop("published_at_precision")
        index = search.postings(docs)
        hits = search.retrieve(search.with_typos(search.query_terms(queries), search.vocabulary(index)), index, docs)
        hits = hits.select("query_id", "doc_id", "pos").join(docs.drop("body"), "doc_id").join(small(queries), "query_id")
        return search.page_of(rank.rerank(hits, self.trust, self.now, self.weights), page, per_page)

    def facets(self, columns: list[str]) -> DataFrame:
        return search.facets(self.docs, columns)

    def suggest(self, prefixes: DataFrame, curated: DataFrame) -> DataFrame:
        return suggest.merge(suggest.by_prefix(suggest.build(curated, self.docs.select("title")), prefixes).drop("rank"))

    def evaluate(self, golden: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        ranked = self.search(queries, per_page=50)
        return evaluate.measures(ranked.select("query_id", "doc_id", F.col("rank").alias("pos")), golden, k)

    def ingest(self, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, links and refused pages of (page_id, url, html)."""
        parsed = parse_pages(pages, self.now)
        good = parsed.filter("error is null").withColumns({"content_hash": text.content_hash(F.col("body")), "simhash": text.simhash(text.normalize(F.col("body")))})
        return good, outlinks(parsed), parsed.filter("error is not null").select("page_id", "url", "error")

    def dedup(self, batch: DataFrame, seen: DataFrame) -> DataFrame:
        return dedup.new_only(batch, seen)
