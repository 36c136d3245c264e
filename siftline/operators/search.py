"""Full-text search over DataFrames: query syntax, filters, an inverted index, ranking rules, facets, result cards.

Queries come in batches with a query_id, so one job serves them all. The terms of a batch are few and bounded by the batch, and are
joined to the postings where these are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.text import terms
from siftline.functions.urls import display_url
from siftline.operators.sizes import small

#: Searched fields in order of priority.
FIELDS = ("title", "excerpt", "entities", "body", "translit_body", "author_name")
POOL, MOST_HITS, MOST_PAGES, FACET_VALUES = 200, 2000, 100, 100
_QUOTES = {'"': '"', "“": "”", "«": "»"}


@dataclass(frozen=True)
class Parsed:
    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    site: str | None = None
    excluded: tuple[str, ...] = ()

    def engine_query(self) -> str:
        return " ".join([*self.terms, *(f'"{p}"' for p in self.phrases)])


def parse_query(raw: str) -> Parsed:
    """Quoted phrases, site:host (the last one wins, a URL will do), -term, and terms. A quote without an end is an ordinary
    character, and so are a lone - and site:."""
    words: list[str] = []
    phrases: list[str] = []
    excluded: list[str] = []
    site = None
    rest, at = "", 0
    while at < len(raw):
        close = _QUOTES.get(raw[at])
        end = raw.find(close, at + 1) if close else -1
        if end > 0:
            if raw[at + 1 : end].strip():
                phrases.append(" ".join(raw[at + 1 : end].split()))
            rest, at = rest + " ", end + 1
        else:
            rest, at = rest + raw[at], at + 1
    for word in rest.split():
        if word.lower().startswith("site:") and len(word) > 5:
            site = re.sub(r"^(https?://)?(www\.)?", "", word[5:].lower()).split("/")[0]
        elif word.startswith("-") and len(word) > 1:
            excluded.append(word[1:])
        else:
            words.append(word)
    return Parsed(tuple(words), tuple(phrases), site, tuple(excluded))


@dataclass(frozen=True)
class Filters:
    source_types: tuple[str, ...] = ()
    sentiments: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    published_from: int | None = None
    published_to: int | None = None
    domain: str | None = None
    spam_below: float | None = 0.8
    known_dates: bool = False

    def normalized(self) -> Filters:
        """A date bound leaves out unknown dates; reversed bounds are exchanged."""
        low, high = self.published_from, self.published_to
        if low is not None and high is not None and low > high:
            low, high = high, low
        return replace(self, published_from=low, published_to=high, known_dates=self.known_dates or low is not None or high is not None)

    def predicate(self) -> Column:
        """On stored columns only, so that Parquet scans take it."""
        f = self.normalized()
        parts = [F.col(c).isin(list(v)) for c, v in (("source_type", f.source_types), ("sentiment_label", f.sentiments), ("language", f.languages)) if v]
        parts += [F.col("published_at") >= f.published_from] if f.published_from is not None else []
        parts += [F.col("published_at") <= f.published_to] if f.published_to is not None else []
        parts += [F.col("domain") == f.domain] if f.domain else []
        parts += [F.col("spam_score") < f.spam_below] if f.spam_below is not None else []
        parts += [F.col("published_at_precision") != "unknown"] if f.known_dates else []
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


@dataclass(frozen=True)
class Params:
    q: str
    page: int = 1
    per_page: int = 20
    sort: str = "relevance"
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self) -> None:
        for ok, what in ((0 < len(self.q.strip()) and len(self.q) <= 512, "q"), (self.page >= 1, "page"), (1 <= self.per_page <= 50, "per_page"), (self.sort in ("relevance", "recency"), "sort")):
            if not ok:
                raise ValueError(f"invalid {what}")


def postings(docs: DataFrame, fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """(term, doc_id, field, pos): field is the priority, pos counts from 0."""
    every = F.array(*[F.struct(F.lit(FIELDS.index(f)).alias("field"), terms(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    rows = docs.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.field", F.posexplode("f.words").alias("pos", "term"))
    return rows.select("term", "doc_id", "field", "pos")


def vocabulary(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("places"))


def typos_allowed(length: Column) -> Column:
    return F.when(length >= 9, 2).when(length >= 4, 1).otherwise(0)


def with_typos(query_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, term, word, typos): words of the vocabulary within the edits that a term's length allows. Terms are joined by first letter
    and by length, so a term meets only words that could be near; a word whose first letter is mistyped isn't found."""
    asked = query_terms.withColumn("most", typos_allowed(F.length("term")))
    asked = asked.withColumn("size", F.explode(F.sequence(F.length("term") - F.col("most"), F.length("term") + F.col("most"))))
    words = vocabulary.select(F.col("term").alias("word"), F.length("term").alias("size"), F.left("term", F.lit(1)).alias("head"))
    near = asked.withColumn("head", F.left("term", F.lit(1))).join(words, ["head", "size"]).withColumn("typos", F.levenshtein("term", "word"))
    return near.filter("typos <= most").select("query_id", "term", "word", "typos")


def query_terms(queries: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, term, n_terms) of a batch of (query_id, query); `most` keeps so many different terms of each."""
    words = F.array_distinct(terms(F.col("query")))
    words = words if most is None else F.slice(words, 1, most)
    return queries.select("query_id", words.alias("words")).select("query_id", F.explode("words").alias("term"), F.size("words").alias("n_terms"))


def retrieve(asked: DataFrame, index: DataFrame, docs: DataFrame, pool: int = POOL) -> DataFrame:
    """The first `pool` documents of each query by ranking rules, one after the other: words matched, typos, proximity, field, exactness,
    date, quality, id. `asked` has (query_id, term, n_terms) and perhaps word and typos."""
    asked = asked if "word" in asked.columns else asked.withColumns({"word": F.col("term"), "typos": F.lit(0)})
    hits = index.join(small(asked), index["term"] == asked["word"]).select("query_id", asked["term"], "doc_id", "field", "pos", "typos")
    first = hits.groupBy("query_id", "doc_id", "term").agg(F.min("typos").alias("typos"), F.min("field").alias("field"), F.min("pos").alias("pos"))
    scored = first.groupBy("query_id", "doc_id").agg(F.count("*").alias("words"), F.sum("typos").alias("typos"), (F.max("pos") - F.min("pos")).alias("spread"), F.min("field").alias("attribute"), F.sum((F.col("typos") == 0).cast("int")).alias("exact"))
    keys = docs.select("doc_id", "published_at", "quality_score")
    order = Window.partitionBy("query_id").orderBy(F.desc("words"), "typos", "spread", "attribute", F.desc("exact"), F.desc_nulls_last("published_at"), F.desc_nulls_last("quality_score"), "doc_id")
    return scored.join(keys, "doc_id").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= pool)


def phrase_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id) where all words of the query's phrase (query_id, phrase) stand one after the other in one field: postings agree on
    the start."""
    words = phrases.select("query_id", F.posexplode(terms(F.col("phrase"))).alias("at", "term"), F.size(terms(F.col("phrase"))).alias("n"))
    starts = index.join(small(words), "term").withColumn("start", F.col("pos") - F.col("at"))
    return starts.groupBy("query_id", "doc_id", "field", "start", "n").agg(F.countDistinct("at").alias("k")).filter("k = n").select("query_id", "doc_id").distinct()


def excluding(docs: DataFrame, excluded: list[str]) -> DataFrame:
    """Without documents whose folded title and body contain a folded term."""
    from siftline.functions.language import folded
    from siftline.functions.text import fold

    if not excluded:
        return docs
    # Folded once, however many terms there are.
    whole = docs.withColumn("_whole", fold(F.concat_ws(" ", "title", "body")))
    return whole.filter(~reduce(or_, [F.contains("_whole", F.lit(folded(term))) for term in excluded])).drop("_whole")


def facets(hits: DataFrame, columns: list[str], most: int = FACET_VALUES) -> DataFrame:
    """(facet, value, n): the most frequent values of several columns, in one pass."""
    values = hits.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").filter("value is not null")
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return values.groupBy("facet", "value").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def merge_legs(primary: DataFrame, second: DataFrame, least: int = 5) -> DataFrame:
    """Hits (query_id, doc_id, pos) of both legs, those of the second for queries with fewer than `least`, after the first's and without
    its documents."""
    few = primary.groupBy("query_id").count().filter(F.col("count") >= least)
    extra = second.join(few, "query_id", "left_anti")
    both = primary.withColumn("leg", F.lit(0)).unionByName(extra.withColumn("leg", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("leg", "pos")).alias("x")).select("query_id", "doc_id", "x.leg", F.col("x.pos").alias("was"))
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("leg", "was", "doc_id"))).drop("was")


def page_of(ranked: DataFrame, page: int, per_page: int) -> DataFrame:
    """Ranks of one page of every query."""
    return ranked.filter(F.col("rank").between((page - 1) * per_page + 1, page * per_page))


def page_count(total: Column, per_page: int) -> Column:
    return F.least(F.ceil(total / per_page), F.lit(MOST_PAGES)).cast("int")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1000, "101-1000").otherwise("1000+")


def cards(hits: DataFrame) -> DataFrame:
    """What a result shows: breadcrumb, sentiment if it is sure enough, the first picture."""
    return hits.withColumns({"display_url": display_url(F.col("url")), "shown_sentiment": F.when(F.col("sentiment_confidence") >= 0.35, F.col("sentiment_label")), "thumb": F.get("media", F.lit(0))})


def by_recency(hits: DataFrame) -> DataFrame:
    """The hits of each query ranked by date, the newest first, then by their place in relevance."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("published_at"), "pos"))
    return hits.withColumn("rank", turn)


def without_stop_words(terms: DataFrame, stop: list[str]) -> DataFrame:
    """The terms (query_id, term) without stop words; a query of nothing else keeps them."""
    marked = terms.withColumn("_stop", F.col("term").isin(stop))
    only = marked.groupBy("query_id").agg(F.min("_stop").alias("_only"))
    return marked.join(only, "query_id").filter(~F.col("_stop") | F.col("_only")).drop("_stop", "_only")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k vectors of the largest cosine with each query's. The queries are a stated set: each
    task meets all of them, and only k rows a query and task go on."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    q = queries.select("query_id", unit(F.col("embedding")).alias("q")).withColumn("nq", norm(F.col("q")))
    v = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).withColumn("nv", norm(F.col("v")))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = v.join(q, F.lit(True)).withColumn("similarity", F.when((F.col("nq") > 0) & (F.col("nv") > 0), dot / (F.col("nq") * F.col("nv"))))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return pairs.select("query_id", "vec_id", "similarity").withColumn("rank", turn).filter(F.col("rank") <= k)


def listing(docs: DataFrame, domain: str | None, language: str | None, page: int, per_page: int) -> DataFrame:
    """An administrator's list, newest first."""
    rows = docs.filter(F.lit(True) if domain is None else F.col("domain") == domain).filter(F.lit(True) if language is None else F.col("language") == language)
    return rows.orderBy(F.desc("crawled_at"), "doc_id").offset((page - 1) * per_page).limit(per_page)


def synonyms(concepts: DataFrame) -> DataFrame:
    """(term, synonyms) in both directions, of (id, variants, weight)."""
    pairs = concepts.select("variants", F.explode("variants").alias("term")).select("term", F.explode("variants").alias("other")).filter("term <> other")
    return pairs.groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("synonyms"))


MOST_TERMS = 5_000


def asked_terms(asked: DataFrame) -> list[str] | None:
    """The different words of a batch of query terms, by which postings can be pruned; None if there are more than MOST_TERMS."""
    column = "word" if "word" in asked.columns else "term"
    rows = asked.select(column).distinct().limit(MOST_TERMS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= MOST_TERMS else None


def read_index(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings of a batch's terms: the filter is pushed to the files, which are ranges of terms."""
    found = spark.read.parquet(path)
    only = asked_terms(asked)
    return found.join(asked.select("term").distinct(), "term", "left_semi") if only is None else found.filter(F.col("term").isin(only))


def build_index(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Postings by range of term, so that a query's terms read few files."""
    postings(docs).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
