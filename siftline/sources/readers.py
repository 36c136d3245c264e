"""Readers: corpora, lexicons, lists, rules, sitemaps, queues, raw pages."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow
from siftline.schema import DOCUMENT, JOB


def read_corpus(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Documents, one JSON object a line, or one array; a bad line stops the read."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").option("multiLine", array).json(path)


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("comment", "#").option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path, sep="\t")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "id string, url string, tier string, note string").filter("url is not null").withColumn("tier", F.coalesce(F.upper("tier"), F.lit("B")))


def read_lexicon(spark: SparkSession, path: str, strong: float = 1.0, weak: float = 0.5) -> DataFrame:
    """(term, weight); terms of more than two words are left out."""
    rows = _tsv(spark, path, "term string, grade string, gloss string")
    weight = F.when(F.col("grade") == "strong", strong).when(F.col("grade") == "weak", weak).otherwise(F.expr("try_cast(grade as double)"))
    return rows.select(F.lower("term").alias("term"), weight.alias("weight")).filter(F.col("weight").isNotNull() & (F.size(F.split("term", " +")) <= 2))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(id, variants, weight); concepts of one variant are left out."""
    rows = _tsv(spark, path, "id string, variants string, weight string, note string")
    variants = F.filter(F.transform(F.split("variants", r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return rows.select("id", variants.alias("variants"), F.coalesce(F.expr("try_cast(weight as double)"), F.lit(0.85)).alias("weight")).filter(F.size("variants") >= 2)


def read_valence(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "term string, valence double, gloss string").select(F.lower("term").alias("term"), "valence").filter("valence is not null")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("phrase")).filter("phrase <> '' and not startswith(phrase, '#')")


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "term string, lang string, weight double").filter("term is not null")


def read_rules(text: str) -> list[dict]:
    """Per-domain extraction rules of a TOML text; one host twice is an error, a malformed text gives no rules."""
    try:
        rules = tomllib.loads(text).get("domain", [])
    except tomllib.TOMLDecodeError:
        return []
    hosts = [r["host"] for r in rules]
    if len(set(hosts)) < len(hosts):
        raise ValueError("a host has two rules")
    return rules


def read_golden(spark: SparkSession, path: str) -> tuple[int | None, DataFrame]:
    """The corpus size of the header and the judged queries."""
    rows = spark.read.schema("_meta struct<corpus_size:long>, id string, query string, lang string, note string, judged_by string, judgements map<string,int>").json(path)
    header = rows.filter("_meta is not null").select("_meta.corpus_size").first()
    return header[0] if header else None, rows.filter("_meta is null").drop("_meta")


def sitemap_entries(text: str | None, most: int = 50_000) -> list[tuple[str, str | None]]:
    """(url, lastmod) of a sitemap, sitemap index, RSS or Atom text; of a malformed one what stands before the fault."""
    parser, out, seen, last = ET.XMLPullParser(("start", "end")), [], set(), None
    loc: str | None = None

    def say(url: str | None, when: str | None) -> None:
        url = (url or "").strip()
        if url.startswith(("http://", "https://")) and url not in seen and len(out) < most:
            seen.add(url)
            out.append((url, when))

    try:
        parser.feed(text or "")
        for event, node in parser.read_events():
            name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
            if event == "start":
                continue
            if name == "loc":
                loc = node.text
            elif name in ("lastmod", "pubDate", "updated"):
                last = (node.text or "").strip() or None
            elif name in ("url", "sitemap"):
                say(loc, last)
                loc = last = None
            elif name in ("link", "guid"):
                say(node.get("href") or node.text, None)
        if loc:
            say(loc, last)
    except ET.ParseError:
        for m in re.finditer(r"<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>|<link[^>]*href=\"([^\"]+)\"", text or "", re.S):
            say(m[1] or m[2], None)
    return out


@arrow("array<struct<url:string,lastmod:string>>")
def sitemap(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [{"url": u, "lastmod": w} for u, w in sitemap_entries(t)])


def is_sitemap_index(c: Column) -> Column:
    return F.contains(c, F.lit("<sitemapindex"))


def decode_bytes(data: bytes | None, label: str | None) -> str | None:
    """By the header's label, else by the one in the first 2 KiB, else as UTF-8 or the Arabic and Latin Windows pages."""
    if data is None:
        return None
    inside = re.search(rb"charset=[\"']?([\w-]+)", data[:2048], re.I)
    for name in (label, inside[1].decode() if inside else None, "utf-8", "windows-1256" if re.search(rb"[\xc7\xe1]{2}|\xc7\xe1", data) else None, "windows-1252"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return data.decode("latin-1")


@arrow("string")
def decoded(data: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(d, c) for d, c in zip(data, label)])


def read_queue(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of index jobs from files of JSON lines; what can't be decoded keeps its text for the dead letters."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select("value", F.from_json("value", JOB, {"mode": "PERMISSIVE"}).alias("job"))


def fresh_pages(pages: DataFrame, now: Column, ttl_s: int, most_bytes: int = 5 << 20) -> DataFrame:
    """Raw pages that are neither too old nor too large, the newest of each URL."""
    live = pages.filter((F.unix_timestamp("fetched_at") > now - ttl_s) & (F.octet_length("body") <= most_bytes))
    newest = live.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    return live.join(newest, ["url", "fetched_at"], "left_semi")


def weather_forecast(c: Column) -> Column:
    """Daily rows of a forecast reply."""
    reply = F.from_json(c, "daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,weather_code:array<int>>")
    daily = reply["daily"]
    rows = F.arrays_zip(daily["time"], daily["temperature_2m_max"], daily["temperature_2m_min"], daily["weather_code"])
    return rows.cast("array<struct<day:string,high:double,low:double,code:int>>")


def parse_jobs(payload: Column) -> Column:
    return F.from_json(payload, JOB)


def dumps(value: object) -> str:
    """Canonical JSON, for comparing settings."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
