from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from siftline import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(frame):
    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_plan_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted({*catalog.queries()} - {*catalog.oracle_sql()}))
def test_plan_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_sitemaps_of_large_hosts(spark, tmp_path):
    """More URLs of a host than one sitemap may hold, and copies of URLs whose first page is not the first row."""
    from pyspark.sql import functions as F

    k = F.col("id")
    url = F.concat(F.lit("https://a.example/x?k=1&n="), F.when(k % 10 == 0, F.lit(0)).otherwise(k))
    pages = spark.range(60_000).select(k.alias("page_id"), url.alias("url")).unionByName(spark.createDataFrame([(60_001, "http://b.example/<1>")], "page_id long, url string"))
    pages.orderBy(F.desc("page_id")).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = catalog.queries()["read_sitemaps"](spark, str(tmp_path)).toPandas(), duck.execute(catalog.oracle_sql()["read_sitemaps"]).df()
    assert len(got) == len(want) == 54_002 and "http://b.example/<1>" in set(got.url)
    assert plain(got[got.host == "a.example"]) == plain(want[want.host == "a.example"])


def test_typos_as_all_pairs(spark):
    from pyspark.sql import functions as F

    from siftline.plans import base

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    from siftline.operators import search

    terms = {tuple(r) for r in search.query_terms(base.asked(spark, DATA)).select("query_id", "term").collect()}
    words = {r[0] for r in search.postings(base.crawled(spark, DATA), ("title",)).select(F.col("term")).distinct().collect()}
    want = {(q, t, w, d) for q, t in terms for w in words if t[0] == w[0] and (d := distance(t, w)) <= (2 if len(t) >= 9 else 1 if len(t) >= 4 else 0)}
    assert {tuple(r) for r in catalog.queries()["search_typos"](spark, DATA).collect()} == want


def test_ranges_of_all_suppliers(spark, tmp_path):
    spark.createDataFrame([(1, 915.0), (2, 1425.0), (3, 10900.0)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (51,), (1000,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {tuple(r) for r in catalog.queries()["rel_range"](spark, str(tmp_path)).collect()} == {(1, 1), (51, 1), (1000, 1)}
