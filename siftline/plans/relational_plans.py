"""Plans over the general tables: joins, aggregations, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.dates import hijri
from siftline.operators import relational
from siftline.plans.base import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_DEC = "decimal(18,4)"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("revenue", (F.col("l_extendedprice").cast(_DEC) * (1 - F.col("l_discount").cast(_DEC))))


_REV = "CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))"


def _money(c, name: str):
    return F.round(F.sum(c).cast("double"), 2).alias(name)


@plan
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _money(F.col("revenue"), "revenue"), F.count("*").alias("n"))


SQL["rel_pricing_summary"] = f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(CAST(sum({_REV}) AS DOUBLE), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"


@plan
def rel_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = _lineitem(spark, sf_dir).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(_money(F.col("revenue"), "revenue"))


SQL["rel_region_revenue"] = f"SELECT r_name, n_name, round(CAST(sum({_REV}) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


@plan
def rel_outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select("o_custkey", "o_orderkey")
    j = a.join(b, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return j.agg(F.count("*").alias("n"), F.count("c_custkey").alias("left_rows"), F.count("o_orderkey").alias("right_rows"))


SQL["rel_outer_joins"] = "SELECT count(*) AS n, count(c_custkey) AS left_rows, count(o_orderkey) AS right_rows FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey"


@plan
def rel_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    semi = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_mktsegment", F.lit("with").alias("orders"))
    anti = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_mktsegment", F.lit("without").alias("orders"))
    return semi.unionByName(anti).groupBy("c_mktsegment", "orders").agg(F.count("*").alias("n"))


SQL["rel_semi_anti"] = "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS orders, count(*) AS n FROM customer GROUP BY ALL"


@plan
def rel_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return relational.asof_join(buys, views, "user_id", "ts", "view_id").select("event_id", F.coalesce("view_id", F.lit(-1).cast("long")).alias("view_id"))


SQL["rel_asof"] = """
SELECT b.event_id, coalesce(v.view_id, -1) AS view_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') b
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON b.user_id = v.user_id AND b.ts >= v.ts"""


@plan
def rel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", (900 + F.col("s_suppkey") * 10.0).alias("low"), (930 + F.col("s_suppkey") * 10.0).alias("high"))
    return relational.range_join(parts, ranges, "p_retailprice", "low", "high", 25.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


SQL["rel_range"] = "SELECT s_suppkey, count(*) AS n FROM part JOIN (SELECT s_suppkey, 900 + s_suppkey * 10.0 AS low, 930 + s_suppkey * 10.0 AS high FROM supplier WHERE s_suppkey <= 50) ON p_retailprice >= low AND p_retailprice < high GROUP BY s_suppkey"


@plan
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.grouping_id().cast("long").alias("gid"))


SQL["rel_cube"] = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


@plan
def rel_rollup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("siftline_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM siftline_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


SQL["rel_rollup_sets"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@plan
def rel_distinct_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.stddev_samp("o_totalprice"), 2).alias("deviation"))


SQL["rel_distinct_percentiles"] = "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 2) AS deviation FROM orders GROUP BY 1"


@plan
def rel_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.9).alias("p90"))


@plan
def rel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    r = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("drk"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lag("s_suppkey", 1, -1).over(w).alias("before"), F.lead("s_suppkey", 1, -1).over(w).alias("after"), F.round(F.avg("s_acctbal").over(r), 4).alias("moving"), F.round(F.percent_rank().over(w), 6).alias("pr"))


SQL["rel_windows"] = """
SELECT s_suppkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER w AS quarter, lag(s_suppkey, 1, -1) OVER w AS before, lead(s_suppkey, 1, -1) OVER w AS after,
       round(avg(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS 2 PRECEDING), 4) AS moving, round(percent_rank() OVER w, 6) AS pr
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)"""


@plan
def rel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


SQL["rel_top_k"] = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3"


@plan
def rel_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice").limit(100)


SQL["rel_sort_limit"] = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100"


@plan
def rel_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"intersect": c.intersect(s), "intersect_all": c.intersectAll(s), "except": c.filter("k < 20").subtract(s.filter("k < 10")), "except_all": c.exceptAll(s), "union": c.union(s).distinct()}
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("op", "n", "total")


SQL["rel_set_operations"] = """
WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'intersect' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
UNION ALL SELECT 'intersect_all', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c INTERSECT ALL SELECT k FROM s)
UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c WHERE k < 20 EXCEPT SELECT k FROM s WHERE k < 10)
UNION ALL SELECT 'except_all', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)
UNION ALL SELECT 'union', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c UNION SELECT k FROM s)"""


@plan
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


SQL["rel_pivot"] = "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id"


@plan
def rel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("n"))


SQL["rel_json"] = "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(k) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"


@plan
def rel_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parents, replies = c.filter("turn = 0").select("conv_id", F.col("role").alias("opened_by")), c.filter("turn > 0").select("conv_id", "role")
    return parents.join(replies, "conv_id").groupBy("opened_by", "role").agg(F.count("*").alias("n"))


SQL["rel_comments"] = "SELECT p.role AS opened_by, r.role, count(*) AS n FROM conversations p JOIN conversations r ON p.conv_id = r.conv_id AND p.turn = 0 AND r.turn > 0 GROUP BY ALL"


@plan
def date_hijri(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select(F.col("day").cast("string").alias("day"), hijri(F.col("day")).alias("h")).select("day", F.col("h.year").cast("long").alias("h_year"), F.col("h.month").cast("long").alias("h_month"), F.col("h.day").cast("long").alias("h_day"))


SQL["date_hijri"] = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, date_diff('day', DATE '1970-01-01', day) + 492148 AS n FROM d),
y AS (SELECT *, CAST(floor((30 * n + 10646) / 10631.0) AS BIGINT) AS y FROM n), f AS (SELECT *, (y - 1) * 354 + CAST(floor((3 + 11 * y) / 30.0) AS BIGINT) AS f FROM y),
m AS (SELECT *, least(12, CAST(ceil((n - (f + 29)) / 29.5) AS BIGINT) + 1) AS m FROM f)
SELECT CAST(day AS VARCHAR) AS day, y AS h_year, m AS h_month, n - (CAST(ceil(29.5 * (m - 1)) AS BIGINT) + f) + 1 AS h_day FROM m"""
