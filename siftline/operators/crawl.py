"""Crawl state as folds over ordered histories and as tables: revisits, politeness, frontier, limits, counters."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.urls import host_of, suffixes

HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Bounds:
    """Shortest and longest revisit interval by crawl trust."""

    high: tuple[int, int] = (HOUR, 3 * DAY)
    middle: tuple[int, int] = (2 * HOUR, 14 * DAY)
    low: tuple[int, int] = (6 * HOUR, 30 * DAY)

    def of(self, trust: int) -> tuple[int, int]:
        return self.high if trust >= 80 else self.middle if trust >= 50 else self.low

    def column(self, trust: Column, k: int) -> Column:
        return F.when(trust >= 80, self.high[k]).when(trust >= 50, self.middle[k]).otherwise(self.low[k]).cast("long")


def revisit(visits: DataFrame, bounds: Bounds = Bounds(), start: int = DAY) -> DataFrame:
    """(url, interval_s, streak, volatile) from (url, trust, ts, changed): a change halves the interval, none adds the floor, both within the
    trust's bounds; four changes in a row at the floor make a page volatile, which parks it at the ceiling. A page's history is one
    array, folded in order."""
    rows = visits.groupBy("url").agg(F.max("trust").alias("trust"), F.array_sort(F.collect_list(F.struct("ts", "changed"))).alias("h"))
    rows = rows.withColumns({"floor": bounds.column(F.col("trust"), 0), "ceiling": bounds.column(F.col("trust"), 1)})
    first = F.struct(F.least(F.greatest(F.lit(start).cast("long"), F.col("floor")), F.col("ceiling")).alias("interval"), F.lit(0).alias("streak"), F.lit(False).alias("volatile"))

    def step(a: Column, v: Column) -> Column:
        at_floor = a["interval"] <= F.col("floor")
        streak = F.when(v["changed"] & at_floor, a["streak"] + 1).otherwise(0)
        volatile = a["volatile"] | (streak >= 4)
        moved = F.when(v["changed"], F.floor(a["interval"] / 2)).otherwise(a["interval"] + F.col("floor"))
        interval = F.when(volatile, F.col("ceiling")).otherwise(F.least(F.greatest(moved, F.col("floor")), F.col("ceiling")))
        return F.struct(interval.cast("long").alias("interval"), streak.cast("int").alias("streak"), volatile.alias("volatile"))

    state = rows.withColumn("s", F.aggregate("h", first, step))
    return state.select("url", F.col("s.interval").alias("interval_s"), "s.streak", "s.volatile", F.size("h").alias("visits"))


def politeness(replies: DataFrame, robots_delay: float = 1.5) -> DataFrame:
    """(host, delay_s) from (host, ts, status, retry_after): 429 waits the longer of retry_after (or four times the delay) and a minute, at most
    ten; 5xx doubles, at most five minutes; success and redirects shrink by a tenth, down to the robots delay."""
    rows = replies.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("ts", "status", "retry_after"))).alias("h"))

    def step(a: Column, r: Column) -> Column:
        limited = F.least(F.greatest(F.coalesce(r["retry_after"].cast("double"), a * 4), F.lit(60.0)), F.lit(600.0))
        return F.when(r["status"] == 429, limited).when(r["status"] >= 500, F.least(a * 2, F.lit(300.0))).when(r["status"].between(200, 399), F.greatest(a * 0.9, F.lit(robots_delay))).otherwise(a)

    return rows.select("host", F.aggregate("h", F.lit(robots_delay), step).alias("delay_s"), F.size("h").alias("replies"))


def observations(fetches: DataFrame) -> DataFrame:
    """(url, ts, changed) from (url, ts, status, content_hash): a 304 keeps the hash before it."""
    order = Window.partitionBy("url").orderBy("ts")
    kept = F.last(F.when(F.col("status") != 304, F.col("content_hash")), ignorenulls=True)
    rows = fetches.withColumn("hash", kept.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("was", F.lag("hash").over(order)).select("url", "ts", F.coalesce(F.col("hash") != F.col("was"), F.lit(False)).alias("changed"))


def sitemap_verdicts(entries: DataFrame, visits: DataFrame) -> DataFrame:
    """changed, unchanged or unknown for each entry (url, lastmod) by the last visit (url, visited_at)."""
    joined = entries.join(visits.groupBy("url").agg(F.max("visited_at").alias("visited_at")), "url", "left")
    return joined.withColumn("verdict", F.when(F.col("lastmod").isNull() | F.col("visited_at").isNull(), "unknown").when(F.col("lastmod") > F.col("visited_at"), "changed").otherwise("unchanged"))


def add_to_frontier(frontier: DataFrame, found: DataFrame, seen: DataFrame, cap: int = 10_000) -> DataFrame:
    """New URLs (url, host, priority, due_at) that were not seen, as many for each host as its queue has room for. Hosts are counted first; only the
    rows that are let in are ranked, by a limit that Spark pushes below the exchange."""
    fresh = found.groupBy("url").agg(F.min("host").alias("host"), F.min("priority").alias("priority"), F.min("due_at").alias("due_at")).join(seen, "url", "left_anti")
    waiting = frontier.groupBy("host").agg(F.count("*").alias("waiting"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("priority", "url"))
    ranked = fresh.withColumn("turn", turn).filter(F.col("turn") <= cap).join(waiting, "host", "left")
    return ranked.filter(F.col("turn") + F.coalesce("waiting", F.lit(0)) <= cap).select("url", "host", "priority", "due_at")


def claim(frontier: DataFrame, hosts: DataFrame, now: int, most: int, lease_s: int = 120) -> DataFrame:
    """One URL of each due host (host, due_at, delay_s), the most overdue hosts first: that of the lowest priority. A struct's minimum makes it a
    partial aggregate."""
    due = hosts.filter(F.col("due_at") <= now)
    best = frontier.groupBy("host").agg(F.min(F.struct("priority", "url")).alias("x"))
    picked = due.join(best, "host").orderBy("due_at", "host").limit(most)
    return picked.select("host", "x.url", "x.priority", F.lit(now + lease_s).alias("lease_until"), (F.lit(now) + F.col("delay_s")).alias("next_due"))


def expired(claims: DataFrame, now: int) -> DataFrame:
    """Claims whose lease ran out; they go back to the frontier."""
    return claims.filter(F.col("lease_until") < now)


def due_again(deferred: DataFrame, now: int, most: int = 500) -> DataFrame:
    return deferred.filter(F.col("due_at") <= now).orderBy("due_at", "url").limit(most)


def rate_limited(requests: DataFrame, limit: int, window_s: int = 60) -> DataFrame:
    """(client, ts, request_id, allowed): a window opens at a client's first request after the last one closed, and lets `limit` in. Each
    client's windows follow from its own times, so a client is one array, folded in order."""
    rows = requests.groupBy("client").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), "request_id"))).alias("h"))
    @F.pandas_udf("array<boolean>")
    def verdicts(histories: pd.Series) -> pd.Series:
        out = []
        for times in histories:
            opened, n, row = float("-inf"), 0, []
            for t in times:
                if t >= opened + window_s:
                    opened, n = t, 0
                n += 1
                row.append(n <= limit)
            out.append(row)
        return pd.Series(out)

    judged = rows.select("client", "h", verdicts(F.col("h.ts")).alias("ok"))
    return judged.select("client", F.explode(F.arrays_zip("h.ts", "h.request_id", "ok")).alias("x")).select("client", F.col("x.ts").alias("ts"), F.col("x.request_id").alias("request_id"), F.col("x.ok").alias("allowed"))


#: Lists of hosts that are never fetched, those that are hardest to lift first.
TIERS = ("global", "takedown", "host_opt_out")


def plain_host(c: Column) -> Column:
    """A host as lists name it: lower case, no www. and no full stop at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""), r"^(?:www\.)+", "")


def by_suffix(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rule columns) of the rule (rule_host, ...) for the host itself or its nearest parent domain. Hosts are exploded to their few
    suffixes, and the two are joined on equal names."""
    one = hosts.select("host").distinct().select("host", F.posexplode(suffixes(plain_host(F.col("host")))).alias("level", "rule_host"))
    best = one.join(rules, "rule_host").groupBy("host").agg(F.min(F.struct("level", *[c for c in rules.columns])).alias("x"))
    return best.select("host", *[F.col(f"x.{c}") for c in rules.columns])


def blocked(hosts: DataFrame, lists: DataFrame) -> DataFrame:
    """(host, tier) of hosts that a list (tier, host) names, or a parent domain of which it does; of several tiers the hardest to lift."""
    rank = F.array_position(F.lit(list(TIERS)), F.col("tier"))
    named = lists.select(plain_host(F.col("host")).alias("rule_host"), rank.alias("rank")).filter("rank > 0").groupBy("rule_host").agg(F.min("rank").alias("rank"))
    one = hosts.select("host").distinct().select("host", F.explode(suffixes(plain_host(F.col("host")))).alias("rule_host"))
    found = one.join(named, "rule_host").groupBy("host").agg(F.min("rank").alias("rank"))
    return found.select("host", F.element_at(F.lit(list(TIERS)), F.col("rank").cast("int")).alias("tier"))


def paused(backlog: Column, most: int = 5000) -> Column:
    """Whether producers wait, as too many rows stand before the consumers."""
    return backlog >= most


def poll_sitemaps(sitemaps: DataFrame, entries: DataFrame, visits: DataFrame, now: int, every: int = 6 * HOUR) -> DataFrame:
    """URLs to be put into the frontier from sitemaps (sitemap, polled_at) that are due: entries (sitemap, url, lastmod) that changed since
    their last visit, or that nothing is known of."""
    due = sitemaps.filter(F.col("polled_at").isNull() | (F.col("polled_at") <= now - every)).select("sitemap")
    return sitemap_verdicts(entries.join(due, "sitemap", "left_semi"), visits).filter("verdict <> 'unchanged'").select("url", "verdict").distinct()


def crawl_step(frontier: DataFrame, hosts: DataFrame, fetched: DataFrame, lists: DataFrame, seen: DataFrame, now: int, most: int, cap: int = 10_000) -> dict[str, DataFrame]:
    """One round over tables: URLs are claimed, those of listed hosts dropped, replies (url, status, content_hash, links) joined, and their new
    links put into the frontier. Gives the claims, the outcomes, the documents to emit and the frontier's new rows."""
    claims = claim(frontier, hosts, now, most)
    shut = blocked(claims, lists).withColumnRenamed("host", "_host")
    open_claims = claims.join(shut, claims["host"] == F.col("_host"), "left_anti")
    replies = open_claims.join(fetched, "url", "left")
    outcomes = replies.select("url", "host", outcome(F.col("status"), F.when(F.col("status").isNull(), F.lit("unreachable"))).alias("reason"), "next_due")
    emitted = replies.filter(F.col("status").between(200, 299)).select("url", "host", "content_hash")
    links = replies.filter(F.col("status").between(200, 299)).select(F.explode("links").alias("url"), (F.col("priority") + 1000).alias("priority"))
    found = links.select("url", host_of(F.col("url")).alias("host"), "priority", F.lit(now).cast("long").alias("due_at")).filter("host <> ''")
    return {"claims": claims, "outcomes": outcomes, "emitted": emitted, "found": add_to_frontier(frontier, found, seen.select("url").unionByName(frontier.select("url")).distinct(), cap)}


def outcome(status: Column, error: Column) -> Column:
    """The label under which a fetch is counted."""
    return F.when(error.isNotNull(), F.concat(F.lit("error_"), error)).when(status == 304, "not_modified").when(status.between(200, 299), "fetched").when(status.between(300, 399), "redirected").when(status == 429, "rate_limited").when(status >= 500, "server_error").otherwise("refused")


def counters(log: DataFrame, recent: int = 50) -> dict[str, DataFrame]:
    """Counts by reason, the last entries, the last time of each host."""
    return {"reasons": log.groupBy("reason").agg(F.count("*").alias("n")), "recent": log.orderBy(F.desc("at"), F.desc("url")).limit(recent), "hosts": log.groupBy("host").agg(F.max("at").alias("last_seen"))}


def stages_left(budget_ms: float, spent_ms: float) -> list[str]:
    """Which optional stages a request still has time for."""
    left = 1 - spent_ms / budget_ms
    return [name for name, least in (("expansion", 0.55), ("facets", 0.35), ("rerank", 0.20), ("summary", 0.08)) if left >= least]


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts below each bound."""
    sums = [F.sum((F.col(column) <= b).cast("long")).alias(f"le_{b:g}") for b in bounds]
    return values.agg(*sums, F.count(column).alias("count"), F.sum(column).alias("sum"))
