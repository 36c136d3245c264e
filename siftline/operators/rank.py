"""Second ranking of retrieved candidates: intent, freshness, trust, quality, spam; near-copies collapsed, domains capped."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.fixed import EVERGREEN_MARKERS, NEWS_MARKERS


@dataclass(frozen=True)
class Weights:
    relevance: float = 0.55
    freshness: float = 0.15
    trust: float = 0.10
    quality: float = 0.07
    spam: float = -0.15
    domain_cap: int = 3
    near: int = 3


def _marked(query: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(query, F.lit(m))
    return out


def intent(query: Column, share_recent: Column) -> Column:
    """news, evergreen or default: by markers in the query, else by the share of candidates younger than a week."""
    q = F.lower(query)
    return F.when(_marked(q, NEWS_MARKERS), "news").when(_marked(q, EVERGREEN_MARKERS), "evergreen").when(share_recent >= 0.4, "news").otherwise("default")


def freshness(published: Column, precision: Column, intent: Column, now: int) -> Column:
    """exp(-age / tau), tau 3, 90 or 30 days by intent; half if the date's precision is unknown; no date counts as now."""
    tau = F.when(intent == "news", 3.0).when(intent == "evergreen", 90.0).otherwise(30.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(published, F.lit(now))) / 86400.0)
    return F.exp(-age / tau) * F.when(precision == "unknown", 0.5).otherwise(1.0)


def relevance(position: Column) -> Column:
    """By 0-based place in retrieval order."""
    return F.exp(-position / 10.0)


def signals(hits: DataFrame, trust: DataFrame, now: int, w: Weights = Weights()) -> DataFrame:
    """hits (query_id, query, doc_id, pos from 1, source_id, published_at, precision, quality_score, spam_score) with each signal, score and
    rank; trust is a small dimension (source_id, trust)."""
    week = F.avg(F.when(F.lit(now) - F.coalesce("published_at", F.lit(now)) < 7 * 86400, 1.0).otherwise(0.0)).over(Window.partitionBy("query_id"))
    rows = hits.join(trust, "source_id", "left").withColumn("intent", intent(F.col("query"), week))
    rows = rows.withColumns({"s_relevance": relevance(F.col("pos") - 1), "s_fresh": freshness(F.col("published_at"), F.col("precision"), F.col("intent"), now), "s_trust": F.coalesce("trust", F.lit(0.6)), "s_quality": F.coalesce("quality_score", F.lit(0.4)), "s_spam": F.coalesce("spam_score", F.lit(0.0))})
    score = w.relevance * F.col("s_relevance") + w.freshness * F.col("s_fresh") + w.trust * F.col("s_trust") + w.quality * F.col("s_quality") + w.spam * F.col("s_spam")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def explained(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("explain", F.struct("s_relevance", "s_fresh", "s_trust", "s_quality", "s_spam", "score"))


def collapse(ranked: DataFrame, near: int = 3) -> DataFrame:
    """Greedy in rank order: a hit within `near` bits of a kept one goes into it; hits without a hash stay. Needs what came before, so it runs
    query by query on the bounded pool of candidates."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        stays = []
        for value in group.sort_values("rank")["simhash"]:
            none = pd.isna(value)
            bits = 0 if none else int(value) & 0xFFFFFFFFFFFFFFFF
            new = none or all((bits ^ k).bit_count() > near for k in kept)
            stays.append(new)
            if new and not none:
                kept.append(bits)
        return group.sort_values("rank")[stays]

    # As text, since pandas makes a column of whole numbers and nulls one of doubles, which lose bits.
    hashed = ranked.withColumn("simhash", F.col("simhash").cast("string"))
    return hashed.groupBy("query_id").applyInPandas(one, hashed.schema).withColumn("simhash", F.col("simhash").cast("long"))


def cap_domains(ranked: DataFrame, cap: int = 3) -> DataFrame:
    """Hits beyond the first `cap` of a domain go to the end, in order; 0 turns it off."""
    if not cap:
        return ranked
    turn = F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("rank"))
    return ranked.withColumn("over", (turn > cap).cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("over", "rank"))).drop("over")


def rerank(hits: DataFrame, trust: DataFrame, now: int, w: Weights = Weights()) -> DataFrame:
    ranked = signals(hits, trust, now, w)
    return cap_domains(collapse(ranked, w.near) if "simhash" in hits.columns else ranked, w.domain_cap)


def engagement(likes: Column, comments: Column, shares: Column) -> Column:
    """An optional signal: logarithmic, 0 to 1 at a million."""
    return F.least(F.lit(1.0), F.log10(1 + likes + 2 * comments + 3 * shares) / 6)
