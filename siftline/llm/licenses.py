"""License scans by a positional index of rare license words.

Every template is a run of words. Words of templates are weighed by inverse document frequency over all documents of the
scan. Of each file only the positions of template words are looked at: a template's rarest word in it is the anchor, whose
positions give, by relative position, all places where the template can start. For a base phrase the words around each such
place are compared, which finds every place where it stands. For a longer template its rarest words vote for a start; where enough of
their weight agrees and the mandatory key phrase stands at its place in the template, its label is given.

All of it is column expressions within a row, so no row moves but the sums of word frequencies. Null and empty texts have no
words. Repeated rows each get a row; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._shared import ascii_lower, text_of

#: Fixed by contract: phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Longer wordings: label, words, mandatory key phrase.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache-notice", "licensed under the apache license version 2 0", "apache license version"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    ("cc-notice", "licensed under cc by nc 4 0", "cc by"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)

VOTERS = 5
AGREE = 0.6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _vocabulary() -> list[str]:
    return sorted({w for text in (*(b[0] for b in BASE), *(t[1] for t in TEMPLATES), *(t[2] for t in TEMPLATES)) for w in text.split()})


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), _SPLIT), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(words: Column) -> Column:
    """The positions of all template words, in order."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.expr("array()").cast("array<int>"))
    return F.filter(places, lambda i: F.get(words, i).isin(_vocabulary()))


def _stands(words: Column, start: Column, phrase: list[str], skip: int = -1) -> Column:
    """Whether the phrase stands at start; getting a negative or too large position gives null, which is not equal."""
    out = start >= 0
    for k, w in enumerate(phrase):
        if k != skip:
            out = out & (F.get(words, start + k) == w)
    return F.coalesce(out, F.lit(False))


def _starts(words: Column, places: Column, phrase: list[str], weight: dict[str, float]) -> Column:
    """All starts of a phrase: the positions of its rarest word, shifted, where the other words stand too."""
    anchor = max(range(len(phrase)), key=lambda k: (weight[phrase[k]], -k))
    at = F.filter(places, lambda i: (F.get(words, i) == phrase[anchor]) & _stands(words, i - anchor, phrase, anchor))
    return F.transform(at, lambda i: i - anchor)


def frequencies(documents: DataFrame) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many have each template word: one row a template word."""
    found = documents.select(F.array_distinct(_let(words_of(text_of()), lambda w: F.filter(w, lambda x: x.isin(_vocabulary())))).alias("words"))
    counts = found.select(F.explode(F.concat(F.col("words"), F.array(F.lit("")))).alias("word")).groupBy("word").count()
    seen = {r[0]: r[1] for r in counts.collect()}
    return seen.pop("", 0), seen


def _at(places: Column, words: Column, word: str, back: int) -> Column:
    """The starts that a word's positions give to a template in which it stands `back` words after the start."""
    return F.transform(F.filter(places, lambda i: F.get(words, i) == word), lambda i: i - back)


def _share(words: Column, phrase: list[str], voters: list[int], weight: dict[str, float]):
    """How much of the voters' weight stands at a start."""
    whole = sum(weight[phrase[k]] for k in voters) or 1.0

    def of(start: Column) -> Column:
        votes = [F.when(F.get(words, F.when(start + k >= 0, start + k)) == phrase[k], weight[phrase[k]] / whole).otherwise(0.0) for k in voters]
        return F.struct(sum(votes[1:], votes[0]).alias("share"), (-start).alias("back"))

    return of


def _template(words: Column, places: Column, template: tuple[str, str, str], weight: dict[str, float]) -> Column:
    """A template's label, best start and share, or null. A start counts only if the key phrase stands where the template has it."""
    label, text, key = template
    phrase, inner = text.split(), key.split()
    offset = next(k for k in range(len(phrase)) if phrase[k : k + len(inner)] == inner)
    voters = sorted(range(len(phrase)), key=lambda k: (-weight[phrase[k]], k))[:VOTERS]
    whole = sum(weight[phrase[k]] for k in voters) or 1.0
    # Where AGREE of the weight agrees, at least one of the rarest voters stands; these give the starts.
    firsts = [k for n, k in enumerate(voters) if sum(weight[phrase[j]] for j in voters[:n]) / whole <= 1 - AGREE]
    starts = F.flatten(F.array(*[_at(places, words, phrase[k], k) for k in firsts]))
    keyed = F.filter(starts, lambda s: _stands(words, s + offset, inner))
    best = F.array_max(F.transform(keyed, _share(words, phrase, voters, weight)))
    found = F.struct(F.lit(label).alias("label"), (-best["back"]).cast("long").alias("start"), best["share"].alias("share"))
    return F.when(best["share"] >= AGREE, found)


def scan_licenses(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, hits (an array of start and label, all places of base phrases) and found (an array of label, start and
    share: for each template the share of its voters' weight at its best start)."""
    total, seen = frequencies(documents)
    weight = {w: math.log((total + 1) / (seen.get(w, 0) + 0.5)) for w in _vocabulary()}

    def base(words: Column, places: Column, k: int) -> Column:
        phrase, label = BASE[k]
        return F.transform(_starts(words, places, phrase.split(), weight), lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))

    def look(words: Column) -> Column:
        def at(places: Column) -> Column:
            hits = F.concat(*[base(words, places, k) for k in range(len(BASE))])
            found = F.array_compact(F.array(*[_template(words, places, t, weight) for t in TEMPLATES]))
            # Most texts have no template word, and nothing more is looked at.
            return F.when(F.size(places) == 0, _found(F.size(words), F.array(), F.array())).otherwise(_found(F.size(words), hits, found))

        return _let(_positions(words), at)

    rows = documents.select("doc_id", F.explode(F.transform(F.array(text_of()), lambda t: _let(words_of(t), look))).alias("x"))
    return rows.select("doc_id", "x.n_words", "x.hits", "x.found")


def _found(n_words: Column, hits: Column, found: Column) -> Column:
    return F.struct(n_words.cast("long").alias("n_words"), hits.cast("array<struct<start:int,label:string>>").alias("hits"), found.cast("array<struct<label:string,start:bigint,share:double>>").alias("found"))


def summarise(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    base = F.array_sort(F.array_distinct(F.col("hits.label")))
    extra = F.col("found.label")
    best = F.coalesce(F.array_max(F.col("found.share")), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min(F.col("hits.start")).cast("long").alias("first_word"),
        F.array_max(F.col("hits.start")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("hits.label"), extra))), ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(best).alias("score"),
        "found",
    )
