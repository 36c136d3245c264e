"""Document signals: spam, topics, places, entities, quality."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.fixed import REGIONS, TOPICS
from siftline.functions.text import ACCENTS, LETTERS, let, plain_words

_FOLD = str.maketrans(*LETTERS)


def folded_keyword(word: str) -> str:
    return word.lower().translate(_FOLD)


def _hits(words: Column, keywords: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(keywords)))


def phrase_hits(words: Column, phrases: list[str]) -> Column:
    """How many different phrases stand among the words, as whole words."""


    def count(line: Column) -> Column:
        found = [F.contains(line, F.lit(f" {p} ")).cast("int") for p in phrases]
        return sum(found[1:], found[0]) if found else F.lit(0)

    return let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), count)


def top_share(words: Column, least_chars: int = 4, least_words: int = 25) -> Column:
    """The share of the most frequent content word, 0 for short texts: sorted words are read once, the longest run wins."""
    content = F.filter(words, lambda w: F.length(w) >= least_chars)
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["word"] == w, a["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return let(content, lambda c: F.when(F.size(c) >= least_words, F.aggregate(F.array_sort(c), start, step, lambda a: a["most"].cast("double")) / F.size(c)).otherwise(0.0))


def spam_score(words: Column, phrases: list[str]) -> Column:
    """The larger of distinct phrases / 3 and top share / 0.18, at most 1."""
    return let(words, lambda w: F.least(F.lit(1.0), F.greatest(phrase_hits(w, phrases) / 3, top_share(w) / 0.18)))


def topics(words: Column, least: int = 2, most: int = 3) -> Column:
    """Labels with at least `least` keyword hits, most hits first, then by name."""
    every = [folded_keyword(k) for keys in TOPICS.values() for k in keys]

    def score(hits: Column) -> Column:
        scored = F.array(*[F.struct((-_hits(hits, [folded_keyword(k) for k in keys])).alias("n"), F.lit(label).alias("label")) for label, keys in TOPICS.items()])
        return F.transform(F.slice(F.array_sort(F.filter(scored, lambda t: t["n"] <= -least)), 1, most), lambda t: t["label"])

    # Most words are no keyword of any topic; the rest is short.
    return let(F.filter(words, lambda w: w.isin(every)), score)


def region_names() -> dict[str, int]:
    out = {}
    for code, *names in REGIONS:
        for name in names:
            plain = unicodedata.normalize("NFKD", name.lower())
            plain = "".join(c for c in plain if not unicodedata.combining(c)) if any("a" <= c <= "z" for c in plain) else name
            out[" ".join(folded_keyword(plain).replace("'", " ").replace("-", " ").split())] = code
    return out


def region(words: Column) -> Column:
    """(code, mentions) of the region named most often; null if none is, or if the first two are named once each."""
    names = region_names()
    codes = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def count(found: Column) -> Column:
        return F.array_sort(F.transform(F.array_distinct(found), lambda c: F.struct((-F.size(F.filter(found, lambda x: x == c))).alias("n"), c.alias("code"))))

    def decide(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        clear = ~((first["n"] == -1) & F.coalesce(second["n"] == -1, F.lit(False)))
        return F.when(clear & first.isNotNull(), F.struct(first["code"].alias("code"), (-first["n"]).alias("mentions")))

    # What names of several words begin with: only there can a run of two or three words be one.
    parts = [name.split(" ") for name in names]
    heads = sorted({" ".join(p[:k]) for p in parts for k in range(1, len(p))})

    def runs(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i).isin(heads))
        two = F.transform(F.filter(at, lambda i: i + 1 < F.size(p)), lambda i: F.concat_ws(" ", F.get(p, i), F.get(p, i + 1)))
        three = F.transform(F.filter(at, lambda i: i + 2 < F.size(p)), lambda i: F.concat_ws(" ", F.get(p, i), F.get(p, i + 1), F.get(p, i + 2)))
        return F.filter(F.concat(p, two, three), lambda r: r.isin(list(names)))

    # Accents go once from the whole line, quotes and dashes from the few words that have some.
    line = F.translate(F.array_join(words, " "), *ACCENTS)
    plain = let(line, lambda t: F.when(t.rlike("['’-]"), F.transform(F.split(t, " "), plain_words)).otherwise(F.split(t, " ")))
    # Most texts have no word that is a name or begins one.
    some = sorted({*names, *heads})
    named = let(plain, lambda p: F.when(F.exists(p, lambda w: w.isin(some)), runs(p)).otherwise(F.array().cast("array<string>")))
    return let(let(F.transform(named, lambda r: F.element_at(codes, r)), count), decide)


def entities(title: Column, body: Column, most: int = 20) -> Column:
    """Capitalised words of 3 to 40 characters, the first distinct ones of title and 4,000 characters."""
    words = F.transform(F.split(F.concat_ws(" ", title, F.left(body, F.lit(4000))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 40) & w.rlike(r"^\p{Lu}"))), 1, most)


def quality(length: Column, precision: Column, method: Column, title: Column, author: Column, has_media: Column, language: Column) -> Column:
    """A score from completeness: length, date, extraction method, title, author, media, language."""
    date = F.when(precision == "second", 0.20).when(precision == "day", 0.18).when(precision == "month", 0.10).otherwise(0.0)
    how = F.when(method == "jsonld", 0.20).when(method == "block", 0.12).when(method == "og", 0.10).otherwise(0.02)
    return 0.25 * F.least(F.lit(1.0), length / 3000) + date + how + F.when(F.length(title) > 15, 0.10).otherwise(0.0) + F.when(author.isNotNull(), 0.08).otherwise(0.0) + F.when(has_media, 0.05).otherwise(0.0) + F.when(language != "und", 0.12).otherwise(0.0)


def trusted_quality(quality: Column, trust: Column) -> Column:
    return 0.7 * quality + 0.3 * trust


def content_errors(value: Column, low: float, high: float, was: Column, movement: float, observed: Column, now: Column, skew: int = 300) -> Column:
    """Why a measured value is refused, or null: bounds, too large a move, a time in the future."""
    moved = F.abs(value - was) > movement * F.abs(was)
    return F.when(value.isNull() | F.isnan(value), "missing").when((value < low) | (value > high), "out_of_bounds").when((was != 0) & moved, "moved_too_far").when(observed > now + skew, "future")
