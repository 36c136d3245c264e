"""Language: lexicon scores, detection, transliteration, expansion, questions, sentiment.

Lexicons are parameters: files of `term<TAB>strong|weak|number` that `siftline.sources.readers` reads. Small ones fit a broadcast
variable, which Arrow functions hold once for each Python worker.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow
from siftline.functions import fixed
from siftline.functions.text import DIACRITICS, DIGITS, INVISIBLE, LETTERS, TATWEEL

_DROP = re.compile(f"[{INVISIBLE}{DIACRITICS}{TATWEEL}]|(?![\t\n\x0b\x0c\r\x85])[\x00-\x1f\x7f-\x9f]")
_DIGITS, _LETTERS = str.maketrans(*DIGITS), str.maketrans(*LETTERS)


def normal(text: str, most: int | None = None) -> str:
    """What `text.normalize` gives, for one string."""
    text = _DROP.sub("", unicodedata.normalize("NFKC", text)).translate(_DIGITS).lower()
    return " ".join(unicodedata.normalize("NFKC", text).split())[:most].rstrip()


def folded(text: str) -> str:
    return normal(text).translate(_LETTERS)


@dataclass(frozen=True)
class Evidence:
    hits: int = 0
    weight: float = 0.0
    strong: int = 0
    weak: int = 0
    coverage: float = 0.0

    @property
    def enough(self) -> bool:
        return self.strong >= 1 or self.weak >= 2


def evidence(words: list[str], lexicon: Mapping[str, float]) -> Evidence:
    """Hits of single words and word pairs; from weight 1 on a hit is strong."""
    found = [lexicon[w] for w in [*words, *map(" ".join, zip(words, words[1:]))] if w in lexicon]
    strong = sum(v >= 1 for v in found)
    return Evidence(len(found), sum(found), strong, len(found) - strong, len(found) / len(words) if words else 0.0)


def script_shares(text: str) -> tuple[str, float]:
    """The dominating script and the share of Arabic letters."""
    arabic = latin = other = 0
    for c in text:
        if not c.isalpha():
            continue
        if "؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ࢠ" <= c <= "ࣿ" or "ﭐ" <= c <= "﻿":
            arabic += 1
        elif c <= "ɏ":
            latin += 1
        else:
            other += 1
    total = arabic + latin + other
    if not total:
        return "unknown", 0.0
    if arabic >= 0.6 * total:
        return "arabic", arabic / total
    if latin >= 0.6 * total:
        return "latin", arabic / total
    return ("mixed" if arabic + latin else "unknown"), arabic / total


def digit_signal(word: str) -> bool:
    """A digit that stands for a letter, beside a letter."""
    return bool(re.search(r"[a-z][235679]|[235679][a-z]", word))


@dataclass(frozen=True)
class Lexicons:
    """Weights of terms that mark a language, and trigram profiles for what no term decides."""

    darija: Mapping[str, float] = field(default_factory=dict)
    arabizi: Mapping[str, float] = field(default_factory=dict)
    french: Mapping[str, float] = field(default_factory=dict)
    english: Mapping[str, float] = field(default_factory=dict)
    profiles: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


def trigrams(text: str) -> list[str]:
    line = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
    return [line[k : k + 3] for k in range(len(line) - 2)]


def profile(texts: list[str], most: int = 400) -> dict[str, float]:
    """Logarithms of a language's trigram shares."""
    from collections import Counter

    counts = Counter(g for t in texts for g in trigrams(t))
    total = sum(counts.values()) or 1
    return {g: math.log(n / total) for g, n in counts.most_common(most)}


def by_trigrams(text: str, profiles: Mapping[str, Mapping[str, float]]) -> tuple[str, float]:
    """The likeliest profile, with .80, .62 or .40 as confidence by its lead over the next."""
    grams = trigrams(text)
    if not grams or not profiles:
        return "und", 0.0
    scores = sorted(((sum(p.get(g, -12.0) for g in grams) / len(grams), name) for name, p in profiles.items()), reverse=True)
    lead = scores[0][0] - (scores[1][0] if len(scores) > 1 else -12.0)
    return scores[0][1], 0.80 if lead > 0.5 else 0.62 if lead > 0.15 else 0.40


def detect_one(text: str | None, lex: Lexicons) -> dict:
    """language, confidence, script and secondary language of one text."""
    text = folded((text or "")[:4096])
    words = text.split()
    kind, arabic = script_shares(text)
    language, confidence, secondary, statistical = "und", 0.0, None, False
    darija, arabizi = evidence(words, lex.darija), evidence(words, lex.arabizi)
    french, english = evidence(words, lex.french), evidence(words, lex.english)
    digits = any(map(digit_signal, words))
    if kind == "arabic":
        language, confidence = ("ary", min(0.97, 0.6 + min(0.12 * darija.weight, 0.3) + min(0.2 * darija.coverage, 0.1))) if darija.enough else ("ar", 0.65)
    elif kind == "latin":
        if (arabizi.enough or digits and arabizi.hits) and arabizi.hits >= french.hits:
            language, confidence = "ary", min(0.95, 0.6 + min(0.1 * arabizi.weight, 0.25) + (0.1 if digits else 0.0))
            secondary = "fr" if french.hits else None
        elif french.enough and french.hits > arabizi.hits and french.hits >= english.hits:
            language, confidence = "fr", min(0.95, 0.6 + min(0.08 * french.weight, 0.3))
            secondary = "ary" if arabizi.hits else None
        elif english.enough and english.hits > max(french.hits, arabizi.hits):
            language, confidence = "en", min(0.95, 0.6 + min(0.08 * english.weight, 0.3))
        else:
            language, confidence = by_trigrams(text, lex.profiles)
            statistical = True
    elif kind == "mixed":
        local = darija.enough or arabizi.enough
        if local and french.hits:
            language, confidence = ("mixed", 0.70) if french.coverage >= 0.30 else ("ary", 0.75)
        elif darija.enough:
            language, confidence = "ary", 0.75
        elif french.enough and arabic < 0.5:
            language, confidence = "fr", 0.65
        else:
            language, confidence = "mixed", 0.60
    if statistical:
        confidence *= min(1.0, len(words) / 5)
    if confidence < 0.55:
        language, secondary = "und", None
    return {"language": language, "confidence": confidence, "script": kind, "secondary": secondary}


def detect(lex: Lexicons) -> Callable[[Column], Column]:
    """An Arrow function over text columns."""

    @F.pandas_udf("struct<language:string,confidence:double,script:string,secondary:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect_one(t, lex) for t in x], columns=["language", "confidence", "script", "secondary"])

    return run


#: What Latin letters and digits can stand for, and how Arabic letters are spelt in Latin ones.
TO_ARABIC = {
    "ch": ["ش"], "sh": ["ش"], "kh": ["خ"], "gh": ["غ"], "th": ["ث", "ت"], "dh": ["ذ", "ض"], "ou": ["و"], "oo": ["و"], "aa": ["ا"], "ee": ["ي"], "ii": ["ي"], "dj": ["ج"],
    "2": ["ء", "أ"], "3": ["ع"], "5": ["خ"], "6": ["ط"], "7": ["ح"], "8": ["غ"], "9": ["ق"],
    "a": ["ا", ""], "b": ["ب"], "c": ["ك", "س"], "d": ["د", "ض"], "e": ["", "ي"], "f": ["ف"], "g": ["ق", "ڨ", "غ"], "h": ["ه", "ح"], "i": ["ي", ""], "j": ["ج"], "k": ["ك", "ق"], "l": ["ل"], "m": ["م"], "n": ["ن"],
    "o": ["و", ""], "p": ["ب"], "q": ["ق"], "r": ["ر"], "s": ["س", "ص"], "t": ["ت", "ط"], "u": ["و", ""], "v": ["ف"], "w": ["و"], "x": ["كس"], "y": ["ي"], "z": ["ز", "ظ"],
}
TO_LATIN = dict(zip("اأإآبتثجحخدذرزسشصضطظعغفقڨكلمنهويىةءؤئ", "a a a a b t th j 7 kh d dh r z s ch s d t z 3 gh f 9 g k l m n h ou i i a 2 ou i".split()))
_COMMON, _VOWELS, _EMPHATIC = set("امتين"), set("اوي"), set("صضطظڨ")


def _step(so_far: str, piece: str) -> float:
    """How plausible a piece is after what stands already."""
    if not piece:
        return 0.15
    if not so_far:
        return 0.3 if piece[0] in _COMMON else 0.2
    score = 0.2
    if so_far[-1] == piece[0]:
        score -= 0.5
    if so_far[-1] in _VOWELS and piece[0] in _VOWELS:
        score -= 0.3
    if so_far + piece == "ال":
        score += 0.4
    if piece[0] in _EMPHATIC:
        score -= 0.15
    return score


def to_arabic(token: str, beam: int = 12, top: int = 4, least: int = 3) -> list[tuple[str, float]]:
    """The likeliest Arabic spellings of a Latin token, best first, by a beam over greedy pieces of one or two characters. Doubled
    consonants are one letter before any piece is read; tokens of fewer than `least` characters, or without a letter, have none."""
    token = token.strip().lower()
    if len(token) < least or not re.search("[a-z]", token):
        return []
    token = re.sub(r"([^aeiou])\1+", r"\1", token)
    states: list[tuple[str, float]] = [("", 0.0)]
    at = 0
    while at < len(token):
        size = 2 if token[at : at + 2] in TO_ARABIC else 1
        piece = token[at : at + size]
        at += size
        if piece not in TO_ARABIC:
            continue
        grown = [(s + c, v + _step(s, c)) for s, v in states for c in TO_ARABIC[piece] if len(s + c) <= 2 * max(1, len(token))]
        states = sorted(grown, key=lambda x: -x[1])[:beam]
    out: list[tuple[str, float]] = []
    for text, value in sorted(states, key=lambda x: -x[1]):
        if text and (not out or out[-1][0] != text):
            out.append((text, round(value, 6)))
    return out[:top]


def to_arabizi(token: str) -> str:
    """The usual Latin spelling; letters and digits without one stay, marks go."""
    return "".join(TO_LATIN.get(c, c if c.isalnum() else "") for c in token)


@arrow("array<struct<text:string,score:double>>")
def arabic_spellings(x: pd.Series) -> pd.Series:
    """Apply to distinct tokens."""
    return x.map(lambda t: [{"text": a, "score": s} for a, s in to_arabic(t or "")])


@dataclass(frozen=True)
class Concept:
    variants: tuple[str, ...]
    weight: float = 0.85


def expand(query: str, language: str, concepts: list[Concept], most_tokens: int = 3, most_variants: int = 8) -> list[tuple[str, str, float]]:
    """(token, variant, weight): other words for a query's first tokens that have any, by concepts and by transliteration."""
    words = folded(query).split()
    by_word: dict[str, list[Concept]] = {}
    for c in concepts:
        for v in c.variants:
            by_word.setdefault(folded(v), []).append(c)
    out: list[tuple[str, str, float]] = []
    used = 0
    for token in words:
        if used == most_tokens:
            break
        if len(token) < 3:
            continue
        found: dict[str, float] = {}
        for c in by_word.get(token, ()):
            for v in map(folded, c.variants):
                if v not in words:
                    found[v] = max(found.get(v, 0.0), min(c.weight, 0.95))
        if language not in ("fr", "en") and token.isascii() and any(ch.isalpha() for ch in token):
            for text, _ in to_arabic(token):
                if folded(text) not in words:
                    found.setdefault(folded(text), 0.6)
        if found:
            used += 1
            out += [(token, v, w) for v, w in sorted(found.items(), key=lambda x: -x[1])[:most_variants]]
    return out


def is_question(c: Column) -> Column:
    """A question mark at the end, a question phrase, or a question word in at least two words; some count only as the first."""
    from siftline.functions.text import normalize

    text = normalize(c)
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    free = [w for w in fixed.QUESTION_WORDS if w not in fixed.LEADING_ONLY]
    word = F.exists(words, lambda w: w.isin(free)) | F.coalesce(F.get(words, F.lit(0)).isin(list(fixed.QUESTION_WORDS)), F.lit(False))
    phrase = F.lit(False)
    for p in fixed.QUESTION_PHRASES:
        phrase = phrase | F.contains(text, F.lit(p))
    return F.coalesce(F.trim(c).rlike("[?؟]$") | phrase | ((F.size(words) >= 2) & word), F.lit(False))


#: Constants of the valence model.
WINDOW, ALPHA, SATURATION, NEGATION, STRONGER, WEAKER, ELONGATED, SHOUTED, BANG = 3, 15.0, 4.0, -0.74, 1.3, 0.7, 1.2, 1.15, 0.05
CLITICS = ("وبال", "فبال", "وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل")
EMOJI = {"😍🥰😻": 3.2, "😀😃😄😁🙂😊": 2.2, "👍👏🙏💪": 2.0, "❤♥💖💕": 2.6, "🎉🎊✅": 1.8, "😢😭😔☹🙁": -2.4, "😡🤬😠": -3.0, "👎💔": -2.4, "⚠❌": -1.4, "🤮🤢": -2.8}


def _valence(word: str, valence: Mapping[str, float]) -> float | None:
    """A word's valence, else that of what is left without an Arabic prefix, if that has three letters."""
    if word in valence:
        return valence[word]
    stems = (word[len(p) :] for p in CLITICS if word.startswith(p) and len(word) - len(p) >= 3)
    return next((valence[s] for s in stems if s in valence), None)


def sentiment_one(text: str | None, valence: Mapping[str, float]) -> dict:
    """label, score and confidence from the valences of normalised words and of emoji, with negation, strengthening and weakening in the
    three words before. A word of valence 0 is evidence without a direction."""
    raw = (text or "")[:1000]
    words = normal(raw).split()
    total, found = 0.0, 0
    for k, word in enumerate(words):
        value = _valence(word, valence)
        if value is None:
            continue
        found += 1
        before = words[max(0, k - WINDOW) : k]
        for w in before:
            value *= STRONGER if w in fixed.INTENSIFIERS else WEAKER if w in fixed.DIMINISHERS else 1.0
        if any(w in fixed.NEGATORS for w in before):
            value *= NEGATION
        if re.search(r"(.)\1\1", word):
            value *= ELONGATED
        if len(word) > 2 and word.isascii() and not any(map(str.islower, word)):
            value *= SHOUTED
        total += value
    for c in raw:
        shown = next((v for faces, v in EMOJI.items() if c in faces), None)
        if shown is not None:
            total, found = total + shown, found + 1
    if not words:
        return {"label": "neutral", "score": 0.0, "confidence": 0.0}
    total *= 1 + BANG * (min(raw.count("!"), 3) + min(raw.count("؟"), 2) + min(raw.count("?"), 2))
    score = total / math.sqrt(total * total + ALPHA)
    evidence = min(1.0, max(found / SATURATION, found / len(words)))
    confidence = evidence * (0.3 + 0.7 * min(1.0, 3 * abs(score)))
    if confidence < 0.35:
        return {"label": "neutral", "score": 0.0, "confidence": round(confidence, 6)}
    return {"label": "positive" if score > 0.15 else "negative" if score < -0.15 else "neutral", "score": round(score, 6), "confidence": round(confidence, 6)}


def sentiment(valence: Mapping[str, float]) -> Callable[[Column], Column]:
    @F.pandas_udf("struct<label:string,score:double,confidence:double>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sentiment_one(t, valence) for t in x], columns=["label", "score", "confidence"])

    return run
