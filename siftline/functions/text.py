"""Text algebra: normalising, folding, scripts, tokens, hashes."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.arrow import arrow

#: Code points that normalising removes, and letters and digits that it folds.
INVISIBLE = "\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
DIACRITICS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u08d3-\u08ff"
TATWEEL = "\u0640"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
LETTERS = ("أإآٱىیےةؤئک", "اااايييهويك")
MOST_CHARS = 200_000

#: Control characters but for white space.
_CONTROLS = r"\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
_ARABIC = "[\u0600-\u06ff]"
#: White space that is not one plain blank already.
_SPACE = r"(?U)\s{2,}|[\s&&[^ ]]"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Switches:
    """What normalising does beside composition, spaces and invisible marks; `most` cuts the result to so many characters."""

    diacritics: bool = True
    tatweel: bool = True
    digits: bool = True
    lowercase: bool = True
    letters: bool = False
    most: int | None = None


def _native(c: Column, on: Switches = Switches()) -> Column:
    """Normalising of text that compatibility composition leaves as it is."""
    removed = INVISIBLE + (DIACRITICS if on.diacritics else "") + (TATWEEL if on.tatweel else "")
    before = (DIGITS[0] if on.digits else "") + (LETTERS[0] if on.letters else "")
    after = (DIGITS[1] if on.digits else "") + (LETTERS[1] if on.letters else "")
    plain = F.regexp_replace(c, f"[{removed}{_CONTROLS}]", "")
    plain = F.lower(plain) if on.lowercase else plain
    # Character by character is slow, and only texts with Arabic need it.
    plain = F.when(c.rlike(_ARABIC), F.translate(plain, before, after)).otherwise(plain) if before else plain
    plain = F.trim(F.regexp_replace(plain, _SPACE, " "))
    return plain if on.most is None else F.rtrim(F.left(plain, F.lit(on.most)))


@arrow("string")
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize(c: Column, most: int | None = None) -> Column:
    """Compatibility-composed, without invisible marks, tatweel and diacritics, with plain digits, lower case and single spaces. Only
    text beyond ASCII goes through Python. `most` cuts the result to so many characters, as a guard for requests (MOST_CHARS)."""
    return normalize_with(c, Switches(most=most))


def normalize_with(c: Column, on: Switches) -> Column:
    """Normalising by switches; a step that is off leaves its characters as composition gives them."""
    other = F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)
    return F.coalesce(_native(_composed(_native(_composed(other), replace(on, most=None))), on), _native(c, on))


def fold(c: Column) -> Column:
    """Normalised, with variants of Arabic letters made one."""
    return normalize_with(c, Switches(letters=True))


def fold_plain(c: Column) -> Column:
    """Folding of text that compatibility composition leaves as it is: no Python."""
    return _native(c, Switches(letters=True))


def normalize_plain(c: Column) -> Column:
    return _native(c)


ACCENTS = ("àâäáãåçèéêëìíîïñòóôöõùúûüýÿœ", "aaaaaaceeeeiiiinooooouuuuyyo")


def plain_words(c: Column) -> Column:
    """Quotes and dashes made spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['’-]", " "), " +", " "))


def strip_accents(c: Column) -> Column:
    """Latin accents removed, quotes and dashes made spaces: for matching names."""
    return plain_words(F.translate(c, *ACCENTS))


def tokens(c: Column) -> Column:
    """The words of normalised text, by spaces."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def terms(c: Column) -> Column:
    """Letters and digits in runs, in lower case: the index's words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}@#_]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def script_counts(c: Column) -> Column:
    """Letters in Arabic, in Latin, and in other scripts."""
    count = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    arabic = count("[^\u0620-\u064a\u066e-\u06d3\u06fa-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]")
    latin = count("[^A-Za-zÀ-ÖØ-öø-ɏ]")
    return F.struct(arabic.alias("arabic"), latin.alias("latin"), (count(r"[^\p{L}]") - arabic - latin).alias("other"))


def script(c: Column, dominance: float = 0.6) -> Column:
    """arabic, latin, mixed or unknown, by a dominating share of letters."""
    n = script_counts(c)
    total = n["arabic"] + n["latin"] + n["other"]
    return F.when(total == 0, "unknown").when(n["arabic"] >= dominance * total, "arabic").when(n["latin"] >= dominance * total, "latin").when(n["arabic"] + n["latin"] > 0, "mixed").otherwise("unknown")


def is_tifinagh(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[\u2d30-\u2d7f]")


def content_hash(c: Column) -> Column:
    """An opaque key of normalised text."""
    return F.concat(F.lit("s2:"), F.sha2(normalize(c), 256))


def simhash_of(text: str | None, least: int = 20) -> int | None:
    """64 signed votes of words (weight 1) and three-word runs (weight 2), as a signed number; none below `least` words."""
    words = (text or "").split()
    if len(words) < least:
        return None
    plain = [w.encode() for w in words]
    features = [*plain, *map(b" ".join, zip(plain, plain[1:], plain[2:]))]
    data = b"".join([md5(f).digest()[:8] for f in features])
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1)
    n = len(words)
    for_it = bits[:n].sum(0, np.int64) + 2 * bits[n:].sum(0, np.int64)
    # A bit is set if more than half of the weight, n for the words and 2 for each run, votes for it.
    return int(np.packbits(2 * for_it > n + 2 * (len(features) - n)).view(">i8")[0])


@arrow("long")
def simhash(x: pd.Series) -> pd.Series:
    """SimHash of normalised text."""
    return pd.Series([simhash_of(s) for s in x], dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(c: Column) -> Column:
    """(which, value) for each way to choose three of six blocks of a SimHash's bits: two hashes that differ in at most three bits agree in
    three blocks, so they share a key, and a key of some 32 bits is shared by few others."""
    cuts = [0, 11, 22, 33, 44, 54, 64]
    blocks = [F.shiftrightunsigned(c, 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    chosen = combinations(range(6), 3)
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftleft(F.shiftleft(blocks[x], 11).bitwiseOR(blocks[y]), 11).bitwiseOR(blocks[z]).alias("value")) for k, (x, y, z) in enumerate(chosen)])


def hash_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def bands(c: Column, n: int = 4) -> Column:
    """(band, value) for n equal parts of a 64-bit hash, from the highest bits on."""
    width = 64 // n
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(c, 64 - width * (k + 1)).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value")) for k in range(n)])


def strip_tags(c: Column) -> Column:
    """Markup out, six references decoded, spaces collapsed."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def excerpt(c: Column, most: int = 320) -> Column:
    """The first characters, up to the last end of a sentence if that is past half, else with an ellipsis."""
    head = F.left(c, F.lit(most))
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?؟])", 1))
    return F.when(F.length(c) <= most, c).when(stop * 2 > most, F.left(head, stop)).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def trim_title(c: Column, most: int = 70) -> Column:
    return F.rtrim(F.left(F.trim(F.substring_index(F.substring_index(c, " | ", 1), " - ", 1)), F.lit(most)))


def highlight(c: Column, words: list[str]) -> Column:
    """<em> around the query's words, as whole words."""
    import re

    pattern = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(c, rf"(?iu)\b({pattern})\b", "<em>$1</em>") if words else c
