"""Document fingerprints from prefix polynomial hashes.

A text c[0..n) has for each modulus p and base B the prefix array S[i] = sum over j < i of (c[j]+1) * B^j mod p. Any
span's hash is (S[j]-S[i]) * B^-i mod p, so that two spans are compared in constant time and the longest common extension
of two positions, to the right or to the left, is found by binary search. The fingerprint that is written is the length, the hash of
the whole text under two moduli, and the smallest hashes among all spans of SPAN code points.

Likeness is taken from the prefix arrays of both texts: every SPAN-th span of a text is looked up among all spans of the other,
where it first occurs it is extended both ways as far as the texts agree, and likeness is the share of both texts' code points that such
matches cover. So every common run of 2 * SPAN - 1 code points counts, and chance matches of a few words hardly do. Equal texts have
likeness 1, an empty text and another one 0. A text shorter than SPAN is one span.

Empty or null texts have length 0 and no span. Equal texts have equal fingerprints whatever their row. Repeated rows each get a row;
rows with the same doc_id follow each other in order of a hash of the text. A null doc_id sorts first. An empty table gives an empty
result. Only doc_id and text are read, so other columns of any name do no harm. A worker holds three texts' prefix arrays at a time,
some 60 bytes for each of their code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._shared import partitions, small_batches, text_of

MODULI = (2147483647, 2147483629)
BASES = (1_103_515_245, 69_621_337)
SPAN = 16
KEPT = 64
CHUNK = 1 << 18
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i mod p for i up to size."""
    p, base = MODULI[which], BASES[which]

    def row(b: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        step = b
        while len(out) < size + 1:
            out = np.concatenate([out, out * _U(step) % _U(p)])
            step = step * step % p
        return out[: size + 1].astype(np.uint32)

    return row(base), row(pow(base, -1, p))


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The powers for texts of up to n code points, from a few sizes of tables."""
    size = 1 << 14
    while size < n:
        size <<= 2
    return [_powers(k, size) for k in (0, 1)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + _U(1)


def _prefix(codes: np.ndarray, which: int, powers: np.ndarray) -> np.ndarray:
    p = _U(MODULI[which])
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)] % p, out=out[1:])
    out %= p
    return out


class PrefixHashes:
    """The prefix arrays of one text, for span equality and longest common extensions."""

    def __init__(self, text: str) -> None:
        codes = _codes(text)
        self.n = len(codes)
        self._sums = [_prefix(codes, k, powers) for k, (powers, _) in enumerate(_tables(self.n))]
        self._inverse = [inverse for _, inverse in _tables(self.n)]
        self._spans: dict[int, np.ndarray] = {}

    @classmethod
    def joined(cls, one: PrefixHashes, stop: int, other: PrefixHashes, length: int) -> PrefixHashes:
        """The arrays of one's first `stop` code points and other's first `length` behind them, without their text."""
        out = cls.__new__(cls)
        out.n = stop + length
        tables, out._sums, out._spans = _tables(out.n), [], {}
        out._inverse = [inverse for _, inverse in tables]
        for k, (a, b) in enumerate(zip(one._sums, other._sums)):
            p, shift = _U(MODULI[k]), _U(tables[k][0][stop])
            out._sums.append(np.concatenate([a[: stop + 1], (a[stop] + b[1 : length + 1] * shift) % p]))
        return out

    def whole(self) -> tuple[int, int]:
        """The hash of the whole text under both moduli."""
        return tuple(int(s[-1]) for s in self._sums)

    def every_span(self, width: int) -> np.ndarray:
        """The hashes of all spans of a width, under the first modulus."""
        if width not in self._spans:
            s, p = self._sums[0], _U(MODULI[0])
            n = max(0, self.n - width + 1)
            self._spans[width] = (s[width : width + n] + p - s[:n]) % p * self._inverse[0][:n] % p
        return self._spans[width]

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """The hash of text[start:stop], the same wherever the span stands."""
        return tuple((int(s[stop]) - int(s[start])) * int(v[start]) % p for s, v, p in zip(self._sums, self._inverse, MODULI))

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether text[start:start+length] is other's text[at:at+length]."""
        if min(start, at, length) < 0 or start + length > self.n or at + length > other.n:
            return False
        for k, p in enumerate(MODULI):
            s, t = self._sums[k], other._sums[k]
            one = (int(s[start + length]) - int(s[start])) * int(self._inverse[k][start])
            if (one - (int(t[at + length]) - int(t[at])) * int(other._inverse[k][at])) % p:
                return False
        return True

    def _search(self, same, low: int, high: int, step: int) -> int:
        """The largest length up to high for which same(length) holds, which does so for low and all smaller ones: by doubled steps, then
        by halves."""
        while low < high and same(ahead := min(high, low + step)):
            low, step = ahead, 2 * step
        high = min(high, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle) else (low, middle - 1)
        return low

    def extension(self, start: int, other: PrefixHashes, at: int, known: int = 0) -> int:
        """How many code points from start and at on are the same, of which some are known to be."""
        return self._search(lambda n: self.equal(start, other, at, n), known, min(self.n - start, other.n - at), SPAN)

    def extension_back(self, start: int, other: PrefixHashes, at: int) -> int:
        """How many code points before start and at are the same."""
        return self._search(lambda n: self.equal(start - n, other, at - n, n), 0, min(start, at), SPAN)

    def matches(self, other: PrefixHashes) -> list[tuple[int, int, int]]:
        """Maximal matches (start, place in the other text, length) of the spans at every SPAN-th place, at the first place where each occurs
        there, from left to right; a span inside the match before it is passed over."""
        width = min(SPAN, self.n)
        if not width or other.n < width:
            return []
        anchors = np.arange(0, self.n - width + 1, width)
        if anchors[-1] + width < self.n:
            anchors = np.append(anchors, self.n - width)
        hashes, which = np.unique(self.every_span(width)[anchors], return_inverse=True)
        # A table of low bits leaves few of the other text's spans to look up.
        mask = (1 << (len(hashes).bit_length() + 6)) - 1
        table = np.zeros(mask + 1, bool)
        table[(hashes & _U(mask)).astype(np.int64)] = True
        every = other.every_span(width)
        hit = np.flatnonzero(table[(every & _U(mask)).astype(np.int64)])
        place = np.searchsorted(hashes, every[hit])
        place[place == len(hashes)] = 0
        good = hashes[place] == every[hit]
        hit, place = hit[good][::-1], place[good][::-1]
        first = np.full(len(hashes), -1)
        first[place] = hit  # what is written last is what occurs first
        out, reached = [], 0
        for start, at in zip(anchors.tolist(), first[which].tolist()):
            if at < 0 or start + width <= reached or not self.equal(start, other, at, width):
                continue
            ahead = self.extension(start, other, at, width)
            behind = self.extension_back(start, other, at)
            reached = start + ahead
            out.append((start - behind, at - behind, behind + ahead))
        return out

    def covered(self, other: PrefixHashes) -> int:
        """How many of the text's code points matches with the other text cover."""
        upto = total = 0
        for start, _, length in sorted(self.matches(other)):
            total += max(0, start + length - max(start, upto))
            upto = max(upto, start + length)
        return total


def smallest(hashes: PrefixHashes) -> np.ndarray:
    """The KEPT smallest of all different span hashes (mixed, 32 bits each), chunk by chunk."""
    width = min(SPAN, hashes.n)
    spans = hashes.every_span(width) if width else np.zeros(0, np.uint64)
    # First those below a bound that several times KEPT are expected to meet, then all, if they were too few.
    for limit in (_U(min(1.0, 4.0 * KEPT / max(1, len(spans))) * 2**32), _U(2**32)):
        parts = []
        for a in range(0, len(spans), CHUNK):
            mixed = (spans[a : a + CHUNK] + _U(1)) * _MIX
            mixed ^= mixed >> _U(29)
            mixed = mixed * _U(0xBF58476D1CE4E5B9) >> _U(32)
            parts.append(np.unique(mixed[mixed < limit])[:KEPT])
        found = np.unique(np.concatenate(parts))[:KEPT] if parts else np.zeros(0, np.uint64)
        if len(found) >= KEPT:
            break
    return found


def sketch(hashes: PrefixHashes | str) -> tuple[int, tuple[int, int], np.ndarray]:
    """What is written of a text: its length, whole-text hash and smallest span hashes."""
    if isinstance(hashes, str):
        hashes = PrefixHashes(hashes)
    return hashes.n, hashes.whole(), smallest(hashes)


def written(parts: tuple[int, tuple[int, int], np.ndarray]) -> str:
    """The fingerprint as text: length, whole-text hash, span hashes."""
    n, (one, two), found = parts
    return f"{n:x}:{one:08x}{two:08x}:{found.astype('>u4').tobytes().hex()}"


def likeness(one: PrefixHashes, other: PrefixHashes) -> float:
    """From 0 to 1: the share of both texts' code points that common matches cover."""
    if one.n == other.n and one.whole() == other.whole():
        return 1.0
    return (one.covered(other) + other.covered(one)) / (one.n + other.n)


def read(fingerprint: str) -> tuple:
    """A written fingerprint's parts again."""
    n, whole, spans = fingerprint.split(":")
    return int(n, 16), (int(whole[:8], 16), int(whole[8:], 16)), np.frombuffer(bytes.fromhex(spans), ">u4").astype(np.uint64)


def _below(bounds: list[int], value: Column, strictly: bool) -> Column:
    """How many of the ascending bounds are below a value (or not above it), by bisection inside one expression."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds)
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])

    def go(at: Column, step: Column) -> Column:
        bound = F.get(table, at + step - 1)
        return F.when(bound < value if strictly else bound <= value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def with_next(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Rows (part, last, doc_id, text) in which each part holds a run of ascending doc_id, sorted, and after it (last = 1) the first
    document of the next run, so that every document's successor follows it. The texts move in one shuffle. A doc_id so frequent that it
    spans several parts is dealt to them by its texts' hashes."""
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    cuts = documents.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = [int(x) for x in cuts] if n > 1 and cuts else []
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumns({"key": key, "hash": F.xxhash64("text")})
    below, upto = _below(bounds, F.col("key"), True), _below(bounds, F.col("key"), False)
    share = (F.col("hash") / 2.0**64 + 0.5) * (F.col("upto") - F.col("below"))
    rows = rows.withColumns({"below": below, "upto": upto})
    dealt = F.when(F.col("upto") > F.col("below"), F.least(F.col("below") + 1 + F.floor(share), F.col("upto"))).otherwise(F.col("upto"))
    rows = rows.select("doc_id", "text", "key", "hash", dealt.cast("int").alias("part"))

    # One row for each part, as many as there are partitions.
    firsts = sorted((r.part, r.x.key, r.x.no_id, r.x.hash) for r in rows.groupBy("part").agg(F.min(F.struct("key", F.col("doc_id").isNotNull().alias("no_id"), "hash")).alias("x")).collect())
    copies = [(key_, not known, hash_, firsts[k - 1][0]) for k, (_, key_, known, hash_) in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(copies, "c_key long, c_null boolean, c_hash long, copy int"))
    rows = rows.join(table, (F.col("key") == F.col("c_key")) & (F.col("doc_id").isNull() == F.col("c_null")) & (F.col("hash") == F.col("c_hash")), "left")
    one = F.struct(F.col("part"), F.lit(0).alias("last"))
    two = F.struct(F.col("copy").alias("part"), F.lit(1).alias("last"))
    rows = rows.select("doc_id", "text", "key", "hash", F.explode(F.when(F.col("copy").isNotNull(), F.array(one, two)).otherwise(F.array(one))).alias("x"))
    rows = rows.select("x.part", "x.last", "doc_id", "text", "key", "hash")
    moved = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "last", "key", F.col("doc_id").isNotNull(), "hash", "text")
    return moved.select("part", "last", "doc_id", "text")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = None
    for batch in batches:
        out: list[list] = [[] for _ in types]
        for part, last, doc, text in zip(*(batch.column(k) for k in range(4))):
            part, last, doc, text = part.as_py(), last.as_py(), doc.as_py(), text.as_py()
            if held is not None and held[0] == part and held[1] == 0:
                _, _, before, old, own = held
                now = own if text == old else PrefixHashes(text)
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                other = own if edited == old else PrefixHashes.joined(own, own.n - half, now, min(half, now.n))
                same = written(sketch(own))
                row = (before, own.n, hashlib.sha256(edited.encode()).hexdigest(), same, same if other is own else written(sketch(other)), likeness(own, other), likeness(own, now))
                for column, value in zip(out, row):
                    column.append(value)
            elif last == 0:
                now = PrefixHashes(text)
            else:
                continue
            held = (part, last, doc, text, now)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its edited text (the last half replaced by the next document's beginning), and the
    likeness of its fingerprint to the edited text's and to the next document's."""
    small_batches(spark)
    return with_next(spark, documents).mapInArrow(_pairs, _SCHEMA)
