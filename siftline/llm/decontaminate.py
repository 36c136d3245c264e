"""Benchmark decontamination by training suffix arrays.

Documents are split into shards of whole documents (a shard is a run of rows that one task reads, of SHARD_WORDS words or so). A
shard's suffix array sorts its word suffixes by their first `window` words; suffixes that begin as no test suffix does, by their first
two words, or that meet an unknown word too soon, are left out. Every test suffix whose beginning the shard has is then searched for by
bisection, all of them at once, which gives all places where it occurs for a window. Places that follow each other on both sides
are one longest verbatim match, with its location in the item and in the document; hits, items and removals come from these matches.

A window is `window` consecutive words of an item, or the whole item if it has fewer (but some) words. A document word inside any
occurrence of a window is hit; a document is contaminated when it has a hit and 20 * n_hit >= n_words.

Null or empty texts have no words, on either side, and are never contaminated. Repeated items with one id count once; an item with a
null id hits words but is no entry of the list of items. Repeated documents each get a row. Empty tables give an empty result
or no hits. Only doc_id, text and item_id, text are read. Texts of any length are searched whole; memory is linear in the longest.

The benchmark may have any size: it is read once, in parts of PART_WORDS words, which are written to the shared folder with the
vocabulary of all its words. A worker holds that vocabulary and one part at a time, and searches each shard for all parts.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._shared import fresh_path, small_batches, text_of, through_arrow

WINDOW = 13
SHARD_WORDS = 2_000_000
SHARD_BYTES = 48 << 20
PART_WORDS = 1_000_000

#: Bytes as words see them: A-Z in lower case, digits, a-z and all bytes from 0x80 on stay, the rest is a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text, as UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


@dataclass
class TestPart:
    """A part of the benchmark: its texts as word numbers, from 1 on, in one array with a 0 after each item, and its different windows in
    order of their words. Window g stands at starts[g], has lengths[g] words, and occurs at places[bounds[g] : bounds[g + 1]]."""

    __test__ = False

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    places: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    ids: list[str | None]
    pairs: np.ndarray
    singles: np.ndarray

    def item_at(self, places: np.ndarray) -> np.ndarray:
        """The number of the item in which each place stands."""
        return np.searchsorted(self.items, places, side="right") - 1


def _pair(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first two words from each start as one number."""
    return words[starts].astype(np.int64) << 32 | words[starts + 1]


def test_part(items: list[tuple[str | None, list[int]]], window: int) -> TestPart:
    """The part that some items, as (id, word numbers), make."""
    size = np.array([len(w) for _, w in items], np.int64)
    begins = np.cumsum(size + 1) - size - 1
    words = np.zeros(int((size + 1).sum()) + window, np.int32)
    for at, (_, own) in zip(begins.tolist(), items):
        words[at : at + len(own)] = own
    length = np.minimum(size, window)
    count = size - length + 1
    owner = np.repeat(np.arange(len(items)), count)
    places = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begins[owner]
    lengths = length[owner]
    columns = [np.where(k < lengths, words[places + k], 0) for k in range(window)]
    order = np.lexsort(columns[::-1]) if len(places) else np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    first = np.flatnonzero(new)
    starts, lengths = places[order[first]], lengths[order[first]]
    return TestPart(words, starts, lengths, places[order], np.append(first, len(order)), begins, [i for i, _ in items], np.unique(_pair(words, starts[lengths > 1])), np.unique(words[starts[lengths == 1]]))


class SuffixArray:
    """The word suffixes of one shard, sorted by their first `depth` words; 0 stands for any word that no test text has, and ends each
    document. Of the suffixes whose first `shortest` words are known, those that a filter (by their starts) accepts are in it."""

    def __init__(self, words: np.ndarray, depth: int, shortest: int, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        known = words[::-1] != 0
        places = np.arange(len(words))
        # How many words from here to the right are known, from the last place to the first.
        run = (places - np.maximum.accumulate(np.where(known, -1, places)))[::-1]
        start = np.flatnonzero(run >= shortest)
        self._padded = padded = np.concatenate([words, np.zeros(depth + 1, np.int32)])
        if accept is not None:
            start = start[accept(padded, start)]
        columns = [np.where(k < run[start], padded[start + k], 0) for k in range(depth)]
        self.order = start[np.lexsort(columns[::-1])] if len(start) else start

    def __len__(self) -> int:
        return len(self.order)

    def _order(self, at: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For the suffixes at these places of the array, -1, 0 or 1: whether each is before, among or behind the suffixes that begin
        with its pattern, the words from its start."""
        out = np.zeros(len(at), np.int8)
        open_, k = np.arange(len(at)), 0
        while len(open_):
            found, asked = self._padded[self.order[at[open_]] + k], words[starts[open_] + k]
            out[open_] = np.sign(found.astype(np.int64) - asked)
            k += 1
            open_ = open_[(found == asked) & (lengths[open_] > k)]
        return out

    def ranges(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the array the suffixes begin and end that start with each pattern, by bisection for all patterns at once."""
        ends = []
        for above in (False, True):
            low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                side = self._order(middle, words, starts[open_], lengths[open_])
                right = side <= 0 if above else side < 0
                low[open_] = np.where(right, middle + 1, low[open_])
                high[open_] = np.where(right, high[open_], middle)
            ends.append(low)
        return ends[0], ends[1]

    def places(self, pattern: tuple[int, ...]) -> np.ndarray:
        """Where the words of one pattern stand."""
        low, high = self.ranges(np.array(pattern, np.int32), np.zeros(1, np.int64), np.array([len(pattern)]))
        return self.order[low[0] : high[0]]


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and of which range each is."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size), of


def matches(part: TestPart, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest verbatim matches of a shard with a part of the benchmark: where each begins among the test words and in the shard,
    and its length."""

    def begins(padded: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.isin(_pair(padded, start), part.pairs) | np.isin(padded[start], part.singles)

    array = SuffixArray(words, window, int(part.lengths.min(initial=window)), begins)
    here = np.unique(_pair(array._padded, array.order))
    asked = np.flatnonzero(np.isin(_pair(part.words, part.starts), here) | (part.lengths == 1)) if len(array) else np.zeros(0, np.int64)
    low, high = array.ranges(part.words, part.starts[asked], part.lengths[asked])
    at, of = _expanded(low, high)
    places, group = array.order[at], asked[of]
    # Each occurrence in the shard against each in the benchmark; those that follow each other on both sides are one match.
    at, of = _expanded(part.bounds[group], part.bounds[group + 1])
    test, places, length = part.places[at], places[of], part.lengths[group[of]]
    order = np.lexsort((places, test - places))
    test, places, length = test[order], places[order], length[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(test) != 1) | (np.diff(places) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return test[first], places[first], test[last] + length[last] - test[first] if len(first) else length


@dataclass
class Tests:
    """Where the vocabulary and the parts of the benchmark are written."""

    __test__ = False

    vocabulary: str
    parts: list[str]
    window: int


def _save(path: str, value: object) -> str:
    store, place = pafs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(pickle.dumps(value, protocol=5))
    return path


def _load(path: str):
    store, place = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(place) as file:
        return pickle.loads(file.read())


@lru_cache(1)
def _vocabulary(path: str) -> dict[bytes, int]:
    return {w: k + 1 for k, w in enumerate(_load(path).split())}


@lru_cache(1)
def _part(path: str) -> TestPart:
    """A worker holds one part at a time; of a benchmark of several parts, each is read again for each shard."""
    return _load(path)


def _test_set(spark: SparkSession, benchmark: DataFrame, window: int) -> Tests:
    """Write the query set to the shared folder, part by part."""
    small_batches(spark)
    folder = fresh_path(spark, "benchmark")
    numbers: dict[bytes, int] = {}
    parts: list[str] = []
    held: list[tuple[str | None, list[int]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            parts.append(_save(f"{folder}/part-{len(parts)}", test_part(held, window)))
            held.clear()
            size = 0

    for item, text in benchmark.select(F.col("item_id").cast("string"), text_of()).toLocalIterator():
        words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        if words:
            held.append((item, words))
            size += len(words)
            if size >= PART_WORDS:
                flush()
    flush()
    return Tests(_save(f"{folder}/vocabulary", b" ".join(numbers)), parts, window)


def _shards(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int], whole_rows: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Runs of whole documents, over batches, of SHARD_WORDS words (or SHARD_BYTES of rows) or the document that exceeds them: their rows
    (or the first column alone), where each starts, and word numbers with a 0 after each document."""
    get = numbers.get
    rows, sizes, parts, at, held = [], [], [], 0, 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        own = batch if whole_rows else batch.select([0])
        first = 0
        for k, text in enumerate(texts):
            text = text.as_py()
            words = words_of(text)
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            sizes.append(len(words))
            at += len(words)
            held += len(text) if text and whole_rows else 8
            if at >= SHARD_WORDS or held >= SHARD_BYTES:
                rows.append(own.slice(first, k + 1 - first))
                yield _shard(rows, sizes, parts)
                rows, sizes, parts, at, held, first = [], [], [], 0, 0, k + 1
        if first < batch.num_rows:
            rows.append(own.slice(first))
    if rows:
        yield _shard(rows, sizes, parts)


def _shard(rows: list[pa.RecordBatch], sizes: list[int], parts: list[np.ndarray]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    words = np.zeros(int(starts[-1]), np.int32)
    for at, own in zip(starts.tolist(), parts):
        words[at : at + len(own)] = own
    return pa.Table.from_batches(rows), starts, words


def _judged(tests: Tests, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str | None]]]:
    """Of each document of a shard: its words, its hit words, and the ids of the items found in it."""
    cover = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str | None]] = defaultdict(set)
    for path in tests.parts:
        part = _part(path)
        test, places, length = matches(part, words, tests.window)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + length, -1)
        found = (np.searchsorted(starts, places, side="right") - 1) * len(part.ids) + part.item_at(test)
        for doc, item in zip(*(x.tolist() for x in np.divmod(np.unique(found), max(1, len(part.ids))))):
            items[doc].add(part.ids[item])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return np.diff(starts) - 1, hit[starts[1:]] - hit[starts[:-1]], items


def _marks(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, words in _shards(batches, _vocabulary(tests.vocabulary), False):
            n_words, n_hit, items = _judged(tests, starts, words)
            found = [items.get(k, ()) for k in range(rows.num_rows)]
            names = [sorted(x for x in one if x is not None) for one in found]
            columns = [rows.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(one) for one in found], pa.int64()), pa.array(names, pa.list_(pa.string()))]
            yield from pa.Table.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items"]).to_batches()

    return run


def _clean(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, words in _shards(batches, _vocabulary(tests.vocabulary), True):
            n_words, n_hit, _ = _judged(tests, starts, words)
            yield from rows.filter(pa.array((n_hit == 0) | (20 * n_hit < n_words))).to_batches()

    return run


def _locations(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, words in _shards(batches, _vocabulary(tests.vocabulary), False):
            for path in tests.parts:
                part = _part(path)
                test, places, length = matches(part, words, tests.window)
                item, doc = part.item_at(test), np.searchsorted(starts, places, side="right") - 1
                names = pa.array([part.ids[k] for k in item.tolist()], pa.string())
                columns = [names, pa.array(test - part.items[item]), pa.array(length, pa.int64()), docs.column(0).take(pa.array(doc)), pa.array(places - starts[doc])]
                yield from pa.Table.from_arrays(columns, names=["item_id", "item_word", "n_words", "doc_id", "doc_word"]).to_batches()

    return run


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def mark_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted ids of the items found) and contaminated."""
    tests = _test_set(spark, benchmark, window)
    marked = _rows(documents).mapInArrow(_marks(tests), "doc_id long, n_words long, n_hit long, n_items long, items array<string>")
    return marked.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def longest_matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches of a window and more: item_id, item_word, n_words, doc_id, doc_word (words count from 0)."""
    tests = _test_set(spark, benchmark, window)
    return _rows(documents).mapInArrow(_locations(tests), "item_id string, item_word long, n_words long, doc_id long, doc_word long")


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without the contaminated rows; no row moves."""
    return through_arrow(documents, _clean(_test_set(spark, benchmark, window)))
