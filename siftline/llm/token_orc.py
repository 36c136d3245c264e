"""Token ids as ORC files.

Each document's text is encoded with a byte-level BPE vocabulary, the end id is appended, and rows (doc_id, ids) are written in
ascending doc_id as ORC: integer run-length encoding for the ids, a row index every INDEX_ROWS rows, and a Bloom filter on
doc_id in every stripe. Files ascend with doc_id too, so a reader takes stripes in parallel and skips those whose statistics or
Bloom filter exclude an id.

Null or empty texts have the end id only. Repeated rows are written as often as they occur, rows with the same doc_id in
order of a hash of the text, and a document's start follows the order of the files' rows; a null doc_id sorts first. An empty
table gives no documents. Texts of any length are encoded whole. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._shared import BATCH_BYTES, BATCH_ROWS, bounded, fresh_path, partitions, settle, small_batches, text_of

END_ID = 2
INDEX_ROWS = 1000
STRIPE_BYTES = 64 << 20
#: A worker keeps so many bytes of units and their ids.
CACHE_BYTES = 160 << 20
#: Longer texts are cut at safe places before they are split into units.
PIECE = 4 << 20

#: Letters and digits that every version of the character tables knows as such.
_KNOWN = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
#: Full stops and commas that belong to a longer pre-token, with other marks or with a space before them.
_MARKS = rf"[^{_KNOWN}][.,]|[.,][^{_KNOWN} \n]"
#: White space other than single blanks and up to two line ends inside a text, and the characters that mark units.
_ODD_SPACE = r"[\x01\x02\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| [ \n]|\n |\n\n\n|\n\n\z"
_SEPARATORS = re.compile(r"[\x01\x1c-\x1f]")
_RUNS = re.compile(r"\s+\S*|\S+")
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_CUT = re.compile(r"[a-z] (?=[a-z])")


def pieces_of(text: str) -> list[str]:
    """A text in pieces of PIECE characters or so, cut before single blanks between letters, where pre-tokens always end."""
    out, at = [], 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        out.append(text[at : cut.start() + 1])
        at = cut.start() + 1
    return [*out, text[at:]]


def _byte_symbols() -> str:
    """The 256 printable characters by which a byte-level vocabulary spells bytes: those that print as they are, then code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class Encoder:
    """Encodes texts as the library's whole encoding does, by units that begin at white space, or at a full stop or comma after a letter.
    Pre-tokens never cross such a place, so a unit's ids don't depend on what stands around it. A batch's different units are found
    at once; those that no batch before had are encoded in long runs. Texts for which this isn't known to hold (that have an added token,
    or a vocabulary of another kind) are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        split = config.get("pre_tokenizer") or {}
        self._added = [x["content"] for x in config.get("added_tokens") or []]
        self._line = self.whole("\n")
        self._model, self._symbols = self._all.model, dict(enumerate(_byte_symbols()))
        self._by_units = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(config.get(k) for k in ("normalizer", "truncation", "padding"))
            and not config["model"].get("dropout")
            and len(self._line) == 4
        )
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self._all.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        """The library's encoding of a whole text."""
        return self._many([text])[0]

    def _learn(self, units: list[str]) -> None:
        """Encode units that have no white space but a leading blank. A word is one pre-token, which the library's model encodes; other
        units are encoded many in one text, each on a line of its own, whose end is a pre-token and an id of its own."""
        if self._held > CACHE_BYTES // 2:
            self._units, self._older, self._held = {}, self._units, 0
        self._units.update({"\x01": b"", "\x01\n": self._line, "": self.whole(" ")})
        if self._older:
            again = {u: ids for u in units if (ids := self._older.get(u)) is not None}
            self._units.update(again)
            self._held += 270 * len(again)
            units = [u for u in units if u not in again]
        words = [u for u in units if _WORD.fullmatch(u, u[:1] == "\x01")]
        spelt = "\n".join([u[1:] if u[0] == "\x01" else " " + u for u in words]).encode().decode("latin-1").translate(self._symbols | {10: "\n"})
        model, size = self._model, 0
        for u, text in zip(words, spelt.split("\n")):
            self._units[u] = ids = array("I", [t.id for t in model.tokenize(text)]).tobytes()
            size += len(ids) + len(u)
        new = [u for u in units if u not in self._units]
        for at in range(0, len(new), 512):
            few = new[at : at + 512]
            ids = np.frombuffer(self.whole("\n".join([u[1:] if u[0] == "\x01" else " " + u for u in few])), "<u4")
            ends = [*np.flatnonzero(ids == np.frombuffer(self._line, "<u4")[0]).tolist(), len(ids)]
            if len(ends) != len(few):
                raise AssertionError("a line end is not an id of its own")
            first = 0
            for u, end in zip(few, ends):
                self._units[u] = ids[first:end].tobytes()
                first = end + 1
            size += 4 * len(ids) + sum(map(len, few))
        self._held += size + 250 * len(units)

    def _runs(self, texts: list[str]) -> list[bytes]:
        """Encodings of texts with runs of white space: units are such a run and what follows it."""
        units = [None if _SEPARATORS.search(t) else _RUNS.findall(t) for t in texts]
        names = list({u: None for own in units if own for u in own})
        known = dict(zip(names, self._many(names)))
        return [self.whole(t) if own is None else b"".join(map(known.__getitem__, own)) for t, own in zip(texts, units)]

    def encode_rows(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids stop (from 0 on) and all ids, each text's ones followed by the end id if there is one."""
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        if not self._by_units:
            return _joined([x + tail for x in self._many(texts.to_pylist())])
        rows = None
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > PIECE:
            parts = [pieces_of(t) for t in texts.to_pylist()]
            rows = np.cumsum([0, *map(len, parts)])
            texts = pa.array([p for own in parts for p in own], pa.string())
        whole = pa.array(np.zeros(len(texts), bool))
        for token in self._added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        if rows is not None:  # a piece is exact for itself, but an added token may hold a blank where a text was cut
            at = np.flatnonzero(np.add.reduceat(whole.to_numpy(zero_copy_only=False), rows[:-1])) if any(" " in t for t in self._added) else []
            if len(at):
                return _joined([x + tail for x in self._many(["".join(own) for own in parts])])
        runs = pc.and_not(pc.match_substring_regex(texts, _ODD_SPACE), whole)
        slow = {}
        for mask, encode in ((whole, self._many), (runs, self._runs)):
            where = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if len(where):
                slow.update(zip(where.tolist(), encode(texts.take(where).to_pylist())))
        plain = pc.replace_substring(texts, "\n", " \x01\n \x01")
        stops = pc.replace_substring(pc.replace_substring(plain, ",", " \x01,"), ".", " \x01.")
        plain = pc.if_else(pc.match_substring_regex(texts, _MARKS), plain, stops)
        if slow:  # such a text is a unit of its own, named by its place
            where = np.fromiter(slow, np.int64)
            names = pa.array([f"\x01S{k}" for k in slow], pa.string())
            mask = np.zeros(len(texts), bool)
            mask[where] = True
            plain = pc.replace_with_mask(plain, pa.array(mask), names.take(np.argsort(where)))
        split = pc.split_pattern(pc.binary_join_element_wise("\x01", plain, ""), " ")
        found = split.flatten().dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary), "\x02")[0].as_py().split("\x02")
        which = found.indices.to_numpy()
        extra = {f"\x01\x01S{k}": ids for k, ids in slow.items()}
        get = self._units.get
        ids = [get(u) if u[:2] != "\x01\x01" else extra[u] for u in names]
        if missing := [u for u, x in zip(names, ids) if x is None]:
            self._learn(missing)
            ids = [self._units[u] if x is None else x for u, x in zip(names, ids)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        counts = sizes[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        values = flat[np.arange(upto[-1]) + np.repeat(begins[which] - upto[:-1], counts)]
        cuts = upto[split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()]
        if rows is not None:
            cuts = cuts[rows]
        if end is not None:
            values = np.insert(values, cuts[1:], end)
            cuts = cuts + np.arange(len(cuts))
        return cuts, values

    def encode(self, text: str) -> bytes:
        """One text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_rows(pa.array([text], pa.string()))[1].astype("<u4").tobytes()


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *(len(x) // 4 for x in ids)]), np.frombuffer(b"".join(ids), "<u4")


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoding(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        # Some batches at once: the more text, the fewer of its units are different.
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size >= BATCH_BYTES):
                few = pa.concat_batches(held)
                held, size = [], 0
                stops, ids = encoder.encode_rows(few.column(1), end)
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.astype(np.int32)))
                rows = pa.RecordBatch.from_arrays([few.column(0), lists], names=["doc_id", "ids"])
                yield from (rows.slice(at, BATCH_ROWS) for at in range(0, rows.num_rows, BATCH_ROWS))

    return run


def write_tokens(spark: SparkSession, documents: DataFrame, vocabulary: str, path: str, end: int = END_ID) -> None:
    """Encode whole texts and write ORC files in ascending doc_id."""
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64("text").alias("order"))
    # The hash also parts the rows of a doc_id that is very frequent.
    rows = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "order").sortWithinPartitions(F.asc_nulls_first("doc_id"), "order", "text").select("doc_id", "text")
    encoded = rows.mapInArrow(_encoding(vocabulary, end), "doc_id long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    encoded.write.mode("overwrite").options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows (doc_id, ids); a filter on doc_id is pushed into the stripes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, upto = None, 0  # the block of a file that is being read, and how many ids of it
    for batch in batches:
        lists = batch.column("ids")
        stops, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(stops[:-1], stops[1:])]
        sizes, before = np.diff(stops).astype(np.int64), []
        for block, size in zip(zip(batch.column("file").to_pylist(), batch.column("place").to_pylist()), sizes.tolist()):
            if block != held:
                held, upto = block, 0
            before.append(upto)
            upto += size
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(crcs, pa.int64()), batch.column("file"), batch.column("place"), pa.array(before, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32", "file", "place", "before"])


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document its place in the stream of all ids, its length and a checksum of its ids."""
    rows = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("place"))
    rows = settle(spark, rows.mapInArrow(_digests, "doc_id long, n_tokens long, ids_crc32 long, file string, place long, before long"), "token-digests")
    # Two levels of running sums: inside each block of a file, which one task reads from its beginning to its end, then over the blocks (as
    # many as the read had splits).
    blocks = rows.groupBy("file", "place").agg(F.sum("n_tokens").alias("block_tokens"))
    earlier = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "file", "place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "place", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("block_start"))
    return rows.join(bounded(blocks), ["file", "place"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_path(spark: SparkSession) -> str:
    """A folder for one run's files."""
    return fresh_path(spark, "tokens")
