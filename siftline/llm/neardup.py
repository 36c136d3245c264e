"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles. Its sketch has REGISTERS registers; each element deals exponentially
distributed values to them, a register keeps the smallest, truncated to a power of BASE, so that sketches of parts merge by
maximum and equal registers tell of common elements. Bands of register values propose pairs, the joint likelihood of
the register comparisons estimates their similarity, and the full sets confirm every link.

Pairs are never listed group by group. Documents with equal sets are one class first. Of a bucket, each class is paired
with the smallest one; only buckets that still hold several components are searched again, where every two nodes of different
components that no earlier bucket has compared are. A task compares blocks of a bounded number of nodes, and what it lists
are links that join two components. So no link that a bucket proposes is lost.

Texts without words, empty or null texts have an empty set and are linked with nothing. Texts of fewer than five words have
one shingle, the whole sequence. Rows with the same doc_id count as one document in links; each row gets a result row.
A null doc_id can't be a smallest id: its row is linked with equal sets only, and kept. An empty table gives an empty result.
Only doc_id and text are read by `link_documents`; `drop_near_duplicates` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._shared import bounded, drop_path, fresh_path, partitions, settle, small_batches, text_of

SHINGLE = 5
SIMILAR = (85, 100)
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
TOP = 65535
#: Estimates this far below the limit are not confirmed: over five standard deviations of REGISTERS registers.
MARGIN = 0.15
BLOCK = 512
#: A worker keeps so many words' hashes.
MOST_WORDS = 250_000
#: So many characters of texts are shingled and sketched at once.
AT_ONCE = 250_000
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Words' 63-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1
        return h


_WORDS = _Words()


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = _mix(out + h[k : k + len(out)] + _U(k + 1))
    return _mix(out + _U(width))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles, as unsigned 64-bit numbers; all texts' words are hashed in one go."""
    words = [text.encode().translate(_LOWER).split() if text else [] for text in texts]
    stops = np.cumsum([0, *map(len, words)])
    h = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), np.int64, stops[-1]).view(np.uint64)
    runs = _combined(h, width)
    out = []
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
        n = b - a
        out.append(np.unique(runs[a : b - width + 1]) if n >= width else _combined(h[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles."""
    return shingle_sets([text], width)[0]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, as unsigned 16-bit numbers; 0 for empty sets."""
    m = REGISTERS
    values = np.full(len(sets) * m, np.inf)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    arrival = np.zeros(len(items))
    drawn = 0
    while len(items):
        # An element's values arrive in ascending order, at registers drawn with replacement; those later than all of a set's registers don't
        # matter. The few elements that go on for long, those of small sets, draw many values at once.
        many = 1 if drawn < 4 else 8 if drawn < 36 else 64
        seeds = (np.arange(drawn + 1, drawn + 1 + many, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]
        drawn += many
        h = _mix(items[:, None] + seeds)
        steps = -np.log(((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / (m * RATE)
        times = arrival[:, None] + np.cumsum(steps, axis=1)
        register = ((_mix(h) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        np.minimum.at(values, ((row * m)[:, None] + register).ravel(), times.ravel())
        going = times[:, -1] < values.reshape(-1, m).max(1)[row]
        items, row, arrival = items[going], row[going], times[going, -1]
    level = np.floor(1 - np.log(np.where(np.isinf(values), 1e9, values)) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16).reshape(-1, m)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The registers of two sets' union."""
    return np.maximum(one, other)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sketches: the maximum of the joint likelihood of larger, smaller and equal registers over a grid."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(grid)), score.argmax(1)]


def _band_keys(registers: np.ndarray) -> np.ndarray:
    grouped = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), grouped.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key + grouped[:, :, k] + _U(1))
    return key.view(np.int64)


def _few(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in pieces of AT_ONCE characters or so, or one text that has more, with their texts (the second column)."""
    texts, first = batch.column(1), 0
    while first < batch.num_rows:
        few, size = [], 0
        while first + len(few) < batch.num_rows and size < AT_ONCE:
            few.append(texts[first + len(few)].as_py())
            size += len(few[-1] or "")
        yield batch.slice(first, len(few)), few
        first += len(few)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "set_id", "registers", "bands"]
    for batch in batches:
        for rows, texts in _few(batch):
            sets = shingle_sets(texts)
            registers = sketch(sets)
            set_ids = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            bands = [row.tolist() if len(s) else None for row, s in zip(_band_keys(registers), sets)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids, pa.string()), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch and full set of documents that share a bucket with others."""
    for batch in batches:
        for rows, texts in _few(batch):
            sets = shingle_sets(texts)
            registers = sketch(sets)
            columns = [rows.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array([k.tobytes() for k in _band_keys(registers)], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "registers", "keys", "members"])


def _confirmed(batches: Iterator[pa.RecordBatch], limit: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    part, whole = limit
    for batch in batches:
        keep = []
        for one, other in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            place = np.searchsorted(large, small)
            both = int((large[np.minimum(place, len(large) - 1)] == small).sum()) if len(small) else 0
            keep.append(bool(both) and whole * both >= part * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])


def _likely(batches: Iterator[pa.RecordBatch], limit: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    least = limit[0] / limit[1] - MARGIN
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
        sizes = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3)]
        keep = estimate(regs[0], regs[1], *sizes) >= least
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each other set are in the first; both sorted."""
    if not len(one):
        return np.zeros(len(others), np.int64)
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[place] == flat).astype(np.int64), np.cumsum([0, *(len(x) for x in others[:-1])]))


def _links(group: dict[str, np.ndarray], members: list, within: bool, limit: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between different components in a bucket (or between two blocks of a large one), one for each two components: the sketches'
    estimate chooses whom to compare, the full sets decide. Two nodes are compared in the first bucket that they share, and not
    again once their components are known to be linked."""
    part, whole = limit
    least = part / whole - MARGIN
    node, label, block, n = (group[k] for k in ("node", "label", "block", "n"))
    registers, keys = group["registers"], group["keys"]
    band = int(np.argmax(keys[0] == group["band"][0]))
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    out = []
    for i in range(len(node) - 1):
        ok = (label[i + 1 :] != label[i]) & (np.minimum(n[i + 1 :], n[i]) * whole >= np.maximum(n[i + 1 :], n[i]) * part)
        if not within:
            ok &= block[i + 1 :] != block[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
        if len(j):
            j = j[(registers[j] == registers[i]).mean(1) >= least - 0.05]
        if len(j):
            j = j[estimate(np.broadcast_to(registers[i], (len(j), REGISTERS)), registers[j], np.full(len(j), float(n[i])), n[j].astype(float)) >= least]
        mine = root(int(label[i]))
        j = np.array([x for x in j.tolist() if root(int(label[x])) != mine], np.int64)
        if not len(j):
            continue
        both = _common(np.frombuffer(members[i], np.uint64), [np.frombuffer(members[x], np.uint64) for x in j.tolist()])
        for x in j[whole * both >= part * (n[i] + n[j] - both)].tolist():
            other, mine = root(int(label[x])), root(int(label[i]))
            if other != mine:
                joined[max(other, mine)] = min(other, mine)
                out.append((int(min(node[i], node[x])), int(max(node[i], node[x]))))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by bucket and pair of blocks, in tables of whole such groups. What is held of an open group is not copied
    until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.concatenate([held[-1].column(k).to_numpy()[-1:], batch.column(k).to_numpy()]) if held else batch.column(k).to_numpy() for k in ("band", "low", "high")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + (0 if held else 1)
        if len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _across(batches: Iterator[pa.RecordBatch], limit: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The links of each group, of 2 * BLOCK rows or so."""
    for table in _groups(batches):
        keys = [table.column(k).to_numpy() for k in ("band", "low", "high")]
        bounds = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), table.num_rows]
        columns = {k: table.column(k).to_numpy() for k in ("band", "node", "label", "block", "n")}
        columns["registers"] = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        columns["keys"] = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
        members = [x.as_buffer() for x in table.column("members")]
        links: set[tuple[int, int]] = set()
        for a, b in zip(bounds[:-1], bounds[1:]):
            links.update(_links({k: v[a:b] for k, v in columns.items()}, members[a:b], keys[1][a] == keys[2][a], limit))
        rows = sorted(links)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that the edges (a, b) reach. Each round hooks trees onto smaller parents and halves paths;
    labels are settled every round, and only joins and minima by key are used, so large groups are no single task's work."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    touched = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")).select(F.col("u").alias("node"), "p")
    path = fresh_path(spark, "labels")
    labels = settle(spark, touched, "labels", path)
    while True:
        parent = labels.select(F.col("node").alias("p"), F.col("p").alias("g"))
        step = labels.join(parent, "p").select("node", "p", "g")
        near = both.join(step.select(F.col("node").alias("v"), F.col("g").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        joined = step.join(near, step["node"] == near["u"])
        offers = joined.select(F.explode(F.array(F.struct("node", F.least("p", "g", "near").alias("p")), F.struct(F.col("p").alias("node"), F.least("g", "near").alias("p")))).alias("x")).select("x.*")
        next_path = fresh_path(spark, "labels")
        new = settle(spark, offers.groupBy("node").agg(F.min("p").alias("p")), "labels", next_path)
        changed = new.join(labels.withColumnRenamed("p", "was"), "node").filter("p <> was").limit(1).count()
        labels, old, path = new, path, next_path
        drop_path(spark, old)
        if not changed:
            break
    alone = nodes.join(labels, "node", "left").select("node", F.coalesce("p", "node").alias("label"))
    return alone


def link_documents(spark: SparkSession, documents: DataFrame, limit: tuple[int, int] = SIMILAR) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach. Sets of a similarity of limit[0] / limit[1] or more
    are linked; bands miss a pair at 0.8 with a probability of about 3e-6, and more below."""
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sketched = settle(spark, rows.mapInArrow(_sketches, "doc_id long, n long, set_id string, registers binary, bands array<long>"), "sketches")
    class_of = sketched.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"))
    class_of = settle(spark, class_of, "classes")

    # One row for each class; a doc_id with two different texts gives two, which stand for the same node.
    heads = sketched.select(F.col("doc_id").alias("node"), "n", "set_id", "registers", "bands").join(class_of, ["set_id", "node"], "left_semi")
    narrow = heads.select("node", F.explode("bands").alias("band"))
    shared = narrow.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    crowded = settle(spark, narrow.join(shared.select("band", "least"), "band").dropDuplicates(["band", "node"]), "buckets")

    # First each class with the two smallest-in-bucket classes that it shares most buckets with.
    stars = crowded.filter("node <> least").groupBy("node", "least").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("node").orderBy(F.desc("shared"), "least")
    pairs = stars.withColumn("k", F.row_number().over(best)).filter("k <= 2").select(F.col("least").alias("a"), F.col("node").alias("b"))

    wanted = settle(spark, crowded.select("node").distinct(), "members")
    heads_text = rows.join(bounded(wanted.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")
    kept = settle(spark, heads_text.mapInArrow(_whole, "node long, n long, registers binary, keys binary, members binary"), "candidates")
    one, two = (kept.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}")) for k in "ab")
    likely = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(partial(_likely, limit=limit), "a long, b long")
    one, two = (kept.select(F.col("node").alias(k), F.col("members").alias(f"m_{k}")) for k in "ab")
    confirmed = likely.join(one, "a").join(two, "b").select("a", "b", "m_a", "m_b").mapInArrow(partial(_confirmed, limit=limit), "a long, b long, linked boolean")
    edges = settle(spark, confirmed.filter("linked").select("a", "b"), "edges")
    labels = settle(spark, components(spark, wanted, edges), "components")

    # Then the buckets that still hold several components, with the full sets.
    inside = crowded.join(labels, "node").select("band", "node", "label")
    mixed = inside.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low < high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_rows = inside.join(mixed.select("band", "size"), "band").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = open_rows.select("band", "node", "label", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).join(kept, "node")
    dealt = dealt.select("band", "low", "high", "node", "label", "block", "n", "registers", "keys", "members").repartition(partitions(spark), "band", "low", "high").sortWithinPartitions("band", "low", "high")
    more = settle(spark, dealt.mapInArrow(partial(_across, limit=limit), "a long, b long"), "more-edges")
    if more.limit(1).count():
        labels = components(spark, wanted, edges.unionByName(more).distinct())

    named = class_of.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("label"))
    result = sketched.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(named, "set_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def drop_near_duplicates(spark: SparkSession, documents: DataFrame, limit: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents, all columns, with one document of each group: that with the smallest doc_id. Rows that repeat its doc_id are the same document and stay."""
    linked = link_documents(spark, documents, limit)
    drop = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = documents.join(bounded(settle(spark, drop, "gone")), documents["doc_id"] == F.col("_gone"), "left_anti")
    return kept
