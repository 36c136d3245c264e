"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into BLOCKS blocks by a hash of doc_id. A source's target is filled with whole passes over its blocks and,
for the rest, with blocks in a permuted order until the target; the block on the limit is refined by sub-blocks, and the sub-block that comes nearest to what is still missing is added. Each
(pass, block) is a draw. The tree halves the set of all draws again and again, each half a uniformly random one, so that the numbers
of each source's draws that a node gets are multivariate-hypergeometric; the leaves are the output shards' quotas. A shard then
takes as many draws of a source as its quota says, the next ones in the source's permuted order, so draws are disjoint, and orders
its rows by a hash. A source misses its target by less than its smallest sub-block that could still be added, that is by some
1 / BLOCKS^2 of its words or by a document's, whichever is more.

Plans are tables by source and block, of at most 3 * BLOCKS rows a source, whatever the number of documents; documents are joined
to them and move only to be put in order. Sums over all sources or draws are made in one task if these are counted to be few, and else by
ranges. All choices are hashes of ids and a seed, so reruns agree.

Null or empty texts have size 0 and are taken 0 times when their source has none; a null source is a source of its own, last in
order. Repeated rows are taken alike. A null doc_id hashes like the text "null". An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._shared import ONE_TASK, bounded, partitions, running, settle, text_of

BLOCKS = 256
SHARDS_LOG2 = 4
MOST = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 11
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words that white space of ASCII separates."""
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def _hash(*parts) -> Column:
    """A hash of columns (by name) and literals, the same on every run, as a hexadecimal string."""
    return F.md5(F.concat_ws("/", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _two_digits(digest: Column, at: int) -> Column:
    """A number from 0 to 255 from two of a digest's digits."""
    return F.conv(F.substring(digest, at, 2), 16, 10).cast("int")


def targets(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for (source, source_size): weights repeat over the sources in order, null last, and share the sum of
    all sizes; a target stops at MOST times its source's size, and the excess is shared again by weight until none is above."""
    ranked = running(spark, sizes.withColumn("one", F.lit(1)), [F.asc_nulls_last("source")], "one", "turn").drop("one", "turn_total")
    weight = F.element_at(F.lit(list(WEIGHTS)), (F.col("turn") % len(WEIGHTS) + 1).cast("int"))
    rows = settle(spark, ranked.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("limit")), "sources")
    # Once a source's share is above its limit it stays so, as what the others leave only grows.
    level, stopped = 0.0, -1
    while True:
        stops = F.col("weight") * F.lit(level) > F.col("limit")
        free = F.when(~stops, F.col("weight"))
        total, spent, whole, now = rows.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("limit"))), F.sum(free), F.sum(stops.cast("int"))).first()
        if not whole or now == stopped:
            break
        level, stopped = (total - (spent or 0.0)) / whole, now
    return rows.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(level)).alias("target"))


def _fill(rows: DataFrame, keys: list[str], need: str, size: str, tag: str) -> DataFrame:
    """Of blocks in permuted order within keys, those that alone are more than `need` last: which are taken whole before it is full, and which
    one is on the limit."""
    order = Window.partitionBy(*keys).orderBy(F.col(size) > F.col(need), _hash(SEED, F.lit(tag), "source", *[k for k in keys if k != "source"], "part"), "part")
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto", upto).withColumn("place", F.row_number().over(order))
    return rows.withColumns({"whole": F.col("upto") <= F.col(need), "edge": (F.col("upto") > F.col(need)) & (F.col("upto") - F.col(size) < F.col(need)), "left": F.col(need) - (F.col("upto") - F.col(size))})


def plan(spark: SparkSession, sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (source, part, sub, size): the draws (source, pass, part, sub, shard), where sub is null if all of a block is drawn, and the
    sources' targets."""
    sums = settle(spark, sized.groupBy("source", "part", "sub").agg(F.sum("size").alias("size")), "block-sizes")
    goals = settle(spark, targets(spark, sums.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    parts = sums.groupBy("source", "part").agg(F.sum("size").alias("size"))

    def with_goal(rows: DataFrame) -> DataFrame:
        return rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select(rows["*"], goals["source_size"], goals["target"])

    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    parts = with_goal(parts).withColumn("passes", full).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    filled = settle(spark, _fill(parts, ["source"], "need", "size", "part"), "filled")
    whole = filled.select("source", F.explode(F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(F.expr("array()").cast("array<int>"))).alias("pass"), "part", F.lit(None).cast("int").alias("sub"))
    rest = filled.filter("whole and size > 0").select("source", (F.col("passes") + 1).alias("pass"), "part", F.lit(None).cast("int").alias("sub"))

    # The block on the limit, by its sub-blocks: those that fit whole.
    edge = filled.filter("edge").select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("passes"), F.col("left").alias("still"))
    inner = sums.join(edge, sums["source"].eqNullSafe(edge["s"]) & (sums["part"] == edge["p"])).select("source", F.col("part").alias("block"), F.col("sub").alias("part"), "size", "passes", "still")
    inner = _fill(inner, ["source", "block"], "still", "size", "sub").filter("whole and size > 0")
    pieces = settle(spark, inner.select("source", (F.col("passes") + 1).alias("pass"), F.col("block").alias("part"), F.col("part").alias("sub"), "size"), "pieces")
    # And of the sub-blocks that are not taken in this pass, the one that comes nearest to what is still missing, if it helps.
    spent = pieces.groupBy("source").agg(F.sum("size").alias("spent")).withColumnRenamed("source", "sp")
    missing = edge.join(spent, edge["s"].eqNullSafe(spent["sp"]), "left").select("s", "passes", (F.col("still") - F.coalesce("spent", F.lit(0))).alias("missing"))
    open_parts = filled.filter("not whole").select(F.col("source").alias("o"), F.col("part").alias("op"))
    free = sums.join(open_parts, sums["source"].eqNullSafe(open_parts["o"]) & (sums["part"] == open_parts["op"]), "left_semi")
    free = free.join(pieces.select(F.col("source").alias("t"), F.col("part").alias("tp"), F.col("sub").alias("ts")), free["source"].eqNullSafe(F.col("t")) & (free["part"] == F.col("tp")) & (free["sub"] == F.col("ts")), "left_anti")
    free = free.join(missing, free["source"].eqNullSafe(missing["s"])).withColumn("off", F.abs(F.col("size") - F.col("missing"))).filter("size > 0 and off < missing")
    last = free.groupBy("source").agg(F.min(F.struct("off", "part", "sub", "passes")).alias("x")).select("source", (F.col("x.passes") + 1).alias("pass"), "x.part", "x.sub")
    draws = settle(spark, whole.unionByName(rest).unionByName(pieces.drop("size")).unionByName(last), "draws")
    # A block's pieces stay together in the tree.
    units = settle(spark, draws.select("source", "pass", "part").distinct().withColumns({"node": F.lit(0), "one": F.lit(1)}), "units")
    small = units.limit(ONE_TASK + 1).count() <= ONE_TASK
    for level in range(SHARDS_LOG2):
        # A node's units in random order: their places among all, less those before the node's first.
        order = [F.col("node"), _hash(SEED, F.lit("tree"), level, "source", "pass", "part"), F.asc_nulls_last("source"), F.col("pass"), F.col("part")]
        placed = running(spark, units, order, "one", "place", small).drop("place_total")
        count = placed.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("count"), F.min("place").alias("first"))
        # Which of two odd halves is larger is a coin by node.
        coin = F.pmod(F.crc32(F.concat_ws("/", F.lit(f"{SEED}/{level}"), "node").cast("binary")), F.lit(2))
        half = F.floor((F.col("count") + coin) / 2)
        placed = placed.join(F.broadcast(count), F.col("node") == F.col("of"))
        placed = placed.withColumn("node", F.col("node") * 2 + (F.col("place") - F.col("first") >= half).cast("int")).select("source", "pass", "part", "node", "one")
        units = settle(spark, placed, "units")
    units = units.drop("one")
    quotas = units.groupBy("source", "node").agg(F.count("*").alias("quota"))
    upto = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = quotas.withColumn("last", F.sum("quota").over(upto)).withColumn("first", F.col("last") - F.col("quota") + 1).withColumnRenamed("source", "q_source")
    turn = Window.partitionBy("source").orderBy(_hash(SEED, F.lit("turn"), "source", "pass", "part"), "pass", "part")
    units = units.drop("node").withColumn("turn", F.row_number().over(turn))
    dealt = units.join(quotas, units["source"].eqNullSafe(quotas["q_source"]) & (units["turn"] >= quotas["first"]) & (units["turn"] <= quotas["last"])).select("source", "pass", "part", F.col("node").alias("shard"))
    same = draws["source"].eqNullSafe(dealt["source"]) & (draws["pass"] == dealt["pass"]) & (draws["part"] == dealt["part"])
    return draws.join(dealt, same).select(draws["*"], dealt["shard"]), goals


def sized_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and the block and sub-block of each row."""
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_of()).alias("size"))
    rows = rows.withColumn("digest", _hash(SEED, F.lit("block"), "doc_id"))
    return rows.select("doc_id", "source", "size", _two_digits(F.col("digest"), 1).alias("part"), _two_digits(F.col("digest"), 3).alias("sub"))


def _by_block(draws: DataFrame) -> DataFrame:
    """One row for each source and block: its draws, as an array of at most 3 * 256 entries."""
    one = draws.groupBy("source", "part").agg(F.collect_list(F.struct("pass", "sub", "shard")).alias("draws"))
    return one.select(F.coalesce("source", F.lit("")).alias("d_source"), F.col("source").isNull().alias("d_null"), F.col("part").alias("d_part"), "draws")


def _draws_of(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """The rows with their own draws, null if none. No row moves if the table of draws, of BLOCKS rows a source, is counted to be small."""
    keyed = rows.withColumns({"k_source": F.coalesce("source", F.lit("")), "k_null": F.col("source").isNull()})
    joined = keyed.join(bounded(draws), (F.col("k_source") == F.col("d_source")) & (F.col("k_null") == F.col("d_null")) & (F.col("part") == F.col("d_part")), "left")
    own = F.filter("draws", lambda d: d["sub"].isNull() | (d["sub"] == F.col("sub")))
    return joined.withColumn("own", own).drop("k_source", "k_null", "d_source", "d_null", "d_part", "draws")


def taken_words(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken (its size times its draws), and the shards it goes to."""
    sized = settle(spark, sized_documents(documents), "sized")
    draws, goals = plan(spark, sized)
    drawn = _draws_of(sized, settle(spark, _by_block(draws), "dealt"))
    goal = bounded(goals).select(F.coalesce("source", F.lit("")).alias("g_source"), F.col("source").isNull().alias("g_null"), "source_size", "target")
    out = drawn.join(goal, (F.coalesce("source", F.lit("")) == F.col("g_source")) & (F.col("source").isNull() == F.col("g_null")))
    times = F.coalesce(F.size("own"), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.when(times > 0, times).otherwise(0)).cast("long").alias("taken"), F.array_sort(F.coalesce(F.col("own.shard"), F.expr("array()").cast("array<int>"))).alias("shards"))


def mix(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The mix: each row of documents as often as it is drawn, all columns, with mix_shard and mix_key, by which a shard's rows are ordered;
    columns of its own with these names are replaced."""
    sized = settle(spark, sized_documents(documents).drop("doc_id"), "sized")
    draws = settle(spark, _by_block(plan(spark, sized)[0]), "dealt")
    digest = _hash(SEED, F.lit("block"), "doc_id")
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").cast("string").alias("source"), _two_digits(digest, 1).alias("part"), _two_digits(digest, 3).alias("sub"), digest.alias("digest"))
    own = _draws_of(rows, draws).select("row", "digest", F.explode("own").alias("draw"))
    kept = [F.col(f"row.`{c}`") for c in names if c.lower() not in ("mix_shard", "mix_key")]
    return own.select(*kept, F.col("draw.shard").alias("mix_shard"), F.md5(F.concat_ws("/", "digest", F.col("draw.pass").cast("string"))).alias("mix_key"))


def ordered(mixed: DataFrame) -> DataFrame:
    """A mix with each shard's rows together, in local order of mix_key. A shard is a run of partitions, so that none holds more than its
    part of the shard, which is as even as the hash."""
    each = max(1, -(-partitions(mixed.sparkSession) >> SHARDS_LOG2))
    part = F.col("mix_shard") * each + F.floor(F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long") * each / (1 << 24))
    return mixed.repartitionById(each << SHARDS_LOG2, part.cast("int")).sortWithinPartitions("mix_shard", "mix_key")
