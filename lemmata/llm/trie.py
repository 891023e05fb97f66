"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of that sequence (128 bits: for each
turn two hashes of its place and its SHA-256, combined by exclusive or), so the edge to its parent
comes with it, and equal prefixes of different conversations meet in one key. Counts of leaves and
savings reach all ancestors in rounds of doubling: in round r a node hands its sums to the ancestor
2^r above it and then takes over that ancestor's pointer, so the rounds follow the logarithm of the
longest conversation. A node leaves the rounds when its pointer has passed the first level; the root
is the sum of all.

No conversation, prefix or parent is gathered in one task: turns are numbered after a sort by range,
from counts for each (conversation, partition); digests of prefixes come from blocks of `BLOCK`
turns; members are counted map-side; children ask for their parent by `spread_join`. Members that end
at a node are joined to chunks of text in sorted order before the one running hash that SHA-256 asks for
reads them, as a stream.

Defined cases: a null role or text is empty; a null turn comes first; turns of one number are ordered
by the SHA-256 of role and text, and repeated rows are turns of their own; rows with a null conv_id
belong to no conversation and are left out; long texts and conversations are taken whole; further
columns are ignored. A table without conversations gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm import _graph

#: turns of a conversation whose prefixes one window makes; conv_ids in a chunk of text (a power of two)
BLOCK, CHUNK = 512, 4096
ROOT = "0.0"
#: place of a row in its partition, as `monotonically_increasing_id` has it
IN_PARTITION = 33


def _sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` sorted over all partitions; `at` has the partition in its high bits, the row in its low ones."""
    ranged = df.repartitionByRange(_graph.partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return _graph.cut(ranged.withColumn("at", F.monotonically_increasing_id()))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns by number, and the numbers' runs.

    Turns: conv_id, part, at, sig, n_bytes. Runs, a row for each conversation and partition: conv_id, part, n, and `shift`,
    which makes a turn's place in its conversation (from 1) of `at`.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sig = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sig.alias("sig"), F.octet_length(text).cast("long").alias("n_bytes"))
    # repeated rows are told apart by a salt, so that no partition has to hold them all
    slim = _graph.cut(slim.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    placed = _sorted(slim, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sig"), F.col("salt")).withColumn("part", F.shiftright("at", IN_PARTITION))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1)
    return placed.select("conv_id", "part", "at", "sig", "n_bytes"), _graph.cut(runs.select("conv_id", "part", "n", "shift"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns (conv_id, pos, sig, n_bytes, length) and conversations (conv_id, length)."""
    placed, runs = numbered(turns)
    convs = _graph.cut(runs.groupBy("conv_id").agg(F.sum("n").alias("length")))
    rows = placed.join(runs.join(convs, "conv_id"), ["conv_id", "part"])
    return rows.select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "sig", "n_bytes", "length"), convs


def regrown(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """As `as_they_are`, of conversations rebuilt with shared beginnings: the first h turns of conversation c - c % every
    (all, if fewer; none, if absent), then c's own turns after its first h; h = crc32(decimal c) % heads."""
    placed, runs = numbered(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    convs = _graph.cut(convs)
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    plan = convs.join(bases, "base", "left").withColumn("taken", taken)
    plan = _graph.cut(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))

    rows = placed.join(runs.join(plan, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    rows = _graph.cut(rows.select("conv_id", "base", "h", "taken", "pos", "sig", "n_bytes", "length"))
    own = rows.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "sig", "n_bytes", "length")
    given = rows.where(F.col("conv_id") == F.col("base")).where(F.col("pos") < heads).select(F.col("base").alias("of"), "pos", "sig", "n_bytes")
    takers = plan.where("taken > 0").select("conv_id", "base", "taken", "length")
    first = given.join(takers, (F.col("of") == F.col("base")) & (F.col("pos") <= F.col("taken"))).select("conv_id", "pos", "sig", "n_bytes", "length")
    return own.unionByName(first), plan.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """Numbered turns with node and parent: the keys of the prefixes with and without the turn."""
    keyed = rows.withColumn("a", F.xxhash64("pos", "sig")).withColumn("b", F.xxhash64("sig", "pos", F.lit(1))).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    whole = keyed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("all_a"), F.bit_xor("b").alias("all_b"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"all_{x}").over(earlier), F.lit(0)).alias(f"before_{x}") for x in "ab"])
    here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.select("*", *[F.bit_xor(x).over(here).alias(f"upto_{x}") for x in "ab"]).join(before, ["conv_id", "block"])
    both = [F.col(f"upto_{x}").bitwiseXOR(F.col(f"before_{x}")) for x in "ab"]
    key = lambda ab: F.concat_ws(".", *[F.hex(x) for x in ab])
    parent = F.when(F.col("pos") == 1, F.lit(ROOT)).otherwise(key([x.bitwiseXOR(F.col(c)) for x, c in zip(both, "ab", strict=True)]))
    return run.select("conv_id", "pos", "length", "n_bytes", key(both).alias("node"), parent.alias("parent"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Sums over all descendants, for every node below the root: node, leaves, saved.

    nodes: node, parent, depth (from 1), leaves and saved (a node's own).
    """
    settled = [nodes.where("depth = 1").select("node", "leaves", "saved")]
    active = nodes.where("depth > 1").select("node", F.col("parent").alias("jump"), "leaves", "saved")
    while not active.isEmpty():
        handed = active.groupBy(F.col("jump").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        total = lambda x: (F.coalesce(x, F.lit(0)) + F.coalesce(f"more_{x}", F.lit(0))).alias(x)
        summed = active.join(handed, "node", "full_outer").select("node", "jump", total("leaves"), total("saved"))
        pointers = active.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        # a node that has left the rounds has no pointer; what it is handed counts as settled
        jumped = _graph.cut(_graph.spread_join(summed, pointers, "jump", "node", "left").select("node", F.col("next").alias("jump"), "leaves", "saved"))
        settled.append(jumped.where("jump is null").select("node", "leaves", "saved"))
        active = jumped.where("jump is not null")
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    return every.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _running_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, comma-joined, as they stream by in order."""
    node, digest = None, None
    for b in batches:
        nodes, made = [], []
        for name, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name == node:
                digest.update(b"," + chunk.encode())
                continue
            if node is not None:
                nodes.append(node)
                made.append(digest.hexdigest())
            node, digest = name, hashlib.sha256(chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(made, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """Per node: ends_sha256 of the conv_ids that end there (members: node, conv_id), ascending, comma-joined."""
    placed = _sorted(members, "node", "conv_id").withColumn("chunk", F.floor(F.col("at") / CHUNK))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = placed.groupBy("node", "chunk").agg(joined.alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_running_hash, "node string, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node of the trie of numbered turns (of `as_they_are` or `regrown`): conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes that sharing saves, in the subtree) and ends_sha256."""
    keyed = _graph.cut(prefixes(rows))
    below = keyed.groupBy("node", F.col("pos").alias("depth")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), ((F.count(F.lit(1)) - 1) * F.min("n_bytes")).alias("saved")
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("saved"))
    nodes = _graph.cut(below.select(top.columns).unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = _graph.cut(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")))

    sums = rolled_up(nodes.where("depth > 0")).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    whole = nodes.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).where("n_leaves is not null")
    sums = sums.unionByName(whole.select(F.lit(ROOT).alias("node"), "n_leaves", "saved_tokens"))
    stop = keyed.where("pos = length").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    full = nodes.drop("leaves", "saved").join(sums, "node").join(ends(stop), "node", "left")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = _graph.spread_join(full, parents, "parent", "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
