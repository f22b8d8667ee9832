"""The trie of all conversations: one node for each distinct sequence of first turns.

Sequences get names by prefix doubling. Turns are named first, then blocks of 2, 4, 8 ... turns at places
divisible by their length, each by the names of its halves; the names of a round are (nearly) dense numbers of its
distinct pairs. A prefix is made of such blocks, by the binary digits of its length from the highest: its name
is that of the pair of the prefix without the last block and this block. There are as many rounds of joins as
the number of turns has binary digits, twice; two prefixes are equal if length and name are.

A node is known by its depth and its least member. Sums over subtrees need no walk: a node's members are all
conversations that pass it, so that a sum over the nodes below is one over members, of what each of them
passes below and of the nodes for which it is the least member. Turns are told apart by SHA-256 of role and text,
so that texts aren't shuffled.

Defined results: null roles and texts are empty; rows without a conversation are left out; turns are in ascending
order, null first, those of equal turns in the order of their SHA-256, equal rows each; an empty table has no nodes,
not even the root. Long conversations, and nodes that many conversations pass or end at, are dealt over many tasks.
Columns other than the four are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Turns of one conversation that one task sums up.
CHUNK = 4096
#: About so many characters of ids go into one row before they are hashed.
IDS = 1 << 16


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), key and size (bytes of the text) of all turns; no task gets a long conversation whole."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256))
    rows = df.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.octet_length(text_).cast("long").alias("size"), F.rand(13).alias("spread")
    )
    ranged = rows.repartitionByRange(shuffle_partitions(df.sparkSession), "conv", "turn", "key", "spread")
    ranged = cut(ranged.select("conv", "turn", "key", "size", F.spark_partition_id().alias("part")))
    runs = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "key"))
    return ranged.withColumn("place", place).join(runs, ["conv", "part"]).select("conv", (F.col("before") + F.col("place")).alias("pos"), "key", "size")


def dense_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: a number of the row's keys among all distinct ones.

    Distinct keys are dealt to buckets of about one size and numbered in each; the numbers of the buckets interleave, so that
    they are dense but for the differences of the buckets' sizes, and no task sees all keys. Keys that many rows have are
    counted before they are dealt; the join that gives the rows their numbers is of two shuffled tables, one with a
    row for each key, so that Spark splits its large partitions (adaptive execution).
    """
    buckets = 4 * shuffle_partitions(df.sparkSession)
    distinct = df.select(*keys).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    names = distinct.select(*keys, (rank.cast("long") * buckets + F.col("_bucket")).alias(name))
    return df.join(names, keys)


def prefix_names(turns: DataFrame) -> DataFrame:
    """conv, depth and name of every prefix of every conversation (``turns``: conv, pos from 1 without gaps, key)."""
    # blocks of a level: conv, at (which block of its length), name
    first = dense_names(turns.select("conv", (F.col("pos") - 1).alias("at"), "key"), ["key"], "name")
    level = cut(first.select("conv", "at", "name"))
    longest = level.agg(F.max("at")).first()[0]
    levels = [level]
    while longest is not None and longest > 0:
        left = level.where("at % 2 = 0").select("conv", (F.col("at") / 2).cast("long").alias("at"), F.col("name").alias("l"))
        right = level.where("at % 2 = 1").select("conv", ((F.col("at") - 1) / 2).cast("long").alias("at"), F.col("name").alias("r"))
        level = cut(dense_names(left.join(right, ["conv", "at"]), ["l", "r"], "name").select("conv", "at", "name"))
        levels.append(level)
        longest = (longest - 1) // 2
    blocks = None
    for k, level in enumerate(levels):
        size = F.lit(1 << k).cast("long")
        sized = level.select("conv", (F.col("at") * size).alias("depth"), size.alias("size"), F.col("name").alias("r"))
        blocks = sized if blocks is None else blocks.unionByName(sized)
    blocks = cut(blocks)
    made = blocks.where("depth = 0").select("conv", F.col("size").alias("depth"), F.col("r").alias("name"))  # lengths with one binary digit
    prefixes = made
    for _ in range(len(levels) - 1):  # one digit more in each round
        pairs = made.withColumnRenamed("name", "l").join(blocks, ["conv", "depth"]).where("size < (depth & -depth)")
        pairs = pairs.select("conv", (F.col("depth") + F.col("size")).alias("depth"), "l", "r")
        made = cut(dense_names(pairs, ["depth", "l", "r"], "name").select("conv", "depth", "name"))
        prefixes = prefixes.unionByName(made)
    return prefixes


def suffix_sums(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` (conv, depth, ...) with the sum of ``value`` over this and all greater depths of the conversation."""
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    chunks = rows.groupBy("conv", "chunk").agg(F.sum(value).alias("s"))
    chunks = chunks.withColumn("after", F.sum("s").over(Window.partitionBy("conv").orderBy(F.desc("chunk"))) - F.col("s")).drop("s")
    within = F.sum(value).over(Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")))
    return rows.withColumn("within", within).join(chunks, ["conv", "chunk"]).withColumn(out, F.col("within") + F.col("after")).drop("chunk", "within", "after")


def ids_hash(ends: DataFrame) -> DataFrame:
    """depth, name and the SHA-256 of the ascending ids, joined by commas, of the conversations that end there.

    Ids are joined where they are sorted, by ranges of node and id; one task per node then hashes few long rows one
    after another, of which it holds one batch.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, length, out = None, [], 0, []
        for batch in batches:
            for depth, name, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (depth, name) != node or length > IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids, length = (depth, name), [], 0
                ids.append(conv)
                length += 20
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["depth", "name", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, ids[0], ",".join(map(str, ids))), kinds)], names=["depth", "name", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for depth, name, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (depth, name) == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (depth, name), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*kinds[:2], pa.string()))], names=["depth", "name", "ends_sha256"])
                out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, digest.hexdigest()), (*kinds[:2], pa.string()))], names=["depth", "name", "ends_sha256"])

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    parts = shuffle_partitions(ends.sparkSession)
    order = ["depth", "name", "conv"]
    rows = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(joined, "depth long, name long, first long, ids string")
    rows = rows.repartition(parts, "depth", "name").sortWithinPartitions("depth", "name", "first").select("depth", "name", "ids")
    return rows.mapInArrow(hashed, "depth long, name long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos, key and size, ``conversations`` one row conv for each conversation, turnless ones too.
    """
    turns = cut(turns)
    prefixes = prefix_names(turns).join(turns.select("conv", F.col("pos").alias("depth"), "size"), ["conv", "depth"])
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    rows = cut(prefixes)
    key = ["depth", "name"]
    ends = cut(rows.join(lengths.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("conv", *key))
    least = rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    least = least.join(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ends")), key, "left")
    # for each conversation: the depth from which it is the least member, and whether it is that of a childless node
    own = least.groupBy("conv").agg(F.min("depth").alias("own"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    own = cut(own)
    valued = rows.join(own, "conv", "left").select("conv", *key, F.coalesce("own", F.lit((1 << 63) - 1)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "size")
    valued = valued.withColumn("v", F.when(F.col("depth") < F.col("own"), F.col("size")).otherwise(0))
    nodes = cut(suffix_sums(valued, "v", "below").groupBy(*key).agg(
        F.min(F.struct("conv", "own")).alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("below").alias("saved_tokens"),
    ).select(*key, F.col("rep.conv").alias("conv_id"), F.col("rep.own").alias("own"), "n_convs", "n_leaves", "saved_tokens"))
    everyone = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    # the parent of a node that its least member shares with lesser ones is found by the name of the prefix before it
    tops = nodes.where("depth = own and depth > 1").select(F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("depth"))
    tops = tops.join(rows.select("conv", *key), ["conv", "depth"])
    above = tops.join(nodes.select(*key, F.col("conv_id").alias("parent")), key).select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent")
    inner = nodes.join(above, ["conv_id", "depth"], "left").crossJoin(F.broadcast(everyone.select(F.col("conv_id").alias("root"))))
    parent = F.when(F.col("depth") == 1, F.col("root")).when(F.col("depth") > F.col("own"), F.col("conv_id")).otherwise(F.col("parent"))
    inner = cut(inner.select(*key, "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens"))
    below = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = inner.where("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = everyone.where("n_convs > 0").crossJoin(whole).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    turnless = conversations.join(lengths, "conv", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv")
    hashes = ids_hash(ends.select(*key, "conv").unionByName(turnless))
    out = root.unionByName(inner).join(below, ["depth", "conv_id"], "left").join(hashes, key, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of a table as they are."""
    turns = ordered_turns(df, conv_id, turn, role, text)
    return trie(turns, df.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv")).distinct())
