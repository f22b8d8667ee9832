"""op13: the prefix trie of rebuilt conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prefix_trie
from ..common import crc32_of_id, cut, table


def rebuild(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations: up to 8 first ones of conversation c - c % 5, then c's own without as many."""
    heads = convs.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (crc32_of_id("conv") % 9).alias("h"))
    heads = heads.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("given")), "base", "left")
    heads = cut(heads.withColumn("taken", F.least("h", F.coalesce("given", F.lit(0)))))
    own = turns.join(heads.where("n > h").select("conv", "h", "taken"), "conv").where("pos > h")  # one row for each conversation
    first = turns.where("pos <= 8").withColumnRenamed("conv", "base").join(heads.where("taken > 0").select("conv", "base", "h"), "base").where("pos <= h")
    return first.select("conv", "pos", "key", "size").unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "size"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    convs = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    return prefix_trie.trie(rebuild(turns, convs), convs.select("conv"))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
ORACLES = {
    "op13_conversation_trie": """
WITH keyed AS (
  SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM keyed),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
    lambda acc, b: list_reduce(range(0, 8), lambda a, s: xor(a >> 1, (a & 1) * 3988292384), xor(acc, b)), 4294967295), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos, t.k, t.size FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.k, t.size
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, pos AS depth, size, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
    max(pos) OVER (PARTITION BY conv_id) = pos AS ends FROM r
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved, left(path, greatest(0, length(path) - 64)) AS above,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY path, depth),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
sums AS (
  SELECT a.path, sum(x.saved) AS saved_tokens, count(*) FILTER (WHERE x.path NOT IN (SELECT path FROM children)) AS n_leaves
  FROM nodes a JOIN nodes x ON starts_with(x.path, a.path) GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.path = n.above LEFT JOIN children k ON k.path = n.path JOIN sums s ON s.path = n.path
"""
}
