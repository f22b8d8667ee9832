"""Minimum spanning forests over tables, for graphs that are too large for arrays.

Borůvka's algorithm: the shortest link out of any set of nodes belongs to the minimum spanning forest, so every label
takes its shortest link in each round, and labels are contracted along the links taken. It doesn't matter whether a
round contracts whole trees. Links are told apart by length and ends, so that there is one forest. When no more
than ``SMALL`` links between labels are left, however many nodes there were, Kruskal's algorithm ends it in the driver.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, remove, scratch

#: So many links between labels, at most, are collected.
SMALL = 20_000
#: How many neighbours a point has on average within the first radius.
NEAR = 12


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` from files: unlike checkpoints they have sizes of their own, where estimated ones are multiplied in each join."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spanning_forest(links: DataFrame, folder: str, small: int = SMALL) -> tuple[DataFrame, list[DataFrame]]:
    """The forest (a, b) of links (p, q, d, a, b): labels p and q are joined by the edge (a, b) of length d; and the moves.

    Each move is a table (p, up) of labels and the labels that took their place, in order. All tables are in the folder.
    """
    spark, trees, moves = links.sparkSession, [], []
    while True:
        ends = links.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.struct("d", "a", "b").alias("e"))
        held = _stored(ends.groupBy("p", "q").agg(F.min("e").alias("e")), folder)
        if held.limit(small + 1).count() <= small:
            tree, move = _kruskal([(r.e.d, r.e.a, r.e.b, r.p, r.q) for r in held.collect()])
            kind = dict(links.dtypes)
            trees.append(spark.createDataFrame(tree, f"a {kind['a']}, b {kind['b']}"))
            moves.append(spark.createDataFrame(move, f"p {kind['p']}, up {kind['p']}"))
            return reduce(DataFrame.union, trees).distinct(), moves
        both = held.union(held.select("q", "p", "e"))
        best = _stored(both.groupBy("p").agg(F.min(F.struct("e", "q")).alias("m")).select("p", "m.q", "m.e"), folder)
        trees.append(best.select("e.a", "e.b"))
        # two labels that take the same link: the smaller one stays
        back = best.select(F.col("p").alias("q"), F.col("q").alias("back"))
        up = best.select("p", "q").join(back, "q").select("p", F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("up"))
        for _ in range(2):
            up = up.join(up.select(F.col("p").alias("up"), F.col("up").alias("far")), "up").select("p", F.col("far").alias("up"))
        moves.append(_stored(up, folder))
        links = moved(moved(held, moves[-1:], "p"), moves[-1:], "q").select("p", "q", "e.*")


def moved(df: DataFrame, moves: list[DataFrame], label: str) -> DataFrame:
    """``df`` with its labels after the moves."""
    for move in moves:
        to = move.select(F.col("p").alias(label), F.col("up").alias("_up"))
        df = df.join(to, label, "left").withColumn(label, F.coalesce("_up", label)).drop("_up")
    return df


def _kruskal(links: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The forest of links (d, a, b, p, q), and the label that takes the place of each."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    tree = []
    for _, a, b, p, q in sorted(links):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            tree.append((a, b))
    return tree, [(x, find(x)) for x in root]


def components(edges: DataFrame, n: int, small: int = SMALL) -> int:
    """How many connected components n nodes have with edges (src, dst), each in one or both directions."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    one = edges.select(a.alias("a"), b.alias("b")).where("a <> b").distinct()
    # lengths by chance, so that few rounds do, whatever the order of the nodes
    links, folder = one.select(F.col("a").alias("p"), F.col("b").alias("q"), F.xxhash64("a", "b").alias("d"), "a", "b"), scratch(edges.sparkSession, "forest")
    out = n - spanning_forest(links, folder, small)[0].count()
    remove(edges.sparkSession, folder)
    return out


def drawn(spark: SparkSession, n: int, seed: int, part: int = 0) -> DataFrame:
    """node, x, y: a point of the unit square for each node, by hashes of the node."""
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 52)) / float(1 << 52)
    return spark.range(n).select(F.col("id").cast("int").alias("node"), unit(2 * part).alias("x"), unit(2 * part + 1).alias("y"))


def _pairs(some: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """p, q, d, a, b: pairs of one of some points and another point within the radius, with labels and squared distance."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.array(*[cell(c) + i for i in (-1, 0, 1)]))
    one = some.select(*[F.col(c).alias(f"{c}1") for c in ("node", "label", "x", "y")], around("x").alias("cx"), F.col("y")).select("*", around("y").alias("cy")).drop("y")
    other = points.select("node", "label", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    d = (F.col("x") - F.col("x1")) * (F.col("x") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y") - F.col("y1"))
    met = one.join(other, ["cx", "cy"]).where("label <> label1").withColumn("d", d).where(F.col("d") <= radius * radius)
    return met.select(F.col("label1").alias("p"), F.col("label").alias("q"), "d", F.least("node", "node1").alias("a"), F.greatest("node", "node1").alias("b"))


def spanning_tree(points: DataFrame, small: int = SMALL) -> DataFrame:
    """a, b: the Euclidean minimum spanning tree of points (node, x, y).

    Links are sought within a radius first. Parts that this leaves apart look further, twice as far each time, but for the
    largest, whose links all end in another part; so no link of the tree is missed.
    """
    n, wide, high = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    folder = scratch(points.sparkSession, "forest")
    trees, labelled, some = [], _stored(points.withColumn("label", F.col("node")), folder), None
    radius = max(math.sqrt(NEAR * (wide or 0.0) * (high or 0.0) / (math.pi * max(n, 1))), max(wide or 0.0, high or 0.0) / max(n, 1), 1e-12)
    while n > 1:
        tree, moves = spanning_forest(_pairs(labelled if some is None else some, labelled, radius), folder, small)
        trees.append(tree)
        labelled = _stored(moved(labelled, moves, "label"), folder)
        parts = labelled.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(2).collect()
        if len(parts) == 1:
            break
        some, radius = labelled.where(F.col("label") != parts[0]["label"]), 2 * radius
    out = cut(reduce(DataFrame.union, trees) if trees else points.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    remove(points.sparkSession, folder)
    return out
