"""Graphs and Cartesian product graphs.

A graph is its number of nodes and a table of directed edges (src, dst, w) with both directions of every
edge. A product graph is the list of its factors; its nodes are tuples of factor nodes and are never
listed. Chains, loops and complete graphs know their spectra in closed form, so that their basis tables
are expressions over ``range``; other graphs are decomposed by numpy up to ``DENSE_NODES`` nodes. No array
of more nodes is made for any graph: larger random graphs are drawn, joined and counted over tables.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources.signals import large_axis
from . import forests

DENSE_NODES = 3000
#: A factor's basis is broadcast up to this many rows (16 bytes and overhead each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000


class Graph:
    """An undirected weighted graph without self-loops; one axis."""

    def __init__(self, spark: SparkSession, n: int, edges: DataFrame | None = None, kind: str = "edges") -> None:
        if n < 1:
            raise ValueError("a graph has at least one node")
        self.spark, self.n, self.kind, self._edges = spark, n, kind, edges
        self.factors, self.shape, self.ndim = [self], (n,), 1

    def __repr__(self) -> str:
        return f"Graph({self.n})"

    # ---- constructors -------------------------------------------------------------------------------

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int, src: str = "src", dst: str = "dst", w: str | None = None) -> Graph:
        """From a list with each edge once or in both directions; equal edges must have equal weights."""
        weight = F.col(w).cast("double") if w else F.lit(1.0)
        one = edges.select(F.col(src).cast("int").alias("src"), F.col(dst).cast("int").alias("dst"), weight.alias("w"))
        both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("w <> 0")
        out = cls(edges.sparkSession, n, both.groupBy("src", "dst").agg(F.max("w").alias("w"), F.min("w").alias("_low")))
        if out._edges.where("w <> _low").limit(1).count():
            raise ValueError("the weights of an edge differ")
        out._edges = out._edges.drop("_low")
        out._check()
        return out

    @classmethod
    def of(cls, spark: SparkSession | None = None, *, adjacency=None, laplacian=None, network=None) -> Graph:
        """From exactly one of an adjacency matrix, a Laplacian and a networkx graph."""
        if sum(x is not None for x in (adjacency, laplacian, network)) != 1:
            raise ValueError("exactly one of adjacency, laplacian and network is expected")
        if network is not None:
            return cls.from_networkx(network, spark)
        return cls.from_adjacency(adjacency, spark=spark) if adjacency is not None else cls.from_laplacian(laplacian, spark=spark)

    @classmethod
    def from_networkx(cls, network, spark: SparkSession | None = None, weight: str = "weight") -> Graph:
        """From a networkx graph (anything with ``nodes`` and ``edges(data=True)``): nodes in their order, weights of 1 where unset."""
        if not hasattr(network, "nodes") or not hasattr(network, "edges"):
            raise ValueError("a networkx graph is expected")
        place = {node: i for i, node in enumerate(network.nodes)}
        rows = [(place[a], place[b], float(data.get(weight, 1.0))) for a, b, data in network.edges(data=True)]
        spark = spark or SparkSession.getActiveSession()
        return cls.from_edges(spark.createDataFrame(rows, "src int, dst int, w double"), len(place), w="w")

    @classmethod
    def from_adjacency(cls, a: DataFrame | np.ndarray, n: int | None = None, spark: SparkSession | None = None) -> Graph:
        """From a matrix, or a table (i, j, w) of its entries; it must be symmetric without a diagonal."""
        table, n = _entries(a, n, spark)
        check_adjacency(table)
        return cls(table.sparkSession, n, table.where("w <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"))

    @classmethod
    def from_laplacian(cls, lap: DataFrame | np.ndarray, n: int | None = None, spark: SparkSession | None = None) -> Graph:
        """From a Laplacian matrix or a table (i, j, w) of its entries."""
        table, n = _entries(lap, n, spark)
        check_laplacian(table)
        return cls(table.sparkSession, n, laplacian_to_adjacency(table).select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"))

    @classmethod
    def chain(cls, spark: SparkSession, n: int) -> Graph:
        """A path: node i next to node i + 1."""
        one = spark.range(n - 1).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
        return cls(spark, n, _both(one), "chain")

    @classmethod
    def loop(cls, spark: SparkSession, n: int) -> Graph:
        """A cycle; two nodes have the one edge between them."""
        if n < 2:
            raise ValueError("a loop of one node would be a self-loop")
        one = spark.range(n).select(F.col("id").cast("int").alias("src"), ((F.col("id") + 1) % n).cast("int").alias("dst"))
        return cls(spark, n, _both(one).distinct(), "loop" if n > 2 else "chain")

    @classmethod
    def complete(cls, spark: SparkSession, n: int) -> Graph:
        """Every node next to every other."""
        nodes = spark.range(n).select(F.col("id").cast("int").alias("src"))
        pairs = nodes.withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("src <> dst")
        return cls(spark, n, pairs.withColumn("w", F.lit(1.0)), "complete")

    @classmethod
    def random_tree(cls, spark: SparkSession, n: int, seed: int = 0) -> Graph:
        """The Euclidean minimum spanning tree of points drawn in the unit square; unit weights.

        Up to ``DENSE_NODES`` nodes numpy draws the points and Prim's algorithm joins them; beyond, all of it is done over
        tables (as in the other random graphs), and the points are others.
        """
        if n > DENSE_NODES:
            return cls(spark, n, _both(forests.spanning_tree(forests.drawn(spark, n, seed))))
        return cls._from_pairs(spark, n, spanning_tree(np.random.default_rng(seed).random((n, 2))))

    @classmethod
    def random_connected(cls, spark: SparkSession, n: int, repeats: int = 2, seed: int = 0) -> Graph:
        """The union of ``repeats`` spanning trees: of drawn points, and of these points moved a little."""
        if n > DENSE_NODES:
            points = forests.drawn(spark, n, seed)
            trees = [forests.spanning_tree(points)]
            for part in range(1, repeats):
                by = forests.drawn(spark, n, seed, part).select("node", F.col("x").alias("dx"), F.col("y").alias("dy"))
                trees.append(forests.spanning_tree(points.join(by, "node").select("node", (F.col("x") + 0.1 * F.col("dx")).alias("x"), (F.col("y") + 0.1 * F.col("dy")).alias("y"))))
            return cls(spark, n, _both(cut(reduce(DataFrame.union, trees).distinct())))
        rng = np.random.default_rng(seed)
        points = rng.random((n, 2))
        pairs = spanning_tree(points)
        for _ in range(repeats - 1):
            pairs |= spanning_tree(points + 0.1 * rng.random((n, 2)))
        return cls._from_pairs(spark, n, pairs)

    @classmethod
    def random_regular(cls, spark: SparkSession, n: int, r: int, seed: int = 0) -> Graph:
        """An r-regular bipartite graph: halves of a shuffled order, joined at r different shifts."""
        if n % 2 or 2 * r > n:
            raise ValueError("n must be even and at least 2 r")
        if n > DENSE_NODES:
            nodes = spark.range(n).select(F.struct(F.xxhash64(F.lit(seed), "id").alias("by"), "id").alias("node"))
            order = cut(large_axis(nodes, "node", "place").select("place", F.col("label.id").cast("int").alias("node")))
            half = n // 2
            met = order.where(F.col("place") < half).select(F.col("node").alias("a"), "place", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("s"))
            met = met.select("a", (half + (F.col("place") + F.col("s")) % half).alias("place"))
            return cls(spark, n, _both(met.join(order.withColumnRenamed("node", "b"), "place").select("a", "b")))
        order = np.random.default_rng(seed).permutation(n).tolist()
        half = n // 2
        pairs = {tuple(sorted((order[i], order[half + (i + s) % half]))) for i in range(half) for s in range(r)}
        return cls._from_pairs(spark, n, pairs)

    @classmethod
    def _from_pairs(cls, spark: SparkSession, n: int, pairs: set[tuple[int, int]]) -> Graph:
        rows = sorted((int(a), int(b)) for a, b in pairs)
        return cls(spark, n, _both(spark.createDataFrame(rows, "src int, dst int")))

    # ---- tables -------------------------------------------------------------------------------------

    @property
    def edges(self) -> DataFrame:
        """src, dst, w: both directions of every edge."""
        return self._edges

    def _check(self) -> None:
        if self._edges.where("src = dst").limit(1).count():
            raise ValueError("self-loops aren't allowed")
        if self._edges.where((F.col("src") < 0) | (F.col("src") >= self.n)).limit(1).count():
            raise ValueError("an edge has a node out of range")

    def degrees(self) -> DataFrame:
        """node, degree: the sum of the weights of each node's edges, 0 for a lone node."""
        nodes = self.spark.range(self.n).select(F.col("id").cast("int").alias("node"))
        sums = self.edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))
        return nodes.join(sums, "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    def laplacian(self) -> DataFrame:
        """i, j, w: the entries of degree matrix less adjacency."""
        return adjacency_to_laplacian(self.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"))

    @cached_property
    def _dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies and basis as arrays, in ascending order of frequency."""
        n, k = self.n, np.arange(self.n)
        if n > DENSE_NODES:
            raise ValueError(f"a graph of more than {DENSE_NODES} nodes isn't decomposed; use a polynomial filter")
        if self.kind in ("chain", "complete"):
            u = np.sqrt(np.where(k > 0, 2.0, 1.0) / n) * np.cos(np.pi * (k[:, None] + 0.5) * k / n)
            return (2 - 2 * np.cos(np.pi * k / n) if self.kind == "chain" else np.where(k > 0, float(n), 0.0)), u
        lap = np.zeros((n, n))
        for i, j, w in self.laplacian().collect():  # at most DENSE_NODES squared entries
            lap[i, j] = w
        return np.linalg.eigh((lap + lap.T) / 2)

    @property
    def lam(self) -> np.ndarray:
        return self._dense[0]

    def neighbours(self) -> DataFrame:
        """node, near: for each node with edges the list of (dst, w)."""
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct("dst", "w")).alias("near"))

    def components(self) -> int:
        """How many connected components there are: frequencies of 0, or over tables where the graph isn't decomposed."""
        if self.n > DENSE_NODES:
            return 1 if self.closed else forests.components(self.edges, self.n)
        return int(np.sum(self.lam < 1e-9))

    @property
    def closed(self) -> bool:
        """Whether the spectrum is known without a decomposition."""
        return self.kind in ("chain", "loop", "complete")

    @property
    def u(self) -> np.ndarray:
        return self._dense[1]

    def spectrum(self) -> DataFrame:
        """k, lam: the graph frequencies."""
        k = F.col("k")
        if self.kind in ("chain", "complete", "loop"):
            lam = {
                "chain": 2 - 2 * F.cos(math.pi * k / self.n),
                "complete": F.when(k > 0, float(self.n)).otherwise(0.0),
                "loop": 2 - 2 * F.cos(2 * math.pi * F.ceil(k / 2) / self.n),
            }[self.kind]
            return self.spark.range(self.n).select(F.col("id").cast("int").alias("k")).withColumn("lam", lam)
        return self.spark.createDataFrame([(i, float(x)) for i, x in enumerate(self.lam)], "k int, lam double")

    def basis(self) -> DataFrame:
        """i, k, u: component i of the eigenvector of frequency k."""
        n, i, k = self.n, F.col("i"), F.col("k")
        if self.kind in ("chain", "complete", "loop"):
            if self.kind == "loop":
                turn = 2 * math.pi * F.ceil(k / 2) * i / n
                last = (n % 2 == 0) & (k == n - 1) if n % 2 == 0 else F.lit(False)
                u = F.when(k == 0, 1 / math.sqrt(n)).when(last, F.when(i % 2 == 0, 1.0).otherwise(-1.0) / math.sqrt(n))
                u = u.otherwise(math.sqrt(2 / n) * F.when(k % 2 == 1, F.cos(turn)).otherwise(F.sin(turn)))
            else:
                u = F.when(k == 0, 1 / math.sqrt(n)).otherwise(math.sqrt(2 / n) * F.cos(math.pi * (i + 0.5) * k / n))
            rows = self.spark.range(n).select(F.col("id").cast("int").alias("k"))
            return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("i", "k", u.alias("u"))
        return matrix_table(self.spark, self.u, "k")


class ProductGraph:
    """The Cartesian product of at least two graphs; axes ``ax0``, ``ax1``, ..."""

    def __init__(self, *factors: Graph) -> None:
        if len(factors) < 2 or not all(isinstance(f, Graph) for f in factors):
            raise ValueError("a product has at least two factors, which are graphs")
        self.factors, self.spark = list(factors), factors[0].spark
        self.shape = tuple(f.n for f in factors)
        self.ndim, self.n = len(factors), math.prod(self.shape)

    def __repr__(self) -> str:
        return f"ProductGraph({' x '.join(map(str, self.shape))})"

    @classmethod
    def from_adjacency(cls, *matrices: DataFrame | np.ndarray, spark: SparkSession | None = None) -> ProductGraph:
        return cls(*(Graph.from_adjacency(a, spark=spark) for a in matrices))

    @classmethod
    def from_laplacian(cls, *matrices: DataFrame | np.ndarray, spark: SparkSession | None = None) -> ProductGraph:
        return cls(*(Graph.from_laplacian(a, spark=spark) for a in matrices))

    @classmethod
    def from_networkx(cls, *networks, spark: SparkSession | None = None) -> ProductGraph:
        return cls(*(Graph.from_networkx(g, spark) for g in networks))

    @classmethod
    def of(cls, shape: tuple[int, ...] | None = None, spark: SparkSession | None = None, *, adjacency=None, laplacian=None, graphs=None) -> ProductGraph:
        """From exactly one of a list of graphs and a whole adjacency matrix or Laplacian, which is a Kronecker sum over ``shape``."""
        if sum(x is not None for x in (adjacency, laplacian, graphs)) != 1:
            raise ValueError("exactly one of adjacency, laplacian and graphs is expected")
        if graphs is not None:
            return cls(*graphs)
        if shape is None or len(shape) < 2:
            raise ValueError("a product matrix needs the shape of at least two factors")
        table, n = _entries(adjacency if adjacency is not None else laplacian, math.prod(shape), spark)
        if n != math.prod(shape):
            raise ValueError("the matrix doesn't have the size of the shape")
        if laplacian is not None:
            check_laplacian(table)
            table = laplacian_to_adjacency(table)
        else:
            check_adjacency(table)
        factors, step = [], math.prod(shape)
        for size in shape:
            step //= size
            # edges along this axis where all others are at 0
            along = table.where(f"w <> 0 and i % {step} = 0 and j % {step} = 0 and i < {step * size} and j < {step * size}")
            along = along.select((F.col("i") / step).cast("int").alias("i"), (F.col("j") / step).cast("int").alias("j"), "w")
            factors.append(Graph.from_adjacency(along, size))
        out = cls(*factors)
        made = out.edges().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("w2"))
        differs = table.join(made, ["i", "j"], "full_outer").where("abs(coalesce(w, 0) - coalesce(w2, 0)) > 1e-9")
        if differs.limit(1).count():
            raise ValueError("the matrix isn't a Kronecker sum over the shape")
        return out

    @classmethod
    def lattice(cls, spark: SparkSession, *ns: int) -> ProductGraph:
        return cls(*(Graph.chain(spark, n) for n in ns))

    @classmethod
    def torus(cls, spark: SparkSession, *ns: int) -> ProductGraph:
        return cls(*(Graph.loop(spark, n) for n in ns))

    @classmethod
    def image(cls, spark: SparkSession, width: int, height: int) -> ProductGraph:
        """Rows, columns and three colours."""
        return cls(Graph.chain(spark, width), Graph.chain(spark, height), Graph.complete(spark, 3))

    @classmethod
    def random_connected(cls, spark: SparkSession, *ns: int, seed: int = 0) -> ProductGraph:
        """Random factors, each from a seed of its own."""
        return cls(*(Graph.random_connected(spark, n, seed=seed + i) for i, n in enumerate(ns)))

    def edges(self) -> DataFrame:
        """src and dst as flat row-major ids, w: the edges of the product, one join for each axis."""
        nodes = grid(self)
        flat = lambda cols: reduce(lambda a, b: a * b[1] + b[0], [(F.col(c).cast("long"), n) for c, n in zip(cols, self.shape)][1:], F.col(cols[0]).cast("long"))
        names, parts = axes(self), []
        for a, f in enumerate(self.factors):
            moved = nodes.join(f.edges.withColumnRenamed("src", f"ax{a}"), f"ax{a}")
            parts.append(moved.select(flat(names).alias("src"), flat([*names[:a], "dst", *names[a + 1 :]]).alias("dst"), "w"))
        return reduce(DataFrame.union, parts)

    def spectrum(self) -> DataFrame:
        """k0, lam0, k1, lam1, ...: all frequencies of the product."""
        out = None
        for a, f in enumerate(self.factors):
            one = f.spectrum().select(F.col("k").alias(f"k{a}"), F.col("lam").alias(f"lam{a}"))
            out = one if out is None else out.crossJoin(F.broadcast(one) if f.n <= BROADCAST_ROWS else one)
        return out


def matrix_table(spark: SparkSession, m: np.ndarray, column: str = "j") -> DataFrame:
    """i, j, u of the entries of a matrix, sent as arrays."""
    i, j = (x.ravel().astype(np.int32) for x in np.indices(m.shape))
    return spark.createDataFrame(pa.table({"i": i, column: j, "u": np.ascontiguousarray(m, float).ravel()}))


AnyGraph = Graph | ProductGraph


def axes(graph: AnyGraph) -> list[str]:
    return [f"ax{a}" for a in range(graph.ndim)]


def grid(graph: AnyGraph) -> DataFrame:
    """ax0, ax1, ...: all nodes of a graph."""
    out = graph.spark.range(graph.shape[0]).select(F.col("id").cast("int").alias("ax0"))
    for a, n in enumerate(graph.shape[1:], 1):
        out = out.withColumn(f"ax{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def inside(signal: DataFrame, graph: AnyGraph) -> DataFrame:
    """The signal, whose coordinates must be nodes of the graph: others fail the query rather than vanish in a join."""
    for a, n in enumerate(graph.shape):
        at = F.col(f"ax{a}")
        wrong = F.raise_error(F.concat(F.lit(f"ax{a} is outside of the {n} nodes of the graph: "), F.coalesce(at.cast("string"), F.lit("null"))))
        signal = signal.withColumn(f"ax{a}", F.when(at.between(0, n - 1), at).otherwise(wrong.cast("int")))
    return signal


def spanning_tree(points: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Euclidean minimum spanning tree (Prim)."""
    n = len(points)
    if n < 2:
        return set()
    out, inside = set(), np.zeros(n, bool)
    inside[0] = True
    far, near = np.linalg.norm(points - points[0], axis=1), np.zeros(n, int)
    for _ in range(n - 1):
        i = int(np.where(inside, np.inf, far).argmin())
        out.add((min(i, int(near[i])), max(i, int(near[i]))))
        inside[i] = True
        d = np.linalg.norm(points - points[i], axis=1)
        near[d < far] = i
        far = np.minimum(far, d)
    return out


def _both(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs, with weight 1."""
    one = pairs.toDF("src", "dst")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))


def _entries(m: DataFrame | np.ndarray, n: int | None, spark: SparkSession | None) -> tuple[DataFrame, int]:
    if isinstance(m, DataFrame):
        table = m.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("w").cast("double"))
        return table, n if n is not None else table.agg(F.max(F.greatest("i", "j"))).first()[0] + 1
    m = np.asarray(m, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("a square matrix is expected")
    rows = [(i, j, float(m[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(m)))]
    return (spark or SparkSession.getActiveSession()).createDataFrame(rows, "i int, j int, w double"), len(m)


def asymmetric(table: DataFrame) -> DataFrame:
    """Entries (i, j, w) whose mirror entry differs; missing entries count as 0."""
    mirror = table.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w2"))
    both = table.join(mirror, ["i", "j"], "full_outer")
    return both.where(F.coalesce("w", F.lit(0.0)) != F.coalesce("w2", F.lit(0.0)))


def check_adjacency(table: DataFrame, directed: bool = False, self_loops: bool = False) -> None:
    """Raise ValueError unless a table (i, j, w) is a valid adjacency matrix."""
    if not directed and asymmetric(table).limit(1).count():
        raise ValueError("the adjacency matrix isn't symmetric")
    if not self_loops and table.where("i = j and w <> 0").limit(1).count():
        raise ValueError("the adjacency matrix has a diagonal")


def check_laplacian(table: DataFrame, tolerance: float = 1e-9) -> None:
    """Raise ValueError unless a table (i, j, w) is symmetric with columns that add up to 0."""
    if asymmetric(table).limit(1).count():
        raise ValueError("the Laplacian isn't symmetric")
    sums = table.groupBy("j").agg(F.sum("w").alias("s"), F.sum(F.abs("w")).alias("size"))
    if sums.where(F.abs("s") > tolerance * F.greatest(F.lit(1.0), F.col("size"))).limit(1).count():
        raise ValueError("a column of the Laplacian doesn't add up to 0")


def adjacency_to_laplacian(table: DataFrame) -> DataFrame:
    """i, j, w: degrees on the diagonal, less the adjacency."""
    degrees = table.groupBy("j").agg(F.sum("w").alias("w")).select(F.col("j").alias("i"), "j", "w")
    return degrees.unionByName(table.select("i", "j", (-F.col("w")).alias("w")))


def laplacian_to_adjacency(table: DataFrame) -> DataFrame:
    """i, j, w: the negated entries off the diagonal."""
    return table.where("i <> j and w <> 0").select("i", "j", (-F.col("w")).alias("w"))
