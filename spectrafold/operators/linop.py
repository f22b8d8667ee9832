"""A small algebra of linear operators on signals, as lazily composed plans of DataFrame transforms.

An operator maps a signal table (axis columns, other keys, a value column) to another. ``A @ B`` composes,
``A + B`` adds, ``2 * A`` scales, ``A.T`` transposes; nothing runs until the result is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import AnyGraph, axes
from .transform import gft, laplacian_product, mode_product, rgft


class LinOp:
    """A linear map of signals."""

    def apply(self, signal: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def T(self) -> LinOp:  # noqa: N802
        raise NotImplementedError

    @property
    def conj(self) -> LinOp:
        """The complex conjugate: all operators here are real."""
        return self

    def inverse(self) -> LinOp:
        raise NotImplementedError(f"{type(self).__name__} has no inverse here")

    def matrix(self, graph: AnyGraph) -> DataFrame:
        """All entries, for small graphs: the input cell as in0, in1, ..., the output cell as ax0, ax1, ..."""
        return operator_matrix(self, graph)

    def entries_on_diagonal(self, graph: AnyGraph) -> DataFrame:
        """The diagonal as a signal, for small graphs."""
        names = axes(graph)
        same = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"in{i}") for i, a in enumerate(names)])
        return self.matrix(graph).where(same).select(*names, "v")

    def __matmul__(self, other: LinOp | DataFrame) -> LinOp | DataFrame:
        return self.apply(other) if isinstance(other, DataFrame) else Compose((self, other))

    def __add__(self, other: LinOp) -> LinOp:
        return Sum((self, other))

    def __rmul__(self, factor: float) -> LinOp:
        return Scale(self, float(factor))

    def __pow__(self, power: int) -> LinOp:
        if power < 1 or power != int(power):
            raise ValueError("a whole power of at least 1 is expected")
        return Compose((self,) * int(power))


@dataclass(frozen=True)
class Scale(LinOp):
    op: LinOp
    factor: float

    def apply(self, signal: DataFrame) -> DataFrame:
        return self.op.apply(signal).withColumn("v", F.col("v") * self.factor)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Scale(self.op.T, self.factor)

    def inverse(self) -> Scale:
        return Scale(self.op.inverse(), 1 / self.factor)


@dataclass(frozen=True)
class Sum(LinOp):
    parts: tuple[LinOp, ...]

    def apply(self, signal: DataFrame) -> DataFrame:
        keys = [c for c in signal.columns if c != "v"]
        return reduce(DataFrame.unionByName, [p.apply(signal) for p in self.parts]).groupBy(*keys).agg(F.sum("v").alias("v"))

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Sum(tuple(p.T for p in self.parts))


@dataclass(frozen=True)
class Compose(LinOp):
    parts: tuple[LinOp, ...]

    def apply(self, signal: DataFrame) -> DataFrame:
        return reduce(lambda s, p: p.apply(s), reversed(self.parts), signal)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Compose(tuple(p.T for p in reversed(self.parts)))

    def inverse(self) -> Compose:
        return Compose(tuple(p.inverse() for p in reversed(self.parts)))


class Identity(LinOp):
    def apply(self, signal: DataFrame) -> DataFrame:
        return signal

    @property
    def T(self) -> LinOp:  # noqa: N802
        return self

    def inverse(self) -> LinOp:
        return self


@dataclass(frozen=True)
class KroneckerProduct(LinOp):
    """The product of one matrix for each axis, each a table (i, j, u) with its number of rows."""

    matrices: tuple[tuple[DataFrame, int], ...]
    transposed: bool = False

    def apply(self, signal: DataFrame) -> DataFrame:
        old, new = ("i", "j") if self.transposed else ("j", "i")
        for a, (m, rows) in enumerate(self.matrices):
            signal = mode_product(signal, m, f"ax{a}", old, new, rows)
        return signal

    @property
    def T(self) -> LinOp:  # noqa: N802
        return KroneckerProduct(self.matrices, not self.transposed)


@dataclass(frozen=True)
class KroneckerSum(LinOp):
    """The Laplacian of a product graph: the sum over the axes of one factor's Laplacian."""

    graph: AnyGraph

    def apply(self, signal: DataFrame) -> DataFrame:
        return laplacian_product(signal, self.graph)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return self


@dataclass(frozen=True)
class Fourier(LinOp):
    """The inverse graph Fourier transform; its transpose is the transform."""

    graph: AnyGraph
    forward: bool = False

    def apply(self, signal: DataFrame) -> DataFrame:
        return gft(signal, self.graph) if self.forward else rgft(signal, self.graph)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Fourier(self.graph, not self.forward)

    def inverse(self) -> Fourier:
        return self.T


@dataclass(frozen=True)
class Diagonal(LinOp):
    """Multiplication by a table (axis columns, d); cells that it lacks are 0."""

    table: DataFrame
    on: tuple[str, ...]

    def apply(self, signal: DataFrame) -> DataFrame:
        d = self.table.select(*self.on, F.col("d").alias("_d"))
        return signal.join(d, list(self.on), "left").withColumn("v", F.col("v") * F.coalesce("_d", F.lit(0.0))).select(*signal.columns)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return self

    def inverse(self) -> Diagonal:
        return Diagonal(self.table.where("d <> 0").withColumn("d", 1 / F.col("d")), self.on)


@dataclass(frozen=True)
class MuBlock(LinOp):
    """mu mu' for each cell, of a table (axis columns, class column, mu)."""

    table: DataFrame
    cell: tuple[str, ...]
    klass: str = "c"

    def apply(self, signal: DataFrame) -> DataFrame:
        mu = self.table.select(*self.cell, self.klass, F.col("mu").alias("_mu"))
        both = signal.join(mu, [*self.cell, self.klass])
        # the classes of a cell, for each value of other keys
        cell = Window.partitionBy(*[c for c in signal.columns if c not in (self.klass, "v")])
        return both.withColumn("v", F.col("_mu") * F.sum(F.col("v") * F.col("_mu")).over(cell)).select(*signal.columns)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return self

    def diagonal(self) -> DataFrame:
        return self.table.select(*self.cell, self.klass, F.pow("mu", F.lit(2)).alias("v"))


@dataclass(frozen=True)
class Expanded(LinOp):
    """An operator on each class apart. The class is a key column, which all operators here carry along."""

    op: LinOp

    def apply(self, signal: DataFrame) -> DataFrame:
        return self.op.apply(signal)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Expanded(self.op.T)

    def inverse(self) -> Expanded:
        return Expanded(self.op.inverse())

    def __pow__(self, power: int) -> Expanded:
        return Expanded(self.op**power)


@dataclass(frozen=True)
class Features(LinOp):
    """X: weights (m, other keys, v) to cells, by a table (axis columns, x: array); the transpose sums over cells."""

    table: DataFrame
    cell: tuple[str, ...]
    transposed: bool = False

    def apply(self, signal: DataFrame) -> DataFrame:
        long = self.table.select(*self.cell, F.posexplode("x").alias("m", "_x"))
        old, new = (list(self.cell), ["m"]) if self.transposed else (["m"], list(self.cell))
        keys = [c for c in signal.columns if c not in (*old, "v")]
        return signal.join(long, old).groupBy(*new, *keys).agg(F.sum(F.col("v") * F.col("_x")).alias("v"))

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Features(self.table, self.cell, not self.transposed)


@dataclass(frozen=True)
class QXBlock(LinOp):
    """left X right: weights to cells, X between an operator on cells and one on weights."""

    left: LinOp
    features: Features
    right: LinOp

    def apply(self, signal: DataFrame) -> DataFrame:
        return self.left.apply(self.features.apply(self.right.apply(signal)))

    @property
    def T(self) -> LinOp:  # noqa: N802
        return Compose((self.right.T, self.features.T, self.left.T))


@dataclass(frozen=True)
class Block:
    """A two by two block operator on pairs (cells, weights)."""

    a11: LinOp
    a12: LinOp
    a21: LinOp
    a22: LinOp

    def apply(self, cells: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
        def add(one: DataFrame, other: DataFrame) -> DataFrame:
            keys = [c for c in one.columns if c != "v"]
            return one.unionByName(other).groupBy(*keys).agg(F.sum("v").alias("v"))

        return add(self.a11.apply(cells), self.a12.apply(weights)), add(self.a21.apply(cells), self.a22.apply(weights))

    @property
    def T(self) -> Block:  # noqa: N802
        return Block(self.a11.T, self.a21.T, self.a12.T, self.a22.T)


@dataclass(frozen=True)
class BlockDiagonal:
    """One operator on cells and one on weights."""

    cells: LinOp
    weights: LinOp

    def apply(self, cells: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.cells.apply(cells), self.weights.apply(weights)

    @property
    def T(self) -> BlockDiagonal:  # noqa: N802
        return BlockDiagonal(self.cells.T, self.weights.T)

    def inverse(self) -> BlockDiagonal:
        return BlockDiagonal(self.cells.inverse(), self.weights.inverse())


def gram(features: DataFrame, weight: str | None = None) -> DataFrame:
    """i, j, v: X' diag(weight) X of a table with an array column x; one aggregation with partial sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = features.select(F.posexplode("x").alias("i", "a"), "x", w.alias("w"))
    pairs = long.select("i", "a", "w", F.posexplode("x").alias("j", "b"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("v"))


def softmax_gram(features: DataFrame) -> DataFrame:
    """i, c, j, d, v: sums over cells of x_i x_j (mu_c delta_cd - mu_c mu_d), of a table with arrays x and mu."""
    long = features.select(F.posexplode("x").alias("i", "a"), "x", "mu")
    pairs = long.select("i", "a", F.posexplode("x").alias("j", "b"), "mu")
    one = pairs.select("i", "a", "j", "b", F.posexplode("mu").alias("c", "p"), "mu")
    both = one.select("i", "a", "j", "b", "c", "p", F.posexplode("mu").alias("d", "q"))
    weight = F.col("p") * F.when(F.col("c") == F.col("d"), 1.0).otherwise(0.0) - F.col("p") * F.col("q")
    return both.groupBy("i", "c", "j", "d").agg(F.sum(F.col("a") * F.col("b") * weight).alias("v"))


def operator_matrix(op: LinOp, graph: AnyGraph) -> DataFrame:
    """All columns of an operator, for small graphs: the input cell's coordinates as in0, in1, ..."""
    from .graphs import grid

    cells = grid(graph)
    unit = cells.select("*", *[F.col(a).alias(f"in{i}") for i, a in enumerate(axes(graph))]).withColumn("v", F.lit(1.0))
    return op.apply(unit)


def inner(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> float:
    """The inner product of two signals."""
    o = other.select(*keys, F.col("v").alias("_v"))
    return one.join(o, list(keys)).agg(F.sum(F.col("v") * F.col("_v"))).first()[0] or 0.0
