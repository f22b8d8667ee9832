"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are scaled to whole numbers, floor(scale * x). Candidates are dealt into blocks; a block has one
list of its candidates for each dimension, sorted by value. A batch of queries reads the lists together,
each from the ends that the signs of its queries favour, in steps that double; candidates met for the first
time are scored in full for all queries of the batch that still read, by one matrix product. A query stops
when the values reached in all lists can't add up to its kth score any more (equal scores would still
change the order of ties, so the bound has to fall below it).

Each query first searches one block, its home; its kth score there bounds the kth of the whole from below,
and the search of every other block opens with that bound: a block none of whose candidates can reach it is
left after its list heads, and only scores that reach it are given on.

Candidates are shuffled once for each of the two passes, whatever the number of queries. Queries go to
every block (a stated query set against all rows, in blocks) and pass it as a stream in batches, so that a
task holds one block and one batch.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or
candidate; vectors are compared with those of their length only, and an empty vector scores 0; a query is
not its own candidate, nor are other rows with its id; ties go to the smaller id; a repeated row is a
candidate each time, and one query; rows without an id take no part. Columns other than the id and the
vector are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates in a block, queries in a batch, and candidates scored in one matrix product.
CANDIDATES, QUERIES, CHUNK = 16_384, 256, 8192
#: How deep the lists are read first.
FIRST = 16


def scaled(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component as a long, or null for a vector that takes no part."""
    fine = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Block:
    """Candidates with a sorted list for each dimension; ``scored`` counts the scores computed so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # by dimension, ascending
        self.floats = vectors.astype(float)
        self.largest = int(np.abs(vectors).max()) if vectors.size else 0
        self.scored = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (place of the query, id, score) of the best k candidates of each query.

        ``floors``: scores that at least k candidates elsewhere reach (the least integer where unknown);
        candidates below them may be left out.
        """
        n, dims = self.vectors.shape
        least = np.iinfo(np.int64).min
        floors = np.full(len(queries), least) if floors is None else floors.astype(np.int64)
        # products that fit 53 bits are exact in floating point, which multiplies faster
        exact = self.largest * int(np.abs(queries).max(initial=0)) * max(1, dims) < 1 << 53
        vectors, asked = (self.floats, queries.astype(float)) if exact else (self.vectors, queries)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        going, seen, depth, step = np.arange(len(queries)), np.zeros(n, bool), 0, FIRST
        dim = np.arange(dims)
        while len(going):
            end = min(n, depth + step)
            up, down = (queries[going] > 0).any(0), (queries[going] < 0).any(0)
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - end : n - depth].ravel()] = True
            fresh[self.order[down, depth:end].ravel()] = True
            if not (up.any() or down.any()):  # only queries of zeros: every score is 0
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            for start in range(0, len(new), CHUNK):
                part = new[start : start + CHUNK]
                best = self._merge(best, query_ids, going, (asked[going] @ vectors[part].T).astype(np.int64), part, k, floors)
            if end == n or seen.all():
                break
            q = queries[going]
            bound = np.where(q > 0, q, 0) @ self.vectors[self.order[:, n - end], dim] + np.where(q < 0, q, 0) @ self.vectors[self.order[:, end - 1], dim]
            going = going[bound >= floors[going]]
            depth, step = end, step * 2
        return best

    def _merge(self, best: tuple, query_ids: np.ndarray, going: np.ndarray, scores: np.ndarray, part: np.ndarray, k: int, floors: np.ndarray) -> tuple:
        """The best k of each query from those so far and new scores; raises the floors to the kth scores."""
        self.scored += scores.size
        others = self.ids[part][None, :] != query_ids[going][:, None]
        at = floors[going]
        if scores.shape[1] > k:
            # the kth of the new scores alone; own rows count as the least
            kth = np.partition(np.where(others, scores, np.iinfo(np.int64).min), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            at = np.maximum(at, kth)
        row, column = np.nonzero((scores >= at[:, None]) & others)
        place = np.concatenate([best[0], going[row]])
        ids = np.concatenate([best[1], self.ids[part[column]]])
        found = np.concatenate([best[2], scores[row, column]])
        order = np.lexsort((ids, -found, place))
        place, ids, found = place[order], ids[order], found[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        last = rank == k - 1
        floors[place[last]] = np.maximum(floors[place[last]], found[last])
        keep = rank < k
        return place[keep], ids[keep], found[keep]


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best candidates of each query in each block.

    rows: block, dims, kind (0 candidate, 1 query), id, v, floor. Blocks are sorted to begin with their candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for whole in batches:
            codes = np.stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("block", "dims", "kind")], 1)
            edges = np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(codes)]):
                piece, (number, dims, kind) = whole.slice(start, stop - start), codes[start].tolist()
                ids = piece.column("id").to_numpy()
                vectors = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
                if (number, dims) != key:
                    key, parts, block = (number, dims), [], None
                if kind == 0:
                    parts.append((ids, vectors))
                    continue
                if block is None and parts:
                    block = Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    parts = []
                if block is None:
                    continue
                floors = piece.column("floor").to_numpy()
                for at in range(0, len(ids), QUERIES):
                    some = slice(at, at + QUERIES)
                    place, found, scores = block.search(ids[some], vectors[some], k, floors[some])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][place]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    dealt = rows.repartition("block", "dims").sortWithinPartitions("block", "dims", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` holds."""
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), scaled(F.col(embedding), scale).alias("v"), is_query.alias("q")).where("v is not null")
    rows = rows.withColumn("dims", F.size("v"))
    blocks = max(1, -(-rows.count() // candidates))
    home = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    least = F.lit(np.iinfo(np.int64).min)
    columns = ["block", "dims", "kind", "id", "v", "floor"]
    held = rows.withColumns({"block": home, "kind": F.lit(0), "floor": least}).select(columns)
    asked = rows.where("q").dropDuplicates(["id", "v"]).withColumns({"block": home, "kind": F.lit(1), "floor": least})
    near = cut(_searched(held.union(asked.select(columns)), k))
    if blocks > 1:
        kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "kth")
        known = asked.drop("floor").join(kth, "id", "left").withColumn("floor", F.coalesce("kth", least)).drop("kth")
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("block"))
        far = known.withColumn("block", F.explode(others))
        near = near.union(_searched(held.union(far.select(columns)), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
