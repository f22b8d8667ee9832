"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the set of its shingles (five words, lower case), each weighted by how often it occurs. For
each shingle, points of a Poisson process with the shingle's weight as its rate arrive one after another,
each at a random register; a register keeps the shingle of its earliest point. A document is done once no
shingle can arrive before the latest of its registers. Two documents agree in a register with the
probability Jaccard similarity of their weights. Bands of registers give buckets; candidates are verified
on their whole shingles: a pair is a link if its exact probability Jaccard similarity is 0.8 or more, the
measure that the registers estimate. Where all weights are equal that is the Jaccard similarity of the sets;
where they aren't, a pair that met in a bucket is also a link if the sets alone reach 0.8. Classes are the
connected components of the links, named by their smallest document id.

Documents with equal shingle sets are collapsed first, so that copies cost one row each. In a bucket every
document is compared with the smallest one, then, where a bucket holds more than one class, all documents
of different classes, block against block; every pair is verified, unless a link has joined its classes
already. There is no cap on buckets or candidates. Joins on sets, buckets, centres and labels, of which one
may have any share of the rows, are salted. Shingles are computed again for documents in buckets with
others, and are neither kept nor shuffled for the rest.

Defined results: one row for each row of the table. Documents without a word, and null texts, are classes
of their own; texts of less than five words are one shingle. Null ids get a null class. Ids of whole numbers
are compared as such, others as strings. Ids are taken as unique: equal rows are one document, and rows of
one id with different texts are linked through that id. Texts may be of any length: the blocks of a bucket
are dealt by shingles as well as by documents. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stores
from .common import cut, free, fresh, row_hash, shuffle_partitions, spread_join

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 21, 6
#: Documents of a bucket, and shingles of them, that a block holds; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Ids of documents in buckets with others that are sent to all workers (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of the shingles of texts; word hashes are kept in a bounded dictionary."""

    def __init__(self, words: int = WORDS, cache_size: int = 300_000) -> None:
        self.words, self.size = words, cache_size
        self.known: dict[str, int] = {}
        self.find = re.compile(r"\w+").findall

    def hashes(self, text: str | None) -> np.ndarray:
        """The hash of each shingle, repeats included; none for a text without a word."""
        found = self.find((text or "").lower())
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > self.size:
            self.known.clear()
        known, out = self.known, []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        one = np.array(out, np.uint64)
        n = min(self.words, len(one))
        total = np.zeros(len(one) - n + 1, np.uint64)
        for i in range(n):
            total = _mix(total * _ODD + one[i : i + len(total)])
        return _mix(total + np.uint64(n))


def prob_minhash(docs: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of registers for each document, given by its distinct shingles and their weights."""
    count = len(docs)
    first = np.full(count * registers, np.inf)
    owner = np.zeros(count * registers, np.uint64)
    doc = np.repeat(np.arange(count), [len(s) for s, _ in docs])
    element = np.concatenate([s for s, _ in docs]) if docs else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in docs]) if docs else np.empty(0)
    arrival, turn = np.zeros(len(element)), 0
    with np.errstate(over="ignore"):
        while len(element):
            turn += 1
            bits = _mix(element + np.uint64(turn) * _ODD)
            arrival = arrival - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight
            at = doc * registers + (_mix(bits ^ _ODD) % np.uint64(registers)).astype(np.int64)
            sooner = np.flatnonzero(arrival < first[at])
            sooner = sooner[np.argsort(-arrival[sooner], kind="stable")]  # of several, the earliest is written last
            first[at[sooner]], owner[at[sooner]] = arrival[sooner], element[sooner]
            latest = first.reshape(count, registers).max(1)
            going = np.flatnonzero(arrival < latest[doc])
            doc, element, weight, arrival = doc[going], element[going], weight[going], arrival[going]
    return owner.reshape(count, registers)


def portions(docs: list[tuple[np.ndarray, np.ndarray]], shingles: int = 100_000) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The documents in portions of about so many shingles, so that few long ones don't take much memory at once."""
    part, size = [], 0
    for doc in docs:
        part.append(doc)
        size += len(doc[0])
        if size >= shingles:
            yield part
            part, size = [], 0
    if part:
        yield part


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both)


def probability_jaccard(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two sorted arrays of distinct values with the weights a and b.

    The sum over common values z of 1 / sum over all y of max(a[y] / a[z], b[y] / b[z]); common values of
    equal weights have equal terms.
    """
    values = np.union1d(one, other)
    left, right = np.zeros(len(values)), np.zeros(len(values))
    left[np.searchsorted(values, one)], right[np.searchsorted(values, other)] = a, b
    both = (left > 0) & (right > 0)
    pairs, counts = np.unique(np.stack([left[both], right[both]], 1), axis=0, return_counts=True)
    return float(sum(n / np.maximum(left / x, right / y).sum() for (x, y), n in zip(pairs, counts)))


class Shingled:
    """The shingles of a document and their weights, read from bytes."""

    def __init__(self, shingles: bytes, weights: bytes | None) -> None:
        self.shingles = np.frombuffer(shingles, np.uint64)
        self.weights = np.frombuffer(weights, np.uint32).astype(float) if weights else None

    def weighted(self, other: Shingled) -> float:
        """Probability Jaccard similarity; 0 where no weight differs from 1, so that it says nothing new."""
        if self.weights is None and other.weights is None:
            return 0.0
        one, two = (d.weights if d.weights is not None else np.ones(len(d.shingles)) for d in (self, other))
        return probability_jaccard(self.shingles, one, other.shingles, two)

    def links(self, other: Shingled, threshold: float) -> bool:
        return similarity(self.shingles, other.shingles) >= threshold or self.weighted(other) >= threshold


def _id_type(df: DataFrame, doc_id: str) -> str:
    return "long" if isinstance(df.schema[doc_id].dataType, T.IntegralType) else "string"


def _set_hashes(docs: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of a 128-bit hash of each array; nulls for empty ones."""
    whole = [xxhash.xxh128_intdigest(s.tobytes()) if len(s) else None for s in docs]
    low, sign = (1 << 64) - 1, 1 << 63
    return [pa.array([None if x is None else ((x >> shift & low) ^ sign) - sign for x in whole], pa.int64()) for shift in (0, 64)]


def sketches(df: DataFrame, doc_id: str, text: str, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc, the hash of the shingle set (set_a, set_b), n (its size) and band keys of each row; only doc without id or word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = stores.shared(("shingles", words), lambda: Shingles(words))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = batch.column(0)
                found = [np.unique(shingles.hashes(t if known else None), return_counts=True) for known, t in zip(ids.is_valid().to_pylist(), batch.column(1).to_pylist())]
                docs = [(s, c.astype(float)) for s, c in found if len(s)]
                owner = np.concatenate([np.empty((0, bands * rows), np.uint64), *(prob_minhash(part, bands * rows) for part in portions(docs))])
                keys = np.zeros((len(docs), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = _mix(keys * _ODD + owner[:, r * bands : (r + 1) * bands])
                    keys = _mix(keys + np.arange(bands, dtype=np.uint64))
                made = iter(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        *_set_hashes([s for s, _ in found]),
                        pa.array([len(s) for s, _ in found], pa.int64()),
                        pa.array([next(made) if len(s) else None for s, _ in found], pa.list_(pa.int64())),
                    ],
                    names=["doc", "set_a", "set_b", "n", "bands"],
                )

    kind = _id_type(df, doc_id)
    picked = df.select(F.col(doc_id).cast(kind).alias("doc"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc {kind}, set_a long, set_b long, n long, bands array<long>")


def shingle_sets(df: DataFrame, ids: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """doc, set_a, sorted shingles and their weights (null: all 1) of the documents in ``ids`` (one column, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = stores.shared(("shingles", words), lambda: Shingles(words))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = [np.unique(shingles.hashes(t), return_counts=True) for t in batch.column(1).to_pylist()]
                weights = [c.astype(np.uint32).tobytes() if len(c) and c.max() > 1 else None for _, c in found]
                columns = [batch.column(0), _set_hashes([s for s, _ in found])[0], pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array(weights, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "set_a", "shingles", "weights"]).filter(pa.array([len(s) > 0 for s, _ in found], pa.bool_()))

    kind = _id_type(df, doc_id)
    rows = df.select(F.col(doc_id).cast(kind).alias("doc"), F.col(text).alias("text"))
    picked = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi").select("doc", "text")
    # equal rows once; rows of one id with other texts each
    return picked.mapInArrow(run, f"doc {kind}, set_a long, shingles binary, weights binary").dropDuplicates(["doc", "set_a"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough; one document may be the ``a`` of any share of them."""
    names = [f"{c}_{s}" for s in "ab" for c in ("shingles", "weights")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                columns = [batch.column(n).to_pylist() for n in names]
                keep = [Shingled(x, v).links(Shingled(y, w), threshold) for x, v, y, w in zip(*columns)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("doc").alias(s), F.col("shingles").alias(f"shingles_{s}"), F.col("weights").alias(f"weights_{s}"))
    held = spread_join(pairs, side("a"), ["a"], "b").join(side("b"), "b").select("a", "b", *names)
    return held.mapInArrow(run, pairs.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its connected component) of every node of the links (a, b).

    Labels spread along links and by jumping to the label of the label; the links stay as they are. Links of
    one node, and nodes of one label, are dealt over salts.
    """
    salts = shuffle_partitions(links.sparkSession)
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = cut(both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")))
    ends = cut(both.select("b", "salt").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        new = _spread(both, ends, labels)
        changed = new.where("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        free(links.sparkSession)  # the files of a round are as large as the links, however many rounds there are
        if not changed:
            return labels


def _spread(both: DataFrame, ends: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label and next (the smaller label that it gets) after one round of ``components``."""
    carried = ends.join(labels.select(F.col("node").alias("b"), "label"), "b")
    near = both.join(carried, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
    lower = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
    jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
    return cut(spread_join(lower, jump, ["next"], "node").select("node", "label", F.least("next", "far").alias("next")))


def _crossing(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of a bucket with different labels, as many as it takes to join them.

    members: bucket, band, blocks, doc, label, bands, shingles, weights. A bucket is dealt into blocks; each
    pair of blocks is one group, so that no group is larger than two blocks (and what chance adds). A pair is
    verified in the first band that it shares, unless links found in this group already join its labels.
    """
    kind = members.schema["doc"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def compare(table: pa.Table) -> pa.Table:
        docs, own = table["doc"].to_numpy(), table["block"].to_numpy()
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(docs), -1)[:, :band]  # those before this band
        held = [Shingled(s, w) for s, w in zip(table["shingles"].to_pylist(), table["weights"].to_pylist())]
        sizes, plain = np.array([len(h.shingles) for h in held]), np.array([h.weights is None for h in held])
        values, places = np.unique(np.concatenate([h.shingles for h in held]), return_inverse=True)
        places = np.split(places, np.cumsum(sizes)[:-1])
        marked = np.zeros(len(values), bool)
        # shares of the weight: the sum of the lesser shares bounds the probability Jaccard similarity from above
        shares = [(np.ones(len(h.shingles)) if h.weights is None else h.weights) for h in held]
        shares = [w / w.sum() for w in shares]
        part = np.zeros(len(values))
        group = np.unique(table["label"].to_numpy(), return_inverse=True)[1]  # labels that links join become equal
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[tuple] = []
        for k in left:
            others = right[(group[right] != group[k]) & ((docs[right] > docs[k]) | (i != j))]
            # without weights the similarity is at most the ratio of the sizes
            near = np.minimum(sizes[others], sizes[k]) >= threshold * np.maximum(sizes[others], sizes[k])
            others = others[near | ~(plain[others] & plain[k])]
            others = others[~(keys[others] == keys[k]).any(1)]
            if not len(others):
                continue
            marked[places[k]] = True
            starts = np.cumsum(sizes[others]) - sizes[others]
            where = np.concatenate([places[o] for o in others])
            both = np.add.reduceat(marked[where], starts, dtype=np.int64)
            marked[places[k]] = False
            links = both / (sizes[k] + sizes[others] - both) >= threshold
            open_ = ~links
            if not (plain[k] and plain[others].all()):
                part[places[k]] = shares[k]
                open_ &= np.add.reduceat(np.minimum(part[where], np.concatenate([shares[o] for o in others])), starts) >= threshold - 1e-9
                part[places[k]] = 0
            else:
                open_[:] = False
            for o, linked in zip(others[links | open_], links[links | open_]):
                if group[o] != group[k] and (linked or held[k].weighted(held[o]) >= threshold):
                    group[group == group[o]] = group[k]
                    found.append((docs[k], docs[o]))
        columns = list(zip(*found)) or [()] * 2
        return pa.table({"a": pa.array(columns[0], arrow), "b": pa.array(columns[1], arrow)})

    dealt = members.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", "doc", "label", "bands", "shingles", "weights", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of every row: the smallest document id of its class."""
    sketched = cut(sketches(df, doc_id, text, words, bands, rows))
    worded = sketched.where("set_a is not null")
    alone = cut(worded.groupBy("set_a", "set_b").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.min_by("bands", "doc").alias("bands")))
    buckets = alone.select("doc", "n", F.posexplode("bands").alias("band", "bucket"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    shared = buckets.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("last"), blocks.alias("blocks")).where("centre < last").drop("last")
    members = cut(spread_join(buckets.drop("n"), shared, ["bucket"], "doc"))
    sets = cut(shingle_sets(df, members.select("doc").distinct(), doc_id, text, words))
    free(df.sparkSession)
    stars = members.where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    links = cut(verified(stars, sets, threshold))
    # buckets that hold more than one class: all of their members, not only those next to the centre
    labelled = members.join(components(links).withColumnRenamed("node", "doc"), "doc", "left")
    labelled = cut(labelled.select("bucket", "band", "blocks", "doc", F.coalesce("label", "doc").alias("label")))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    opened = spread_join(labelled, mixed, ["bucket"], "doc").join(sets.join(alone.select("doc", "set_a", "bands"), ["doc", "set_a"]).drop("set_a"), "doc")
    crossing = cut(_crossing(opened, threshold))
    free(df.sparkSession)
    final = components(links.union(crossing)).withColumnRenamed("node", "doc")
    classes = alone.join(final, "doc", "left").select("set_a", "set_b", F.coalesce("label", "doc").alias("class_id"))
    told = spread_join(worded.select("doc", "set_a", "set_b"), classes, ["set_a", "set_b"], "doc").select("doc", "class_id")
    rest = sketched.where("set_a is null").select("doc", F.col("doc").alias("class_id"))
    return told.union(rest).select(F.col("doc").cast(df.schema[doc_id].dataType).alias("doc_id"), "class_id")


def first_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``df`` that stay if one document of each class does: the one with the smallest id.

    Rows without an id stay. Of rows equal in id and text one stays, the first in an order of their hashes;
    rows of that id with other texts stay as well.
    """
    classes = near_duplicates(df, doc_id, text, **options)
    firsts = classes.where("cast(doc_id as string) = cast(class_id as string)").select(F.col("doc_id").alias(doc_id)).distinct()
    nth = fresh(df, "nth")
    order = Window.partitionBy(doc_id, F.xxhash64(F.col(text)), F.col(text).isNull()).orderBy(row_hash(df))
    once = df.join(firsts, doc_id, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return once.select(*[f"`{c}`" for c in df.columns]).union(df.where(F.col(doc_id).isNull()))
