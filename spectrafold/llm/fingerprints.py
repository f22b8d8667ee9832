"""Threshold-scaled sketches of documents.

A sketch keeps every hash of a document's shingles (five words; all words of a shorter text) that lies
below a fixed fraction of the hash range. Sketches of parts of a corpus merge by union, and the share of
one sketch found in another estimates containment whatever the two sizes. A text none of whose hashes
lies below the fraction keeps its smallest hash, so that no sketch is empty; ``merge`` drops such hashes
where a part has others, so that the merged sketch is that of the whole.

``fingerprint`` works on a column; ``compare_with_next`` also sketches an edited text of each document and
compares it, and the document that follows, with the document. Followers are found on ids alone, by a
range sort; the heads of the following texts are then joined by key.

Defined results: null texts count as empty; an empty text has one shingle, the empty word. Equal rows (same
id, same text) count once; rows with the same id and other texts follow one another by a hash of the text;
null ids come last. A single document is its own follower; an empty table gives none. Texts may be of any
length. Columns other than the id and the text are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

WORDS = 5
#: The share of all hashes that is kept.
FRACTION = 0.25


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of so many words of a text, white space and case apart."""
    split = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
    return let(split, lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, words))))


def _below(hashes: Column, fraction: float) -> Column:
    return F.filter(hashes, lambda h: h < F.lit(-(1 << 63) + int(fraction * (1 << 64)))) if fraction < 1 else hashes


def sketch(text: Column, fraction: float = FRACTION, words: int = WORDS) -> Column:
    """The sorted, distinct hashes below ``fraction`` of the range, or the smallest one."""

    def low(hashes: Column) -> Column:
        kept = _below(hashes, fraction)
        return let(kept, lambda k: F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).otherwise(F.array(F.array_min(hashes))))

    return let(shingle_hashes(text, words), low)


def merge(sketches: Column, fraction: float = FRACTION) -> Column:
    """The sketch of a whole from an array of sketches of its parts."""
    every = F.array_sort(F.array_distinct(F.flatten(sketches)))
    return let(every, lambda x: let(_below(x, fraction), lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(x, 1, 1))))


def fingerprint(hashes: Column) -> Column:
    """A sketch as a string: hexadecimal hashes joined by commas."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of the shingles of ``part`` that ``whole`` has."""
    return F.size(F.array_intersect(part, whole)) / F.size(part)


def likeness(one: Column, other: Column) -> Column:
    """The larger containment of the two: the share of the smaller sketch found in the other."""
    return F.size(F.array_intersect(one, other)) / F.least(F.size(one), F.size(other))


def _followers(keys: DataFrame) -> DataFrame:
    """For each key (_k, _l) the document that it follows, in descending order of ids: _pd, _pk, _pl, _half."""
    ordered = cut(keys.orderBy(F.desc_nulls_last("_d"), "_k", "_l").withColumn("_at", F.monotonically_increasing_id()))
    # the ids of one partition are consecutive; there are only as many rows here as partitions
    sizes = sorted(ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if not total:
        return ordered.select("_k", "_l", F.col("_d").alias("_pd"), F.col("_k").alias("_pk"), F.col("_l").alias("_pl"), "_half")
    offsets = keys.sparkSession.createDataFrame(starts, "p long, start long")
    ranked = ordered.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("p")).withColumn("_rank", F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = ranked.select(F.col("_d").alias("_pd"), F.col("_k").alias("_pk"), F.col("_l").alias("_pl"), "_half", ((F.col("_rank") + 1) % total).alias("_rank"))
    return ranked.select("_k", "_l", "_rank").join(before, "_rank").drop("_rank")


def compare_with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited_text, sketch, edited_sketch, next_sketch of each document.

    The edited text is the text whose last half (rounded down) gives way to as many code points from the
    start of the next document, by descending id; after the last document comes the first.
    """
    rows = df.select(F.col(doc_id).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumns({"_k": F.xxhash64("_d", "_t"), "_l": F.xxhash64(F.lit(1), "_d", "_t")})
    half = F.floor(F.char_length("_t") / 2).cast("int")
    keys = rows.select("_d", "_k", "_l", half.alias("_half")).distinct()
    # both uses of the texts need the same columns, so that they are shuffled once
    docs = rows.select("_k", "_l", "_t").dropDuplicates(["_k", "_l"])
    held = docs.join(_followers(keys), ["_k", "_l"])
    guests = held.select(F.col("_pk").alias("_k"), F.col("_pl").alias("_l"), "_pd", F.expr("substring(_t, 1, _half)").alias("_head"), sketch(F.col("_t")).alias("next_sketch"))
    both = docs.join(guests, ["_k", "_l"])
    edited = F.concat(F.expr("substring(_t, 1, char_length(_t) - cast(floor(char_length(_t) / 2) as int))"), F.col("_head"))
    return both.select(F.col("_pd").alias("doc_id"), F.col("_t").alias("text"), edited.alias("edited_text"), "next_sketch").select(
        "doc_id", "text", "edited_text", sketch(F.col("text")).alias("sketch"), sketch(F.col("edited_text")).alias("edited_sketch"), "next_sketch"
    )
