"""Language identification by sparse multinomial logistic regression.

A text is its letters in lower case, anything else being one blank, as runs of one to three characters
(hashed into ``BUCKETS``), weighted by (1 + log tf) * idf and scaled to length one. Document frequencies
are counted over all rows that may be learned from. The weights are trained by follow-the-regularised-
leader with an absolute and a squared penalty on a sample of at most ``sample`` rows of each language, and
about ``total`` of all; a fifth of it is held back, and the temperature that suits its labels best divides
the scores before they become probabilities.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything where no
row can be learned from. Rows with a null language are not learned from. With one language, that is the
answer for every text with a letter. Of equally likely languages the first in the alphabet is told. Rows are
drawn by a hash of id and text, so that null and repeated ids are no special case; equal rows are predicted
each. Texts may be of any length; an empty table gives an empty one. All columns are kept, whatever their
names; ``lang_pred`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stores
from .common import from_driver, portions, texts, unit_hash

BITS = 15
BUCKETS = 1 << BITS
UNKNOWN = "und"
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point the code point of a letter, or a blank."""
    global _table
    if _table is None:
        n = sys.maxunicode + 1
        _table = np.fromiter((i if chr(i).isalpha() else 32 for i in range(n)), np.uint32, n)
    return _table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text's character runs and how often each occurs; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[codes]
    blank = codes == 32
    codes = codes[~(blank & np.append(False, blank[:-1]))]
    found, value = [], np.zeros(len(codes), np.uint32)
    for n in (1, 2, 3):
        value = value[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] * np.uint32(n)
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append(mixed >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def weigh(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[buckets]
    size = np.sqrt(x @ x)
    return x / size if size else x


class Ftrl:
    """Follow-the-regularised-leader for softmax regression, one row of weights for each bucket."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> None:
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z = self.z[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        error = softmax(x @ w)
        error[label] -= 1
        gradient = x[:, None] * error
        square = gradient * gradient
        n = self.n[rows]
        self.z[rows] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + square


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max())
    return p / p.sum()


def temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """The divisor of the scores at which the labels are likeliest, by golden-section search on its logarithm."""
    if not scores:
        return 1.0
    s, y = np.array(scores), np.array(labels)

    def loss(log_t: float) -> float:
        a = s / np.exp(log_t)
        a -= a.max(1, keepdims=True)
        return float((np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        one, two = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, two) if loss(one) <= loss(two) else (one, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    rows: np.ndarray  # of the buckets that have a weight
    weights: np.ndarray
    idf: np.ndarray
    temperature: float


def train(samples: list[tuple[np.ndarray, np.ndarray, int, float]], languages: tuple[str, ...], idf: np.ndarray, epochs: int = 4) -> Model:
    """A model from (buckets, counts, language, draw) of each sampled row; draws under 0.2 only calibrate."""
    bias = np.array([BUCKETS])
    ready = [(np.append(b, bias), np.append(weigh(b, c, idf), 0.2), k, u) for b, c, k, u in samples]
    own = [r for r in ready if r[3] >= 0.2] or ready
    ftrl = Ftrl(len(languages))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(own)):
            ftrl.learn(*own[i][:3])
    w = ftrl.weights(slice(None))
    held = [r for r in ready if r[3] < 0.2]
    t = temperature([x @ w[b] for b, x, _, _ in held], [k for _, _, k, _ in held])
    rows = np.flatnonzero(np.abs(w).max(1) > 0)
    return Model(languages, rows, w[rows], idf, t)


def learn(docs: DataFrame, learn_from: Column | None = None, sample: int = 800, total: int = 20_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """A model from the rows of ``docs`` with a language for which ``learn_from`` holds."""
    usable = docs.where(F.col(lang).isNotNull())
    if learn_from is not None:
        usable = usable.where(learn_from)
    sizes = usable.groupBy(F.col(lang).alias("lang")).count().collect()
    if not sizes:
        return None
    languages = tuple(sorted(r["lang"] for r in sizes))
    picked = usable.select(F.col(text).alias("text"), F.col(lang).alias("lang"), unit_hash(doc_id, text, seed=2).alias("draw"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.release()
        total, count = np.zeros(BUCKETS, np.int64), 0
        for batch in portions(batches):
            for t in batch.column(0).to_pylist():
                if (found := grams(t)) is not None:
                    total[found[0]] += 1
                    count += 1
        rows = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1), pa.int32()), pa.array(np.append(total[rows], count), pa.int64())], names=["bucket", "n"])

    counted = picked.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = {r["bucket"]: r["n"] for r in counted}
    rows_counted = n.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(n)] = list(n.values())
    idf = np.log((1 + rows_counted) / (1 + df)) + 1

    sample = max(1, min(sample, total // len(languages)))
    # twice as many are drawn as expected, of which the first of each language are taken
    rate = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rate", T.DoubleType())])
    rates = from_driver(docs.sparkSession, [(r["lang"], min(1.0, 2 * sample / r["count"])) for r in sizes], rate)
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = []
            for t, k, u in zip(*(c.to_pylist() for c in batch.columns)):
                if (found := grams(t)) is not None:
                    out.append((found[0].astype(np.uint16).tobytes(), found[1].astype(np.uint32).tobytes(), k, u))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.string(), pa.float64()))], names=["b", "c", "lang", "u"])

    # one row for each language
    drawn = picked.join(F.broadcast(rates), "lang").where("draw < rate").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    drawn = drawn.select("text", "lang", (F.xxhash64(F.lit(3), "text", "draw").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("u"))
    rows = sorted(drawn.mapInArrow(sampled, "b binary, c binary, lang string, u double").collect(), key=lambda r: (r["u"], r["lang"], bytes(r["b"]), bytes(r["c"])))
    place = {k: i for i, k in enumerate(languages)}
    samples = [(np.frombuffer(r["b"], np.uint16).astype(np.int64), np.frombuffer(r["c"], np.uint32).astype(float), place[r["lang"]], r["u"]) for r in rows]
    return train(samples, languages, idf) if samples else None


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the calibrated probability of that language."""
    read, told = texts(df, text, "lang_pred", "score")
    schema = T.StructType([read.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.release()
        if model is not None:
            weights = np.zeros((BUCKETS + 1, len(model.languages)))
            weights[model.rows] = model.weights
        for batch in portions(batches):
            best, scores = [], []
            for t in told(batch).to_pylist():
                found = grams(t) if model is not None else None
                if found is None:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                x = weigh(*found, model.idf)
                p = softmax((x @ weights[found[0]] + 0.2 * weights[BUCKETS]) / model.temperature)
                k = int(p.argmax())
                best.append(model.languages[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return read.mapInArrow(run, schema).select("row.*", "lang_pred", "score")
