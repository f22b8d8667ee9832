"""Alignment of two tokenizers on the bytes of each text.

The tokens of a text by either tokenizer cover its bytes. Byte-owner arrays (``np.repeat`` of the tokens' numbers
over their bytes) tell which token of each has a byte: the consecutive distinct pairs of owners are the overlaps, and
where both owners change at once is a cut. Cuts part the tokens into groups; at the end of each group a token of
either ends, and these two are linked. Links are counted over all texts, by pairs of ids.

The first tokenizer is a byte-level one of the ``tokenizers`` library, the second a SentencePiece model that puts a
space before the text; the first gets that space too. Neither joins a sign with the blank or line feed that follows
it, so that texts are aligned in parts that begin there; new parts of a batch are aligned together, in one
array, and kept in a bounded dictionary.

In a linked pair the bytes of one token end with those of the other. A token of n bytes has n endings, so that a pair
of vocabularies has at most as many pairs of ids as their tokens have bytes: 492,481 for the given two (324,302 exist).
The table of counts is therefore bounded by the vocabularies whatever the texts, and goes to all tasks.

Null and empty texts, and texts that the tokens of either don't spell (a text with the sign that SentencePiece has for
the space), have no tokens: zeros and an empty string. Equal rows and null ids are kept each, texts may be of any
length, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_tokens import ByteTokens
from .common import beside
from .piece_codec import SPACE, PieceCodec

#: What a part gives: its groups, the keys of its links, and how many tokens of either it has.
Part = tuple[bytes, bytes, int, int]
#: A part that its tokens don't spell; a text that has one has a negative number of tokens.
UNSPELT: Part = (b"", b"", -(1 << 60), 0)


def owners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the tokens that have it, from the numbers of bytes of the tokens of either."""
    return np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs of tokens that share a byte, in order, as rows."""
    of_a, of_b = owners(a, b)
    new = np.ones(len(of_a), bool)
    new[1:] = (of_a[1:] != of_a[:-1]) | (of_b[1:] != of_b[:-1])
    return np.stack([of_a[new], of_b[new]], 1)


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of either in each group: the pairs that end together."""
    of_a, of_b = owners(a, b)
    last = np.append(np.flatnonzero((of_a[1:] != of_a[:-1]) & (of_b[1:] != of_b[:-1])), len(of_a) - 1)
    return of_a[last], of_b[last]


class Aligner:
    """Aligns texts, part by part."""

    def __init__(self, a_path: str, b_path: str, cache_size: int = 100_000) -> None:
        import sentencepiece

        self.a, self.b = ByteTokens(a_path, plain=True, cache_size=20_000), PieceCodec(b_path, cache_size=20_000, pair_cache_size=50_000)
        self.b_library = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self.a.token_bytes
        self.b_bytes = [bytes([self.b.byte_values[i]]) if i in self.b.byte_values else p.replace(SPACE, " ").encode() for i, p in enumerate(self.b.pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in all_], np.int64) for all_ in (self.a_bytes, self.b_bytes))
        self.marks = self.b.marks
        self._spaced = np.array([p[:1] == SPACE for p in self.b.pieces])
        self.key_type = np.dtype(key_type(len(self.a_bytes), len(self.b_bytes)))
        self._recent: dict[str | tuple[str], Part] = {}
        self._older: dict[str | tuple[str], Part] = {}
        self._size = cache_size

    def _parts(self, text: str) -> list[str] | list[tuple[str]]:
        """Keys of the parts of a text with a space before it; a text that can't be cut is one part, in a tuple."""
        return (self.a.parts(" " + text) if self.b.cuttable else []) or [(text,)]

    def _learn(self, keys: list[str | tuple[str]]) -> None:
        """Align new parts; of a word with marks after it the word and the marks, since no token has parts of both."""
        recent, marked, wanted = self._recent, [], set()
        for key in keys:
            core = key.rstrip(self.marks) if isinstance(key, str) and not key.isalpha() else ""
            if core and core != key and core.isalpha() and core[-1] < "\u0530":  # a letter in all versions of Unicode
                marks = "\0" + key[len(core) :]
                marked.append((key, core, marks))
                wanted.update((core, marks))
            else:
                wanted.add(key)
        self._learn_whole([k for k in wanted if k not in recent])
        for key, core, marks in marked:
            one, other = recent[core], recent[marks]
            recent[key] = (one[0] + b";" + other[0], one[1] + other[1], one[2] + other[2], one[3] + other[3])

    def _learn_whole(self, keys: list[str | tuple[str]]) -> None:
        """Align parts, all in one array."""
        parts = [k for k in keys if isinstance(k, str)]
        whole = [k for k in keys if not isinstance(k, str)]
        keys = parts + whole
        texts = [*map(self.a.part_text, parts), *(" " + k[0] for k in whole)]
        a_ids = self.a.of_parts(parts) + self.a.encode_whole(texts[len(parts) :])
        b_ids = self._second(texts[: len(parts)]) + [self.b.encode(k[0])[4:-4] for k in whole]
        data = [t.encode() for t in texts]
        if not self._spell(b"".join(a_ids), b"".join(b_ids), b"".join(data)):
            spelt = [bool(d) and self._spell(*x) for *x, d in zip(a_ids, b_ids, data, data)]
            self._recent.update((k, UNSPELT if d else (b"", b"", 0, 0)) for k, d, ok in zip(keys, data, spelt) if not ok)
            keys, a_ids, b_ids, data = ([x for x, ok in zip(all_, spelt) if ok] for all_ in (keys, a_ids, b_ids, data))
        if not keys:
            return
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a_ids, b_ids))
        last_a, last_b = links(self.a_sizes[a], self.b_sizes[b])
        packed = (a[last_a] * len(self.b_bytes) + b[last_b]).astype(self.key_type).tobytes()
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, at_a, at_b = [], 0, 0
        for end_a, end_b in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            one = names_a[at_a] if end_a - at_a == 1 else ",".join(names_a[at_a:end_a])
            groups.append(f"{one}|{names_b[at_b] if end_b - at_b == 1 else ','.join(names_b[at_b:end_b])}")
            at_a, at_b = end_a, end_b
        # the groups of a part are those whose last token of the first tokenizer is one of its tokens
        ends = np.searchsorted(last_a, np.cumsum([len(x) // 4 for x in a_ids])).tolist()
        start, width = 0, self.key_type.itemsize
        for key, end, x, y in zip(keys, ends, a_ids, b_ids):
            self._recent[key] = (";".join(groups[start:end]).encode(), packed[width * start : width * end], len(x) // 4, len(y) // 4)
            start = end

    def _second(self, texts: list[str]) -> list[bytes]:
        """Ids of parts by the second tokenizer: words of letters many at once, told apart by their spaces."""
        out: dict[str, bytes] = {}
        words = [t for t in texts if t[:1] == " " and t[1:].isalpha()] if self.b.dummy_prefix else []
        for start in range(0, len(words), 2000):
            chunk = words[start : start + 2000]
            ids = np.array(self.b_library.encode("".join(chunk)[1:]), "<u4")
            starts = (4 * np.flatnonzero(self._spaced[ids])).tolist()
            if len(starts) == len(chunk):
                packed = ids.tobytes()
                out.update(zip(chunk, [packed[x:y] for x, y in zip(starts, [*starts[1:], len(packed)])]))
        return [out[t] if t in out else self.b.part_ids(t.replace(" ", SPACE)) for t in texts]

    def _spell(self, a: bytes, b: bytes, data: bytes) -> bool:
        """Whether the tokens of both have just these bytes."""
        return all(b"".join(map(all_.__getitem__, memoryview(ids).cast("I"))) == data for all_, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def align(self, texts: list[str | None]) -> list[Part]:
        """Groups, keys of links and numbers of tokens of each text."""
        if len(self._recent) > self._size:
            self._older, self._recent = self._recent, {}
        recent, older = self._recent, self._older
        split = [self._parts(t) if t else [] for t in texts]
        missing = set().union(*split) - recent.keys()
        if older:
            known = missing & older.keys()
            recent.update((k, older[k]) for k in known)
            missing -= known
        self._learn(list(missing))
        out = []
        for keys in split:
            groups, packed, n_a, n_b = zip(*map(recent.__getitem__, keys)) if keys else ((), (), (), ())
            out.append((b";".join(filter(None, groups)), b"".join(packed), sum(n_a), sum(n_b)) if sum(n_a) > 0 else (b"", b"", 0, 0))
        for key in missing:
            if len(key if isinstance(key, str) else key[0]) > 256:  # long parts don't come again
                del recent[key]
        return out


def key_type(size_a: int, size_b: int) -> str:
    """The type of the keys of pairs: the number of the first id times the size of the second vocabulary, plus the second."""
    return "<u4" if size_a * size_b < 1 << 32 else "<u8"


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """``df`` without its text, with n_a, n_b, n_groups, groups, link_keys and link_times.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of the groups in order; with ``digest`` their SHA-256 in its place, an empty
    string without tokens, so that the strings, longer than the texts, stay where they are made. ``link_keys``: the distinct keys of the links,
    ascending (``key_type``); ``link_times``: how often the text has each, as little-endian unsigned 32-bit integers.
    """
    added = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups", T.StringType()), ("link_keys", T.BinaryType()), ("link_times", T.BinaryType())]
    read = df.select(beside(df, text, *(n for n, _ in added)), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([read.schema["row"], *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # so that a batch of long texts isn't held several times
                batch = whole.slice(start, 256)
                rows = []
                for groups, packed, n_a, n_b in aligner.align(batch.column(1).to_pylist()):
                    keys = np.frombuffer(packed, aligner.key_type)
                    distinct, times = np.unique(keys, return_counts=True)
                    if digest:
                        groups = hashlib.sha256(groups).hexdigest().encode() if n_a else b""
                    rows.append((n_a, n_b, len(keys), groups, distinct.tobytes(), times.astype("<u4").tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                columns[3] = columns[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return read.mapInArrow(run, schema).select("row.*", *(n for n, _ in added))


def link_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """a_id, b_id, n, best: how many links of all texts hold each pair, and whether that is the most of its second id."""
    kind = key_type(size_a, size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, kind), np.zeros(0, np.int64)  # one entry for each pair of ids
        for batch in batches:
            new = [np.frombuffer(b"".join(batch.column(i).to_pylist()), k) for i, k in ((0, kind), (1, "<u4"))]
            keys, place = np.unique(np.concatenate([keys, new[0]]), return_inverse=True)
            both = np.concatenate([times, new[1].astype(np.int64)])
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, place, both)
        for start in range(0, len(keys), 10_000):
            part = keys[start : start + 10_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part // size_b), pa.array(part % size_b), pa.array(times[start : start + 10_000])], names=["a_id", "b_id", "n"])

    counts = aligned.select("link_keys", "link_times").mapInArrow(run, "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(aligned: DataFrame, counts: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """``aligned`` with n_best (links whose count is the highest of their second id) and count_sum (over the links).

    ``counts`` has a row for each pair of ids that occurs: its size is bounded by the vocabularies.
    """
    kind = key_type(size_a, size_b)
    table = counts.toPandas()
    keys = (table["a_id"].to_numpy() * size_b + table["b_id"].to_numpy()).astype(kind)
    order = np.argsort(keys)
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order], table["n"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))
    read = aligned.select(beside(aligned, "n_best", "count_sum"), F.col("link_keys"), F.col("link_times"))
    schema = T.StructType([read.schema["row"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, best = shared.value
        for batch in batches:
            out = []
            for packed, repeated in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, times = np.searchsorted(known, np.frombuffer(packed, kind)), np.frombuffer(repeated, "<u4").astype(np.int64)
                out.append((int(times[best[at]].sum()), int((times * counted[at]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*out))], names=schema.names)

    return read.mapInArrow(run, schema).select("row.*", "n_best", "count_sum")
