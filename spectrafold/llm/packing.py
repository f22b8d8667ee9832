"""Packing of tokenised documents into sequences of a fixed capacity.

Documents become token ids by a ``tokenizers`` file, followed by one end id. What fills whole sequences
is cut off first; the rests of a group of documents are spread over windows by Karmarkar-Karp multiway
differencing: the two partial partitions with the greatest imbalance are merged largest sum to smallest
sum, until one is left, whose windows are nearly equal. Whenever a window exceeds the capacity, the number
of windows rises and the differencing runs anew, until all windows hold. Where documents may be cut, the
emptiest windows are then dissolved into the room that the others have, so that hardly any padding is left.

A group is closed when it holds exactly ``group_windows`` full windows; the token run beyond that is
carried into the next group. The last group of a partition of the input gives the full windows that its
tokens fill, and short sequences at powers of two for the rest, which need no padding. Documents are
packed where they are read: no shuffle, and the memory of one group at a time.

Null texts count as empty: such a document has the end id only. Null ids are kept. Equal rows, and rows of
one id, are packed each. A document longer than a window gives whole windows and a rest; a text of any
length is tokenised at once. An empty table gives no pieces. Columns other than the id and the text are
left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import stores

#: The configuration of a tokenizer whose words can be encoded one by one (fixed values of its file).
_BY_WORD = (
    ["NFC", "Replace", "Lowercase"],
    ["Split", "ByteLevel"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
_WORD_END = "</w>"
_MARKS = ",.!?;:"


#: A comma or full stop that belongs to a run of marks, which is one word (the separators from U+001C on aren't
#: white space to the tokenizer).
_RUN = re.compile(r"[,.] (?:(?<=[^\w\s][,.] )|(?<=[_\x1c-\x1f][,.] ))").search


def _ends_in_letter(word: str) -> bool:
    """Whether a word still ends in a letter when it is normalised: a letter that becomes letter and mark doesn't.

    Only letters of the Latin, Greek and Cyrillic blocks count, whose classes are the same in all versions of Unicode.
    """
    last = unicodedata.normalize("NFC", word[-8:]).lower()[-1]
    return last < "\u0530" and last.isalpha()


def _spaced(text: str) -> str:
    """A text whose words are apart by blanks; plain Latin text in lower case, with commas and full stops apart."""
    text = text.replace("\n", " ").replace("\t", " ")
    if "<|" in text:  # could become a special token
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    text = text.lower() + " "
    return text if _RUN(text) else text.replace(", ", " , ").replace(". ", " . ")


class WordTokens:
    """Token ids of texts, with a bounded store of the words met before.

    Splitting at blanks, tabs and line feeds doesn't change the ids of a tokenizer that collapses white
    space and matches words between it; other tokenizers get the whole text.
    """

    def __init__(self, path: str, end_id: int, cache_size: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [(spec.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        pattern = steps[1][0].get("pattern", {}).get("Regex") if steps[1] else None
        self.by_word = ([x["type"] for x in steps[0]], [x["type"] for x in steps[1]], pattern) == _BY_WORD and spec["model"].get("end_of_word_suffix") == _WORD_END
        vocabulary = spec["model"].get("vocab", {}) if self.by_word else {"": 0}
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.end = array("I", [end_id]).tobytes()
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._size = cache_size

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words. Words of Latin letters are encoded many at once and told apart by their last tokens."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
        for start in range(0, len(plain), 1000):
            chunk = plain[start : start + 1000]
            found = self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self._ends_word[ids]) + 1).tolist()
            if len(ends) == len(chunk):
                packed, at = ids.tobytes(), 0
                for w, end in zip(chunk, ends):
                    out[w] = packed[4 * at : 4 * end]
                    at = end
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._encode(rest)))
        return out

    def _learn(self, words: set[str]) -> None:
        """Add words to the recent ones, from the older ones or by the tokenizer."""
        recent, older = self._recent, self._older
        if older:
            known = words & older.keys()
            recent.update((w, older[w]) for w in known)
            words = words - known
        wanted = {w for w in words if w.isalpha() and w.islower()}  # words as they are
        new: dict[str, tuple[str, str]] = {}
        for word in words - wanted:
            core = word.rstrip(_MARKS)
            if core and _ends_in_letter(core) and "'" not in word and "<|" not in word:
                new[word] = (core.lower() if core.isascii() else core, word[len(core) :])
            else:
                new[word] = (word, "")
        parts = {part for pair in new.values() for part in pair if part} - recent.keys()
        known = parts & older.keys()
        recent.update((w, older[w]) for w in known)
        recent.update(self._encode_words(list(wanted | parts - known)))
        for word, (core, marks) in new.items():
            recent[word] = recent[core] + (recent[marks] if marks else b"")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        if not self.by_word:
            return [ids + self.end for ids in self._encode([t or "" for t in texts])]
        if len(self._recent) > self._size:
            self._older, self._recent = self._recent, {}
        split = [_spaced(t or "").split(" ") for t in texts]
        self._recent[""] = b""
        found = [list(map(self._recent.get, words)) for words in split]
        holes = [[i for i, ids in enumerate(got) if ids is None] if None in got else [] for got in found]
        missing = {words[i] for words, at in zip(split, holes) for i in at}
        if missing:
            self._learn(missing)
        out = []
        for words, got, at in zip(split, found, holes):
            for i in at:
                got[i] = self._recent[words[i]]
            got.append(self.end)
            out.append(b"".join(got))
        return out


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the positions of ``sizes`` in each of so many windows of nearly equal sums."""
    if windows == 1:
        return [list(range(len(sizes)))]
    partial: list[np.ndarray | None] = []  # the ascending window sums of each partial partition
    for size in sizes:
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        partial.append(sums)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        merged = partial[i] + partial[j][::-1]
        order = merged.argsort(kind="stable")
        sums = merged[order]
        partial[i] = partial[j] = None
        heapq.heappush(heap, (int(sums[0] - sums[-1]), len(partial)))
        partial.append(sums)
        merges.append((i, j, order))
    # from the last partition back: the window of each place of the two that it was merged from
    window: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)} if heap else {}
    for at in range(len(merges) - 1, -1, -1):
        i, j, order = merges[at]
        places = np.empty(windows, np.int64)
        places[order] = window.pop(len(sizes) + at)
        window[i], window[j] = places, places[::-1]
    out: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(sizes)):
        out[window[i][-1]].append(i)
    return out


Piece = tuple[int, int, int]  # document, start, length


def pack_group(pieces: list[Piece], capacity: int, cut: bool = True) -> list[list[Piece]]:
    """Windows of at most ``capacity`` tokens that hold all pieces, each of which fits one window."""
    sizes = [p[2] for p in pieces]
    least = count = max(1, -(-sum(sizes) // capacity))
    while True:
        held = differencing(sizes, count)
        sums = [sum(sizes[i] for i in w) for w in held]
        over = sum(s - capacity for s in sums if s > capacity)
        if not over:
            break
        count += -(-over // capacity)  # at most so many windows more hold what is over
    order = sorted(range(count), key=lambda w: -sums[w])
    windows = [[pieces[i] for i in held[w]] for w in order]
    if not cut:
        return [w for w in windows if w]
    windows, rest = windows[:least], [p for w in windows[least:] for p in w]
    for w, s in zip(windows, (sums[i] for i in order)):
        room = capacity - s
        while room and rest:
            doc, start, length = rest.pop()
            take = min(room, length)
            w.append((doc, start, take))
            if take < length:
                rest.append((doc, start + take, length - take))
            room -= take
    return [w for w in windows if w]


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in sequences whose lengths are the powers of two that their total is made of."""
    total, out, rest = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        window: list[Piece] = []
        while size:
            doc, start, length = rest.pop()
            take = min(size, length)
            window.append((doc, start, take))
            if take < length:
                rest.append((doc, start + take, length - take))
            size -= take
        out.append(window)
    return out


class Packer:
    """Packs a stream of documents given by their lengths; yields sequences as lists of pieces."""

    def __init__(self, capacity: int, group_windows: int) -> None:
        self.capacity, self.group, self.held, self.total = capacity, group_windows, [], 0

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        whole = length - length % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(doc, start, self.capacity)]
        if length > whole:
            self.held.append((doc, whole, length - whole))
            self.total += length - whole
        if self.total >= self.group * self.capacity:
            over = self.total - self.group * self.capacity
            doc, start, length = self.held.pop()
            if length > over:
                self.held.append((doc, start, length - over))
            yield from pack_group(self.held, self.capacity)
            self.held, self.total = [(doc, start + length - over, over)] if over else [], over

    def end(self) -> Iterator[list[Piece]]:
        rest = self.total % self.capacity
        last: list[Piece] = []
        while rest:
            doc, start, length = self.held.pop()
            take = min(rest, length)
            last.append((doc, start + length - take, take))
            if take < length:
                self.held.append((doc, start, length - take))
            rest -= take
        if self.held:
            yield from pack_group(self.held, self.capacity)
        yield from powers_of_two(last)
        self.held, self.total = [], 0


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    group_windows: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, piece_ids, doc_tokens, sequence_id, offset.

    ``piece_ids`` is binary, little-endian unsigned 32-bit ids. Sequence ids are unique over the result:
    the number of the input partition in the upper bits, a count in the lower 40.
    """
    fields = [("start", T.LongType()), ("length", T.LongType()), ("piece_ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType)] + [T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = stores.shared(("packing", tokenizer_path, end_id), lambda: WordTokens(tokenizer_path, end_id))
        packer = Packer(capacity, group_windows)
        held: dict[int, tuple[object, bytes]] = {}  # documents of the open group
        made, base, serial = 0, TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        id_type = None

        def emit(sequences: Iterator[list[Piece]]) -> None:
            nonlocal made
            for sequence in sequences:
                offset = 0
                for doc, start, length in sequence:
                    name, ids = held[doc]
                    rows.append((name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + made, offset))
                    offset += length
                made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for whole in batches:
            id_type = whole.column(doc_id).type
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                for name, ids in zip(batch.column(doc_id).to_pylist(), tokens.encode(batch.column(text).to_pylist())):
                    held[serial] = (name, ids)
                    emit(packer.add(serial, len(ids) // 4))
                    serial += 1
                open_docs = {p[0] for p in packer.held}
                held = {k: v for k, v in held.items() if k in open_docs}
                if rows:
                    yield flush()
        emit(packer.end())
        if rows:
            yield flush()

    return df.select(doc_id, text).mapInArrow(run, schema)
