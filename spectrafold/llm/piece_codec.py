"""SentencePiece (merge type) encoding and decoding.

A text is encoded without running the merges over it. Every match of a vocabulary piece comes from one
Aho-Corasick pass; the search then walks from the left, taking the longest piece that is compatible
with the piece before it, and steps back to shorter pieces when it gets stuck. Two pieces are compatible
if merging their joined characters by score gives these two pieces again, which is computed once for
each pair and kept. A bit for each position tells from which positions no encoding can be completed,
so that none is tried twice. A sequence whose neighbours are all compatible is the one that merging the
whole text would give, since no merge ever crosses a boundary between compatible pieces.

Texts are split before a run of spaces and around line feeds where the vocabulary shows that no piece
crosses such a boundary; parts are kept in a bounded dictionary in each Python worker.

Null texts count as empty. An empty text has only the begin and end ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Types of pieces in the model file (fixed values of the file format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value (bytes of strings, messages and floats)."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one model file of the merge type."""

    def __init__(self, model_path: str, cache_size: int = 250_000, pair_cache_size: int = 400_000) -> None:
        with open(model_path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, kind = True, 1
        for field, value in _fields(data):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.kinds.append(entry.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models without normalisation are supported")
        if kind != 2 or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("only merge-type models without user-defined or unused pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        controls = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL}
        self.begin, self.end = controls["<s>"], controls["</s>"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_values = {i: b for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        several = [p for p in self.ids if len(p) > 1]
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in several)
        self._whole = whole
        #: Whether texts may be cut between a sign and the space or line feed after it.
        self.cuttable = not whole
        self._parts = re.compile(r"(?s).+" if whole else rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
        #: Marks that no piece joins to a letter before them: words are looked up without them.
        self.marks = "" if whole else "".join(c for c in ",.!?;:" if not any(b == c and a.isalpha() for p in several for a, b in zip(p, p[1:])))
        #: For each piece, the longest piece that is a proper prefix of it, or the character it begins with.
        self._shorter: list[tuple[int, int] | None] = [None] * len(self.pieces)
        for piece, i in self.ids.items():
            for size in range(len(piece) - 1, 0, -1):
                prefix = self.ids.get(piece[:size], -1 - ord(piece[0]) if size == 1 else None)
                if prefix is not None:
                    self._shorter[i] = (size, prefix)
                    break
        self._score = {p: self.scores[i] for p, i in self.ids.items()}
        self._pairs: dict[int | None, dict[int, bool]] = {}
        self._pair_count, self._pair_cache_size = 0, pair_cache_size
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._cache_size = cache_size
        #: What each id decodes to; a byte from 128 on is held as a lone surrogate until its run is known.
        self._shown = [p.replace(SPACE, " ") if self.kinds[i] == NORMAL else " ⁇ " if self.kinds[i] == UNKNOWN else "" for i, p in enumerate(self.pieces)]
        for i, b in self.byte_values.items():
            self._shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts, known, lowest = list(text), self._score.get, float("-inf")
        while len(parts) > 1:
            best, where = lowest, -1
            for i in range(len(parts) - 1):
                score = known(parts[i] + parts[i + 1], lowest)
                if score > best:
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _text(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else chr(-1 - piece)

    def _compatible(self, left: int | None, right: int) -> bool:
        parts = [self._text(right)] if left is None else [self._text(left), self._text(right)]
        return self.merge("".join(parts)) == parts

    def split(self, text: str) -> list[int]:
        """The pieces of a text whose spaces are already escaped, by backtracking.

        A character outside the vocabulary stands for itself, as -1 less its code point.
        """
        n = len(text)
        longest: list[tuple[int, int] | None] = [None] * (n + 1)
        for last, match in self.automaton.iter(text):  # later matches of the same start are longer
            longest[last - match[0] + 1] = match
        if None in longest[:n]:
            for i in range(n):
                longest[i] = longest[i] or (1, -1 - ord(text[i]))
        shorter, after = self._shorter, self._pairs
        closed = 0  # bits of the positions from which no encoding can be completed
        taken: list[int] = []
        steps: list[tuple[int, int]] = []
        left, at, match = None, 0, longest[0]
        while at < n:
            known = after.get(left)
            if known is None:
                known = after[left] = {}
            while match is not None:
                size, piece = match
                if not closed or not closed >> (at + size) & 1:
                    fits = known.get(piece)
                    if fits is None:
                        fits = known[piece] = self._compatible(left, piece)
                        self._pair_count += 1
                    if fits:
                        break
                match = shorter[piece] if piece >= 0 else None
            if match is not None:
                taken.append(piece)
                steps.append(match)
                at += size
                left, match = piece, longest[at]
            else:
                if not taken:
                    raise AssertionError("a text always has an encoding")
                closed |= 1 << at
                size, piece = steps.pop()
                taken.pop()
                at -= size
                left = taken[-1] if taken else None
                match = shorter[piece] if piece >= 0 else None
        if self._pair_count > self._pair_cache_size:
            after.clear()
            self._pair_count = 0
        return taken

    def _packed(self, text: str) -> bytes:
        out = self.split(text)
        if min(out) < 0:
            flat: list[int] = []
            for piece in out:
                if piece >= 0:
                    flat.append(piece)
                elif self.byte_ids:
                    flat += [self.byte_ids[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass")]
                else:
                    flat.append(self.unknown)
            out = flat
        return array("I", out).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part that isn't among the recent ones; two generations of parts are kept."""
        out = self._older.get(part)
        if out is None:
            core = part.rstrip(self.marks) if self.marks else part
            if core and core != part and core[-1].isalpha():
                out = (self._recent.get(core) or self._part(core)) + self._packed(part[len(core) :])
            else:
                out = self._packed(part)
            if len(part) > 48:
                return out
        if len(self._recent) >= self._cache_size:
            self._older, self._recent = self._recent, {}
        self._recent[part] = out
        return out

    def part_ids(self, part: str) -> bytes:
        """Ids of a part of a text, with spaces escaped, that begins at a space or line feed after another sign."""
        known = self._recent.get(part)
        return known if known is not None else b"".join([self._recent.get(p) or self._part(p) for p in self._parts(part)])

    def _line(self, line: str, first: bool) -> list[bytes]:
        """Ids of the parts of a line: a part is a word with the run of spaces before it."""
        known, part = self._recent.get, self._part
        if self._whole or SPACE in line or "  " in line or line[-1:] == " " or first and line[:1] == " ":
            text = line.replace(" ", SPACE)
            return [known(p) or part(p) for p in self._parts(SPACE + text if first else text)]
        words = line.split(" ")
        start = SPACE + words[0] if first else words[0]
        out = [known(start) or part(start)] if start else []
        del words[0]
        out += [known(p) or part(p) for p in map(SPACE.__add__, words)]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with the begin and end ids."""
        out = [struct.pack("<I", self.begin)]
        if text:
            lines = [text] if self._whole else text.split("\n")
            out += self._line(lines[0], self.dummy_prefix)
            for line in lines[1:]:
                out.append(self._recent.get("\n") or self._part("\n"))
                if line:
                    out += self._line(line, False)
        out.append(struct.pack("<I", self.end))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: bytes that form no character give U+FFFD each, one leading space goes."""
        shown = self._shown
        values = memoryview(ids).cast("I")
        out = "".join(map(shown.__getitem__, values))
        if out[:1] == " " and self.dummy_prefix:
            first = next((i for i in values if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] == NORMAL:
                out = out[1:]
        if not out.isascii() and _LONE(out):
            out = _RUNS(lambda m: "".join(_characters(bytes(ord(c) - 0xDC00 for c in m[0]))), out)
        return out


_LONE = re.compile("[\udc80-\udcff]").search
_RUNS = re.compile("[\udc80-\udcff]+").sub


def _characters(run: bytes) -> Iterator[str]:
    at = 0
    while at < len(run):
        for size in (2, 3, 4):
            try:
                yield run[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            yield "\ufffd"
            at += 1


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file, loaded once in each process."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = "decoded") -> DataFrame:
    """Add the ids of a text column and, unless ``decoded`` is None, what they decode to.

    ``ids`` is binary: little-endian unsigned 32-bit integers, as token files hold them. Columns of ``df``
    with the names of the added columns are replaced; all others, of whatever name, are kept.
    """
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    added = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):  # so that a batch of long texts isn't held several times
                batch = whole.slice(start, 512)
                packed = [c.encode(t) for t in batch.column(text).to_pylist()]
                out = [batch.column(n) for n in names] + [pa.array(packed, pa.binary())]
                if decoded:
                    out.append(pa.array([c.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*names, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, T.StructType([*kept, *added]))
