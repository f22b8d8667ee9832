"""Byte-level BPE ids of texts by a ``tokenizers`` file, with a bounded store of the words met before.

The tokenizer's pattern never lets a token run from a sign into the blank or the line feed after it. Texts are
therefore cut there, each part with the blank or line feed that it begins with, and every part is encoded once.
Parts of one blank and letters are encoded many at once and told apart by the blank that begins each of them.
A part without such places is encoded whole, whatever its length; so are texts with a special token in them,
if the tokenizer looks for these.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokenizers whose texts may be cut (fixed values of the file format).
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Places between a sign and the blank or line feed that follows it.
_PLACES = re.compile(r"(?<=\S)(?=[ \n])")
_MARKS = ",.!?;:"
_IN_A_ROW = re.compile(r"\s\s").search
#: Begins the key of a part that doesn't begin with a blank; the key of a part that does is what follows the blank.
_JOINED = "\0"


#: Two signs of white space in a row, and the sign that marks parts, in the syntax of Arrow's patterns.
_ODD = "[\\t-\\r\\x1c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}|\\x00"
#: Words of letters that all versions of Unicode know.
_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+$"


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray | None = None, together: int = 1 << 16) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``starts`` and have ``sizes``, one after another; or ``which`` of them.

    So many pieces at once, since the places to take are as many as what is taken, and larger.
    """
    count = len(starts if which is None else which)
    parts = [slice(a, a + together) if which is None else which[a : a + together] for a in range(0, count, together)]
    out = np.empty(sum(int(sizes[p].sum()) for p in parts), flat.dtype)
    at = 0
    for part in parts:
        n = sizes[part]
        ends = np.cumsum(n)
        total = int(ends[-1])
        np.take(flat, np.repeat(starts[part] - (ends - n), n) + np.arange(total), out=out[at : at + total], mode="clip")
        at += total
    return out


def slices(texts: pa.StringArray, together: int = 16 << 20) -> list[tuple[int, int]]:
    """The ranges of an array whose texts have about so many bytes together (one text, if it has more)."""
    groups = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // together
    bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def byte_values() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written: printable bytes stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids of parts and texts. ``plain`` takes special tokens inside texts as text."""

    def __init__(self, path: str, plain: bool = False, cache_size: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.cuttable = not spec.get("normalizer") and not spec["model"].get("dropout") and all(split.get(k) == v for k, v in _PLAIN.items())
        added = spec.get("added_tokens") or []
        self.special = [] if plain else [t["content"] for t in added]
        values = byte_values()
        #: The bytes of each id; added tokens stand for their own text.
        self.token_bytes: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in added)]))
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        for t in added:
            self.token_bytes[t["id"]] = t["content"].encode()
        self._blank = np.array([b[:1] == b" " for b in self.token_bytes])
        #: The same model for words that are already apart, in the characters of the vocabulary.
        self._words = Tokenizer(self.tokenizer.model)
        self._words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._shown = {b: ord(c) for c, b in values.items()}
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._size = cache_size

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunk(self, words: list[str]) -> np.ndarray:
        """Ids of words, each with a blank before it, in one call."""
        shown = f" {' '.join(words)}".encode().decode("latin-1").translate(self._shown)
        shown = shown.replace(chr(self._shown[32]), " " + chr(self._shown[32]))
        return np.array(self._words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[str]) -> None:
        """Add words of letters, each with a blank before it: many at once, told apart by their blanks."""
        for start in range(0, len(words), 2000):
            chunk = words[start : start + 2000]
            ids = self._encode_chunk(chunk)
            starts = (4 * np.flatnonzero(self._blank[ids])).tolist()
            if len(starts) == len(chunk):
                packed = ids.tobytes()
                self._recent.update(zip(chunk, [packed[a:b] for a, b in zip(starts, [*starts[1:], len(packed)])]))
            else:
                self._recent.update(zip(chunk, self.encode_whole([" " + w for w in chunk])))

    def learn(self, keys: set[str]) -> None:
        """Add parts to the recent ones, from the older ones or by the tokenizer."""
        recent, older = self._recent, self._older
        if older:
            known = keys & older.keys()
            recent.update((k, older[k]) for k in known)
            keys = keys - known
        words = [k for k in keys if k.isalpha()]
        split, rest = [], []
        for key in keys.difference(words):
            core = key.rstrip(_MARKS)
            if core != key and core.isalpha() and core[-1] < "\u0530":  # a letter in all versions of Unicode
                split.append((key, core, _JOINED + key[len(core) :]))
            else:
                rest.append(key)
        self._encode_words(words)
        self._encode_words(list({core for _, core, _ in split} - recent.keys()))
        rest += {marks for _, _, marks in split} - recent.keys()
        recent.update(zip(rest, self.encode_whole([self.part_text(k) for k in rest])))
        recent.update((key, recent[core] + recent[marks]) for key, core, marks in split)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self._recent) > self._size:
            self._older, self._recent = self._recent, {}
        split = [self.parts(t) for t in texts]
        found = [list(map(self._recent.get, keys)) for keys in split]
        holes = [[i for i, ids in enumerate(got) if ids is None] if None in got else [] for got in found]
        missing = {keys[i] for keys, at in zip(split, holes) for i in at}
        if missing:
            self.learn(missing)
        for keys, got, at in zip(split, found, holes):
            for i in at:
                got[i] = self._recent[keys[i]]
        out = [b"".join(got) for got in found]
        whole = [i for i, keys in enumerate(split) if not keys]
        for i, ids in zip(whole, self.encode_whole([texts[i] for i in whole])):
            out[i] = ids
        return out

    def encode_array(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an array without nulls, each with the end id, and where each text ends.

        Texts are cut into parts, and each distinct part is encoded once, by array operations: words apart from the
        marks after them, many at once; other parts one by one. Texts that can't be cut are encoded whole.
        """
        flat, n = self._encode_together(texts)
        last = np.cumsum(n)
        return np.insert(flat, last, np.uint32(end_id)), last + np.arange(1, len(n) + 1)

    def _encode_together(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(len(texts), bool)
        for special in self.special:
            odd = odd | pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if odd.any():  # both kinds apart, then in order
            whole = [np.frombuffer(x, "<u4") for x in self.encode_whole(texts.filter(pa.array(odd)).to_pylist())]
            flat, n = self._encode_parts(texts.filter(pa.array(~odd)))
            starts, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            sizes[~odd], sizes[odd] = n, [len(x) for x in whole]
            starts[~odd], starts[odd] = np.cumsum(n) - n, len(flat) + np.cumsum(sizes[odd]) - sizes[odd]
            return gather(np.concatenate([flat, *whole]), starts, sizes), sizes
        return self._encode_parts(texts)

    def _encode_parts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that can be cut."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, occurs, offsets = self._split(texts)
        cores = pc.utf8_rtrim(keys, characters=_MARKS)
        word = pc.match_substring_regex(cores, _WORD).to_numpy(zero_copy_only=False)
        words = cores.filter(pa.array(word)).dictionary_encode()
        cut_off = (pc.binary_length(keys).to_numpy() - pc.binary_length(cores).to_numpy()) * word
        # pieces: the distinct words, the other keys, the distinct marks after words
        others = keys.filter(pa.array(~word)).to_pylist()
        marks = {""}
        for size in np.unique(cut_off[cut_off > 0]).tolist():
            marks |= set(pc.utf8_slice_codeunits(keys.filter(pa.array(cut_off == size)), -size).unique().to_pylist())
        marks = sorted(marks)
        flat, sizes = self._words_array(words.dictionary.to_pylist())
        rest = [np.frombuffer(x, "<u4") for x in self.encode_whole([self.part_text(k) for k in others] + marks)]
        flat = np.concatenate([flat, *rest])
        sizes = np.concatenate([sizes, [len(x) for x in rest]]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        n_words = len(words.dictionary)
        first = np.empty(len(keys), np.int64)
        first[word], first[~word] = words.indices.to_numpy(), n_words + np.arange(len(others))
        second = np.full(len(keys), n_words + len(others) + marks.index(""))
        for size in np.unique(cut_off[cut_off > 0]).tolist():
            at = np.flatnonzero(cut_off == size)
            found = pc.index_in(pc.utf8_slice_codeunits(keys.take(pa.array(at)), -size), pa.array(marks)).to_numpy()
            second[at] = n_words + len(others) + found
        pieces = np.stack([first, second], 1).ravel()
        flat = gather(flat, starts[pieces], sizes[pieces])  # now by keys
        sizes = sizes[first] + sizes[second]
        starts = np.cumsum(sizes) - sizes
        ends = np.zeros(len(occurs) + 1, np.int64)
        np.cumsum(sizes[occurs], out=ends[1:])
        n = np.diff(ends[offsets])
        del ends  # as long as the parts are many
        return gather(flat, starts, sizes, occurs), n

    @staticmethod
    def _split(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct keys of parts, the key of each part, and where each text's parts begin and the last one's end."""
        marked = pc.binary_join_element_wise(pa.scalar(_JOINED), texts, "")
        marked = pc.replace_substring(marked, "\n", f" {_JOINED}\n {_JOINED}")
        lists = pc.split_pattern(marked, " ")
        del marked
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]

    def _words_array(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a blank before it, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(words), 2000):
            chunk = words[start : start + 2000]
            found = self._encode_chunk(chunk)
            starts = np.flatnonzero(self._blank[found])
            if len(starts) == len(chunk):
                ids.append(found)
                sizes.append(np.diff(starts, append=len(found)))
            else:
                alone = [np.frombuffer(x, "<u4") for x in self.encode_whole([" " + w for w in chunk])]
                ids += alone
                sizes.append(np.array([len(x) for x in alone]))
        return np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def part_text(key: str) -> str:
        """The text of a part."""
        return key[1:] if key[:1] == _JOINED else " " + key

    def of_parts(self, keys: list[str]) -> list[bytes]:
        """Ids of parts."""
        if len(self._recent) > self._size:
            self._older, self._recent = self._recent, {}
        missing = {k for k in keys if k not in self._recent}
        if missing:
            self.learn(missing)
        return [self._recent[k] for k in keys]

    def parts(self, text: str) -> list[str]:
        """Keys of the parts of a text, in order; none if the text can't be cut."""
        if not self.cuttable or _JOINED in text or any(s in text for s in self.special):
            return []
        if _IN_A_ROW(text):
            return [p[1:] if p[0] == " " else _JOINED + p for p in _PLACES.split(text) if p]
        text = text[1:] if text[:1] == " " else _JOINED + text
        return text.replace("\n", f" {_JOINED}\n {_JOINED}").split(" ")
