"""Byte-level BPE through the tokenizers library, with per-worker caches of pieces.

A text is cut into pieces at places where the splitting pattern of byte-level BPE parts it whatever
stands around them (see ``cut``), so a piece has the same ids alone as in its text and is encoded once a
worker. Texts with special strings go through the library whole.

The pieces of a batch are cut by numpy and numbered by Arrow; Python looks up each distinct one, and
Arrow puts the ids of the texts together.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import Cache, of_worker

#: Longer pieces are encoded each time; so many bytes of text are given to the library at once.
LONGEST_KEPT, ASKED = 64, 1 << 20
#: The letters by which byte-level BPE writes bytes: printable ones stand for themselves, the others,
#: in order, for the letters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
#: Bytes that the pieces may take in a worker.
KEPT = 224 << 20


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges, both ends included."""
    return np.array([any(a <= b <= z for a, z in ranges) for b in range(256)])


#: Of bytes: ASCII white space, those of characters that aren't (but for ``_DOUBTFUL``), ASCII letters and
#: punctuation; bytes that lead two-byte letters, or characters that may be white space.
_WHITE, _SOLID = _bytes((9, 13), (32, 32)), _bytes((33, 126), (128, 255))
_LETTER, _PUNCTUATION = _bytes((65, 90), (97, 122)), _bytes((33, 47), (58, 64), (91, 96), (123, 126))
_LETTER_LEAD, _DOUBT_LEAD = _bytes((0xC3, 0xC5), (0xD0, 0xD1)), _bytes((0xC2, 0xC2), (0xE1, 0xE3))
#: First bytes, to the last that tells, of characters that are or may count as white space.
_DOUBTFUL = [*(bytes([0xC2, b]) for b in range(0x80, 0xA1)), b"\xe1\x9a\x80", b"\xe1\xa0\x8e", *(bytes([0xE2, 0x80, b]) for b in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe2\x81\xa0", b"\xe3\x80\x80"]
_DOUBT = {int.from_bytes(x.ljust(3, b"\0"), "big") for x in _DOUBTFUL}


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``most`` bytes of a text column each, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def inside(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings in a row, and where each begins and ends among them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The strings that begin at the marked bytes, and where in ``data``."""
    cuts = np.flatnonzero(begins).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, np.int32(len(data)))), pa.py_buffer(data)), cuts


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and where each text's begin and end among them.

    The splitting pattern takes one space with what follows it, and of more white space all but the last;
    it never joins a letter with a later character that is none. So it parts, whatever else is there,

    * before white space after another character, and before the last of white space before another;
    * after the last of white space that isn't a space;
    * between a letter and punctuation.

    Cuts are made only where bytes show one of these without doubt.
    """
    data, offsets = inside(texts)
    n = len(data)
    white, solid = _WHITE[data], _SOLID[data]
    leads = np.flatnonzero(_DOUBT_LEAD[data])
    if len(leads):
        second, third = data[np.minimum(leads + 1, n - 1)], data[np.minimum(leads + 2, n - 1)]
        wide = data[leads] >= 0xE0
        code = (data[leads].astype(np.int32) << 16) | (second.astype(np.int32) << 8) | np.where(wide, third, 0)
        doubtful = np.isin(code, list(_DOUBT))
        for k in range(3):
            solid[(leads + k)[doubtful & (wide | (k < 2))]] = False
    first = offsets[:-1][np.diff(offsets) > 0]
    begins = np.zeros(n, bool)
    if n > 1:
        begins[:-1] = white[:-1] & solid[1:]
        begins[first[1:] - 1] = False  # what follows is another text
        begins[1:] |= white[1:] & solid[:-1]
        begins[1:] |= solid[1:] & white[:-1] & (data[:-1] != 32)
        letter = _LETTER[data]
        letter[1:] |= _LETTER_LEAD[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        begins[1:] |= _PUNCTUATION[data[1:]] & letter[:-1]
    begins[first] = True
    pieces, cuts = strings(data, begins)
    return pieces, np.searchsorted(cuts, offsets)


class Encoder:
    """The ids of texts, or with ``count`` their number."""

    def __init__(self, path: str, count: bool = False, dtype: str = "<u4", most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        form = json.loads(self.lib.to_str())
        before = form["pre_tokenizer"] or {}
        # Only of this form is it known what parts pieces.
        self.parts = not form["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not form["truncation"] and not form["padding"]
        self.count, self.dtype = count, np.dtype(dtype)
        self.kept = Cache(most)

    def ask(self, texts: list[str]) -> list:
        """The library's answers: numbers of ids, or ids as bytes."""
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < ASKED:
                size += len(texts[to])
                to += 1
            out += self._values([e.ids for e in self.lib.encode_batch_fast(texts[at:to], add_special_tokens=False)])
            at = to
        return out

    def _values(self, found: list[list[int]]) -> list:
        sizes = list(map(len, found))
        if self.count:
            return sizes
        raw = np.fromiter(chain.from_iterable(found), self.dtype, sum(sizes)).tobytes()
        ends = [self.dtype.itemsize * n for n in accumulate(sizes, initial=0)]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _ask_words(self, words: list[str]) -> list:
        """The library's model about pieces of letters only, or a space and letters: each is one pre-token,
        so the model can be asked without the steps before it."""
        tokens, space = self.lib.model.tokenize, _BYTE_LETTERS[32]
        found = [tokens(w.replace(" ", space) if w.isascii() else w.encode().decode("latin1").translate(_BYTE_LETTERS)) for w in words]
        return list(map(len, found)) if self.count else self._values([[t.id for t in x] for x in found])

    def lookup(self, pieces: list[str], table: dict | None = None) -> list:
        """The value of each of distinct pieces."""
        kept = self.kept
        values = list(map(kept.get, pieces))
        lacking = [i for i, v in enumerate(values) if v is None]
        for known in (kept.old, table or {}):
            for i in lacking if known else ():
                if values[i] is None:
                    values[i] = known.get(pieces[i])
        words, plain = [], []
        for i in lacking:
            if values[i] is None:
                p = pieces[i]
                (words if (p[1:] if p[0] == " " else p).isalpha() else plain).append(i)
        for some, ask in ((words, self._ask_words), (plain, self.ask)):
            for i, v in zip(some, ask([pieces[i] for i in some])):
                values[i] = v
        new = {pieces[i]: values[i] for i in lacking if len(pieces[i]) <= LONGEST_KEPT}
        kept.put_all(new, sum(map(len, new)) + (0 if self.count else sum(map(len, new.values()))))
        return values

    def _numbered(self, texts: pa.Array, table: dict | None) -> tuple[np.ndarray, np.ndarray, list]:
        """Of each piece its place in the list of values; where each text's begin and end; the values."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        whole = np.full(len(texts), not self.parts)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        alone = texts.filter(pa.array(whole)).to_pylist()
        pieces, bounds = cut(pc.if_else(pa.array(whole), "", texts) if alone else texts)
        coded = pieces.dictionary_encode()
        number, values = coded.indices.to_numpy(), self.lookup(coded.dictionary.to_pylist(), table)
        self.kept.age()
        if alone:
            number = np.insert(number, bounds[:-1][whole], np.arange(len(values), len(values) + len(alone)))
            bounds = bounds + np.concatenate([[0], np.cumsum(whole)])
            values += self.ask(alone)
        return number, bounds, values

    def counts(self, texts: pa.Array, table: dict | None = None) -> np.ndarray:
        """The number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        number, bounds, values = self._numbered(texts, table)
        return np.diff(np.concatenate([[0], np.cumsum(np.array(values, np.int64)[number])])[bounds])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end``, and how many each has."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        number, bounds, values = self._numbered(texts, None)
        if end is not None:
            number = np.insert(number, bounds[1:], len(values))
            bounds = bounds + np.arange(len(bounds))
            values.append(np.array([end], self.dtype).tobytes())
        if not len(number):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        found = pa.array(values, pa.large_binary()).take(pa.array(number))
        ends = np.frombuffer(found.buffers()[1], np.int64)[bounds] // self.dtype.itemsize
        return np.frombuffer(found.buffers()[2] or b"", self.dtype)[: ends[-1]], np.diff(ends)


def encoder(path: str, count: bool = False, dtype: str = "<u4") -> Encoder:
    """One encoder a worker, file and use (caches of different values stay apart)."""
    return of_worker("token counts" if count else "token files", f"{dtype} {path}", lambda: Encoder(path, count, dtype))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
