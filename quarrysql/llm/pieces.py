"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

A model file gives pieces with log scores. Text gets a marker for every space and, if the model says
so, one before the text; the best segmentation is that with the greatest sum of scores. A character
that no piece starts with costs ten less than the lowest score and is written as its bytes' pieces.
Decoding joins pieces, reads byte pieces as UTF-8 (U+FFFD for what isn't), turns markers into spaces
and takes the first one away.

Since no piece holds a marker after another character (which is checked), the best segmentation of a
text is that of its chunks, each a run of spaces and what follows up to the next, so workers keep the
ids of chunks in a bounded cache. Likewise a line break that no piece holds is a chunk of its own.
Scores are added as 64-bit numbers within a chunk.

The chunks of many texts are cut by numpy and numbered by Arrow; Python looks up each distinct one, and
those not kept are segmented together, a step of the Viterbi search for all of them at once. Long ones
go alone. Arrow puts the ids of the texts, and the bytes that they are decoded to, together.

Models without normalisation (``identity``) are supported; others are refused.

Defined cases: null text is empty; empty text has no ids; a marker character in a text reads back as
a space; lone surrogates are not text in Spark; repeated rows are encoded one by one; very long texts
are encoded whole, in time that grows with their length (a stretch without spaces needs some 20 bytes
of memory a byte); an empty table gives an empty result. ``encode()`` keeps the columns it is told to,
whatever their names; ``ids`` takes the place of a column of that name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import inside, slices, strings
from .memory import Cache, of_worker, release

MARKER = "▁"
#: Kinds of pieces in a model file, and the penalty of unknown characters.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0
LONGEST_KEPT = 48
#: Bytes of a chunk from which on its tables are packed.
LONG = 1 << 14
#: Bytes of chunks that are segmented together: each up to, and all about.
TOGETHER, STEP = 128, 1 << 19
_LOW = float("-inf")
#: Bytes that the ids of chunks may take in a worker.
KEPT = 64 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, value


@dataclass
class Model:
    """Pieces, log scores and kinds by id, and how spaces are treated."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> "Model":
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, prefix, trims, escapes, rules = [], [], [], True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                rules = own.get(2, b"")
                prefix, trims, escapes = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if rules or trims or not escapes:
            raise ValueError("only models without normalisation are supported")
        return cls(pieces, scores, kinds, prefix)


class Trie:
    """A double array: ``base[s] + byte`` is the state after a byte if ``check`` there is ``s``."""

    def __init__(self, words: dict[bytes, int]):
        # States are made level by level: each holds the sorted words below it, as a range.
        keys = sorted(words)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free, beyond, waiting = 0, 1, 1, [(0, 0, len(keys), 0)]
        for state, low, high, depth in waiting:
            children: list[tuple[int, int, int]] = []
            at = low
            if at < high and len(keys[at]) == depth:
                value[state] = words[keys[at]]
                at += 1
            while at < high:
                byte, end = keys[at][depth], at + 1
                while end < high and keys[end][depth] == byte:
                    end += 1
                children.append((byte, at, end))
                at = end
            if not children:
                continue
            # Several children go beyond all others; an only child fills the first hole they left.
            if len(children) == 1:
                free = max(free, 1 + children[0][0])
                while check[free] >= 0:
                    free += 1
                place = free - children[0][0]
            else:
                place = max(1, beyond - children[0][0])
            beyond = max(beyond, place + children[-1][0] + 1)
            if beyond + 512 >= len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            base[state] = place
            for byte, a, b in children:
                check[place + byte] = state
                waiting.append((place + byte, a, b, depth + 1))
        last = max(i for i, c in enumerate(check) if c >= 0) + 257
        self.base, self.check, self.value = (np.array((x + [f] * 257)[:last], np.int32) for x, f in ((base, 0), (check, -1), (value, -1)))


class Processor:
    """Encodes and decodes with a model. Only arrays and lists: it can be sent to workers."""

    def __init__(self, model: Model):
        self.prefix, self.pieces, self.kinds = model.prefix, model.pieces, model.kinds
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER) and model.pieces[i]]
        normal = [model.scores[i] for i in usable if model.kinds[i] == NORMAL] or [0.0]
        self.unknown_score = min(normal) - PENALTY
        top = max(normal)
        # A user's own piece always wins over what it is made of.
        self.scores = [len(p) * top - 0.1 if k == USER else s for p, s, k in zip(model.pieces, model.scores, model.kinds)]
        self.parts = not any(MARKER in model.pieces[i].lstrip(MARKER) for i in usable)
        self.lines = not any("\n" in model.pieces[i] for i in usable)
        self.trie = trie = Trie({model.pieces[i].encode(): i for i in usable})
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k in (NORMAL, USER) else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]
        self.raw = pa.array(raw, pa.large_binary())
        # What an edge costs by its piece, -1 (the last) for an unknown character.
        self.costs = np.array([*self.scores, self.unknown_score])
        self.of_byte = np.array([self.bytes.get(b, self.unknown) for b in range(256)], np.int32)
        self.kept = Cache(KEPT)

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation; of equal ones, that whose last piece starts first."""
        data = text.encode()
        n = len(data)
        # Lists are faster, arrays take a sixth of their memory.
        best, start, last = ([_LOW] * (n + 1), [0] * (n + 1), [0] * (n + 1)) if n <= LONG else (array("d", [_LOW]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1))
        best[0] = 0.0
        base, check, value, scores, unknown = self.base, self.check, self.value, self.scores, self.unknown_score
        at = 0
        while at < n:
            lead = data[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            so_far, state, end, single = best[at], 0, at, False
            while end < n:
                to = base[state] + data[end]
                if check[to] != state:
                    break
                state = to
                end += 1
                piece = value[state]
                if piece >= 0:
                    total = so_far + scores[piece]
                    if total > best[end]:
                        best[end], start[end], last[end] = total, at, piece
                    single = single or end - at == step
            if not single:
                end = at + step
                total = so_far + unknown
                if total > best[end]:
                    best[end], start[end], last[end] = total, at, -1
            at += step
        out: list[int] = []
        end = n
        while end:
            begin, piece = start[end], last[end]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(data[begin:end])]
            else:
                out.append(self.unknown)
            end = begin
        return out[::-1]

    def viterbi_together(self, chunks: pa.Array) -> list[bytes]:
        """What ``viterbi`` gives for each of many short strings, as 32-bit integers."""
        data, offsets = inside(chunks)
        n, many = len(data), len(chunks)
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(many, dtype=np.int32), sizes)
        depth = np.arange(n, dtype=np.int32) - offsets[:-1][owner]
        # A string of k bytes has k + 1 nodes: one before each byte, and its end.
        node = np.arange(n, dtype=np.int32) + owner
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        # All edges, by number of bytes.
        first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        lead = data[first]
        step = np.ones(len(first), np.int32) + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        width = np.zeros(n, np.int32)
        width[first] = step
        single = np.zeros(n, bool)
        begin, left, state, taken = first, offsets[1:][owner[first]] - first, np.zeros(len(first), np.int32), 0
        begins, ends, pieces = [], [], []
        while len(begin):
            to = base[state] + data[begin + taken]
            on = np.flatnonzero(check[to] == state)
            begin, left, state = begin[on], left[on], to[on]
            taken += 1
            piece = value[state]
            hit = np.flatnonzero(piece >= 0)
            at = begin[hit]
            begins.append(at)
            ends.append(node[at] + taken)
            pieces.append(piece[hit])
            single[at[width[at] == taken]] = True
            on = np.flatnonzero(left > taken)
            if len(on) < len(begin):
                begin, left, state = begin[on], left[on], state[on]
        alone = ~single[first]
        at = first[alone]
        begin = np.concatenate([*begins, at])
        end = np.concatenate([*ends, node[at] + step[alone]])
        piece = np.concatenate([*pieces, np.full(len(at), -1, np.int32)])
        # In the order of their beginnings. Those of one beginning have different ends.
        where = depth[begin].astype(np.uint8)
        order = np.argsort(where, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        before, cost = node[begin], self.costs[piece]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=1))]).tolist()
        best, via = np.full(n + many, _LOW), np.zeros(n + many, np.int32)
        best[offsets[:-1] + np.arange(many)] = 0.0
        for a, b in zip(bounds, bounds[1:]):
            to = end[a:b]
            total = best[before[a:b]] + cost[a:b]
            better = np.flatnonzero(total > best[to])
            to = to[better]
            best[to] = total[better]
            via[to] = better + a
        # Back from all ends; an id stands at the first byte of its piece.
        ids = np.full(n, -1, np.int32)
        at = (offsets[1:] + np.arange(many))[sizes > 0]
        while len(at):
            edge = via[at]
            start, piece_there = begin[edge], piece[edge]
            ids[start] = piece_there
            odd = start[piece_there < 0]
            if len(odd) and not self.bytes:
                ids[odd] = self.unknown
            elif len(odd):
                for k in range(4):
                    more = odd[width[odd] > k] + k
                    ids[more] = self.of_byte[data[more]]
            at = before[edge][depth[start] > 0]
        real = ids >= 0
        raw = ids[real].tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(real)])[offsets]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, chunks: pa.Array) -> list[bytes]:
        """The ids of distinct chunks with their spaces, as 32-bit integers."""
        chunks = pc.replace_substring(chunks, " ", MARKER)
        sizes = pc.binary_length(chunks).to_numpy()
        found: list = [None] * len(chunks)
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            found[i] = np.array(self.viterbi(chunks[i].as_py()), np.int32).tobytes()
        # By size, so that those of one step take about as many turns.
        short = np.argsort(sizes, kind="stable")[: int((sizes <= TOGETHER).sum())]
        upto = np.cumsum(sizes[short], dtype=np.int64)
        at = 0
        while at < len(short):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
            for i, ids in zip(short[at:to].tolist(), self.viterbi_together(chunks.take(pa.array(short[at:to])))):
                found[i] = ids
            at = to
        return found

    def _lookup(self, chunks: pa.Array) -> list[bytes]:
        """The ids of distinct chunks, kept ones or new."""
        kept, keys = self.kept, chunks.to_pylist()
        found = list(map(kept.get, keys))
        lacking = [i for i, x in enumerate(found) if x is None]
        for i in lacking:
            found[i] = kept.old.get(keys[i])
        new = [i for i in lacking if found[i] is None]
        if new:
            for i, x in zip(new, self._learn(chunks.take(pa.array(new, pa.int64())))):
                found[i] = x
        own = {keys[i]: found[i] for i in lacking if len(keys[i]) <= LONGEST_KEPT}
        kept.put_all(own, sum(map(len, own)) + sum(map(len, own.values())))
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end among them."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.string()), MARKER, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        if not self.parts:
            found = [np.array(self.viterbi(t.replace(" ", MARKER)), np.int32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.cumsum([0, *map(len, found)])
        data, offsets = inside(texts)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.lines:
            line = data == 10
            begins |= line
            begins[1:] |= line[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        chunks, cuts = strings(data, begins)
        chunks = chunks.dictionary_encode()
        ids = pa.array(self._lookup(chunks.dictionary), pa.large_binary()).take(chunks.indices)
        self.kept.age()
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(cuts) + 1] if len(cuts) else np.zeros(1, np.int64)
        return np.frombuffer(ids.buffers()[2] or b"", np.int32)[: ends[-1] // 4], ends[np.searchsorted(cuts, offsets)] // 4

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids in a row."""
        found = self.raw.take(pa.array(ids, pa.int32()))
        data = memoryview(found.buffers()[2] or b"")
        cuts = np.frombuffer(found.buffers()[1], np.int64)[offsets].tolist() if len(ids) else [0] * len(offsets)
        mark, out = MARKER.encode(), []
        for a, b in zip(cuts, cuts[1:]):
            own = bytes(data[a:b])
            # A marker's first byte begins a character wherever it stands.
            own = (own[len(mark) :] if self.prefix and own.startswith(mark) else own).replace(mark, b" ")
            out.append(own.decode("utf-8", "replace"))
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int32)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


def processor(path: str) -> Processor:
    """One a worker and file."""
    return of_worker("pieces", path, lambda: Processor(Model.load(path)))


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, an array of integers, which takes the place of a kept column
    of that name."""
    keep = tuple(c for c in keep if c.lower() != "ids")
    docs = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        for batch in batches:
            for some in slices(batch, "_text", 4 << 20):
                found, offsets = own.encode_all(some.column("_text"))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], ids], [*some.schema.names[:-1], "ids"])
        release()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds + ', ' if kinds else ''}ids array<int>").toDF(*keep, "ids")


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids."""

    @F.pandas_udf("string")
    def read(values):
        own = processor(model)
        return values.map(lambda x: None if x is None else own.decode(x))

    return encoded.withColumn("decoded", read(F.col(ids)))


def query(docs: DataFrame, model: str) -> DataFrame:
    """Of every document: how many pieces, how many of them bytes, CRC-32 of the ids as little-endian
    unsigned 32-bit integers, SHA-256 of the text decoded from them, and whether that is the text."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        is_byte = np.array([k == BYTE for k in own.kinds])
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                ids, offsets = own.encode_all(some.column("text"))
                decoded = own.decode_all(ids, offsets)
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids], dtype=np.int64)])[offsets]
                crc = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                sha = [hashlib.sha256(back.encode()).hexdigest() for back in decoded]
                same = [back == (t or "") for back, t in zip(decoded, some.column("text").to_pylist())]
                columns = (np.diff(offsets), np.diff(bytes_before), crc, sha, same)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["doc_id", "n_pieces", "n_bytes_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_pieces long, n_bytes_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def stage(docs: DataFrame, model: str) -> DataFrame:
    """The documents' columns without the text, and the ids."""
    return encode(docs, model, keep=tuple(c for c in docs.columns if c != "text"))
