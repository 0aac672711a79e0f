"""N-gram Jaccard join: documents whose sets of word shingles overlap by three quarters or more.

The search is T-occurrence with DivideSkip: of a query's inverted lists the longest are set aside,
the short ones are merged by a heap, and what occurs often enough there is looked for in the long
ones by binary search; documents that reach the required overlap T are kept. Around it, exactly:

1. A shingle that no other document has can't be part of an overlap. Map tasks send the distinct
   hashes of a chunk of documents, packed by hash bucket; reducers answer which of them other chunks
   have too, a bucket at a time. Documents with less than three quarters of their shingles shared are done.
2. The others are grouped by equal sets; one node a set goes on. Step 1 is repeated among nodes,
   now with the number of nodes that have a shingle.
3. Two linked nodes share one of the rarest quarter of their shingles. Nodes that do are tied
   together (a row a node and shingle, to the least node that has it), and the components of these
   ties are groups that no link leaves.
4. Each group is searched in blocks of about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles, which are
   numbered over all groups and dealt to tasks in turn. A group of one block is searched at once. In a
   larger one every node is first compared with a few pivots; the nodes outside the largest component
   that gives are then queries against all blocks of their own and the neighbouring partitions of
   lengths, so a dense group costs a pass and not the square of its size. (Where a large group stays in
   many components, its queries do meet all of those blocks; nothing is dropped to avoid that.)
5. The links' components, by alternating stars, give each document's component.

Within a block, lists hold clusters of linked nodes rather than nodes: a cluster whose shingles
together don't reach T holds no partner; otherwise its members are compared until one links.

Hashes of shingles have 64 bits; in step 1, 48 beside the bucket's (a clash there makes step 1 keep
more, never less).

Defined cases: null or empty text, or text without words, has an empty set and is linked with
nothing; of fewer words than ``N`` the whole sequence is the one shingle; repeated texts are one
node; a row with a null id gets the component of a document with the same set, else null, and can't
name a component; rows that share an id but no text are judged each by its text, and what one of
them links may count for the other; an empty table gives an empty result; other columns are ignored.
Very long texts are taken whole: a text's own shingles must fit in a task's memory, some 30 bytes each.
Tables are read more than once, so ``docs`` should be a stored table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import groupby
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import slices
from .coded import coded_words, distinct
from .common import cut, fitted, shuffle_partitions, stored, stored_bytes
from .graph import components
from .memory import release

SetsOf = Callable[[pa.Array], list[np.ndarray]]
N = 5
THRESHOLD = Fraction(3, 4)
#: About the most nodes and shingles of a block and queries that it gets at once, shingles and
#: documents of a chunk, and pivots of a large group. They bound what a task holds, nothing else.
BLOCK, BLOCK_SHINGLES, ASKING = 256, 500_000, 1024
CHUNK_SHINGLES, CHUNK_DOCS, PIVOTS = 600_000, 60_000, 16
#: Fixed value: the factor of DivideSkip's rule for the number of long lists.
MU = 0.0085
_SEVERAL = 0xFFFF
#: Bytes of stored text that a partition and a bucket of hashes stand for, and of text read at once.
PART_BYTES, BUCKET_BYTES, SLICE = 4 << 20, 1 << 20, 2 << 20


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles of ``n`` words. Lowering and
    cutting know ASCII only, as wanted."""
    codes, offsets = coded_words(pc.ascii_lower(texts))
    step = lambda out, k, of: (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + of[k : k + len(out)]
    last = lambda out: out ^ (out >> np.uint64(29))
    every = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        every = step(every, k, codes)
    every = last(every)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            sets.append(distinct(every[a : b - n + 1]))
        else:
            few = np.full(min(1, b - a), b - a, np.uint64)
            for k in range(b - a):
                few = step(few, k, codes[a:b])
            sets.append(last(few))
    return sets


def least_overlap(n: int, threshold: Fraction) -> int:
    """The least overlap of a set of ``n`` with any set it links with."""
    return ceil(threshold * n)


def links(both: int, a: int, b: int, threshold: Fraction) -> bool:
    return threshold.denominator * both >= threshold.numerator * (a + b - both)


# Step 1 and 2: which shingles are shared


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(chunk: int, sets: list[np.ndarray], n_buckets: int, meta: bytes, by_owner: bool) -> Iterator[pa.RecordBatch]:
    """A row a bucket, and one with what the chunk needs again. about: of each hash the one document
    that has it or ``_SEVERAL``, or in how many it is."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    unique, start, count = np.unique(every[order], return_index=True, return_counts=True)
    about = np.where(count == 1, owner[order][start], _SEVERAL).astype(np.uint16) if by_owner else np.minimum(count, 65535).astype(np.uint16)
    low, middle = unique.astype(np.uint32), (unique >> np.uint64(32)).astype(np.uint16)
    at = np.searchsorted(_buckets(unique, n_buckets), np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(at))
    yield pa.RecordBatch.from_arrays([pa.array([chunk % n_buckets], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([b""], pa.binary())] * 3, pa.array([meta], pa.binary())], _PACKED_NAMES)
    for i in range(0, len(full), 256):
        some = full[i : i + 256].tolist()
        cells = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()) for x in (low, middle, about)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), *cells, pa.array([b""] * len(some), pa.binary())], _PACKED_NAMES)


_PACKED = "bucket int, chunk long, low binary, middle binary, about binary, meta binary"
_PACKED_NAMES = ["bucket", "chunk", "low", "middle", "about", "meta"]
_ANSWER = "chunk long, bucket int, answer binary, meta binary"


def _answer_rows(chunks: list[int], bucket: int, answers: list[bytes], meta: bytes = b"") -> pa.RecordBatch:
    n = len(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array(answers, pa.binary()), pa.array([meta] * n, pa.binary())], ["chunk", "bucket", "answer", "meta"])


def _deal(docs: DataFrame) -> tuple[int, int]:
    """How many partitions hashes are dealt to, ``spark.sql.shuffle.partitions`` at most and fewer for
    little text, and how many buckets each has."""
    size = stored_bytes(docs)
    parts = max(1, min(shuffle_partitions(docs.sparkSession), size // PART_BYTES))
    return parts, max(4, min(256, size // parts // BUCKET_BYTES))


def _answers(exchanged: DataFrame, parts: int, splits: int, by_owner: bool) -> DataFrame:
    """chunk, bucket, answer, meta. by_owner: how many shared shingles each document has; else the
    class of each shingle's frequency, in the order sent. A task sees its buckets one by one, so it
    holds one at a time."""

    def answer(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([r[1] for r in rows])
        about = np.concatenate([r[2] for r in rows])
        _, which = np.unique(every, return_inverse=True)
        weight = np.where(about == _SEVERAL, 2, 1) if by_owner else about
        total = np.bincount(which, weight).astype(np.int64)[which]
        at = 0
        out = []
        for _, low, _ in rows:
            own, owner = total[at : at + len(low)], about[at : at + len(low)]
            at += len(low)
            if by_owner:
                ids, n = np.unique(owner[(own > 1) & (owner != _SEVERAL)], return_counts=True)
                out.append(np.stack([ids, n]).astype(np.uint32).tobytes())
            else:
                out.append(_frequency_class(own).tobytes())
        for i in range(0, len(rows), 500):
            yield _answer_rows([r[0] for r in rows[i : i + 500]], bucket, out[i : i + 500])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if not r["low"]:
                        yield _answer_rows([r["chunk"]], -1, [b""], r["meta"])
                        continue
                    if r["bucket"] != bucket and held:
                        yield from answer(bucket, held)
                        held = []
                    bucket = r["bucket"]
                    hashes = np.frombuffer(r["low"], np.uint32) | np.frombuffer(r["middle"], np.uint16).astype(np.uint64) << np.uint64(32)
                    held.append((r["chunk"], hashes, np.frombuffer(r["about"], np.uint16)))
        if held:
            yield from answer(bucket, held)
        release()

    return exchanged.repartitionById(parts, F.floor(F.col("bucket") / splits).cast("int")).sortWithinPartitions("bucket", "chunk").mapInArrow(reduce, _ANSWER)


def _frequency_class(n: np.ndarray) -> np.ndarray:
    """1 for what occurs once; exact to 64, then by logarithm: the order is all that counts."""
    return np.where(n <= 64, n, np.minimum(255, 16 + 8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def _gathered(answers: DataFrame, parts: int, of_chunk, schema: str) -> DataFrame:
    """``of_chunk(meta, {bucket: answer})`` of every chunk, one at a time."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, meta, held = None, b"", {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if r["bucket"] >= 0:
                        held[r["bucket"]] = r["answer"]
                        continue
                    # A chunk's first row is the one with what it sent along.
                    if chunk is not None:
                        yield from of_chunk(meta, held)
                    chunk, meta, held = r["chunk"], r["meta"], {}
        if chunk is not None:
            yield from of_chunk(meta, held)
        release()

    return answers.repartitionById(parts, F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")).sortWithinPartitions("chunk", "bucket").mapInArrow(gather, schema)


def _blob(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds) + 1)[1:], 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _chunks(batches: Iterator[pa.RecordBatch], set_of: SetsOf, row_of) -> Iterator[tuple[int, list, list[np.ndarray]]]:
    """Number, rows and sets of each chunk of the task's rows; the number holds the partition."""
    part, number, rows, sets, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for some in slices(batch, "text", SLICE):
            found = set_of(some.column("text"))
            for r, own in zip(some.drop_columns(["text"]).to_pylist(), found):
                sets.append(own)
                rows.append(row_of(r, own))
                size += len(own)
                if size >= CHUNK_SHINGLES or len(rows) >= CHUNK_DOCS:
                    yield part << 24 | number, rows, sets
                    number, rows, sets, size = number + 1, [], [], 0
    if rows:
        yield part << 24 | number, rows, sets


def describe(docs: DataFrame, set_of: SetsOf, threshold: Fraction) -> DataFrame:
    """doc_id, mark, n_shingles, digest of the set, and whether enough shingles occur elsewhere, of
    every row of ``docs`` (doc_id, text, mark). set_of: of texts, their sorted distinct 64-bit hashes."""
    parts, splits = _deal(docs)
    n_buckets = parts * splits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda r, s: (r["doc_id"], len(s), r["mark"], hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        for chunk, rows, sets in _chunks(batches, set_of, row):
            ids = np.array([r[0] or 0 for r in rows], "<i8")
            null = np.array([r[0] is None for r in rows], "?")
            sizes, marks = np.array([r[1] for r in rows], "<i8"), np.array([r[2] for r in rows], "<i8")
            every = np.concatenate(sets)
            _, which, count = np.unique(every, return_inverse=True, return_counts=True)
            within = np.bincount(np.repeat(np.arange(len(sets)), sizes), (count > 1)[which] if len(which) else None, len(sets)).astype("<i8")
            yield from _packed(chunk, sets, n_buckets, _blob(ids, null, marks, sizes, within, np.frombuffer(b"".join(r[3] for r in rows), "u1")), True)
        release()

    def of_chunk(meta: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, null, marks, sizes, shared, digests = _unblob(meta, "<i8", "?", "<i8", "<i8", "<i8", "u1")
        shared = shared.copy()
        for a in answers.values():
            owner, count = np.frombuffer(a, np.uint32).reshape(2, -1)
            shared[owner] += count
        raw = digests.tobytes()
        near = (sizes > 0) & (shared * threshold.denominator >= sizes * threshold.numerator)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(marks), pa.array(sizes), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), pa.array(near)], ["doc_id", "mark", "n_shingles", "digest", "near"])

    answers = _answers(docs.select("doc_id", "text", "mark").mapInArrow(spread, _PACKED), parts, splits, True)
    return _gathered(answers, parts, of_chunk, "doc_id long, mark long, n_shingles long, digest binary, near boolean")


def sets_of(docs: DataFrame, nodes: DataFrame, set_of: SetsOf, threshold: Fraction) -> DataFrame:
    """node, size and the shared shingles of the nodes' sets, rarest first, as packed 64-bit integers;
    nodes with too few shared ones are left out."""
    parts, splits = _deal(docs)
    n_buckets = parts * splits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, sets in _chunks(batches, set_of, lambda r, s: (r["doc_id"], len(s))):
            ids, sizes = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8")
            yield from _packed(chunk, sets, n_buckets, _blob(ids, sizes, np.concatenate(sets)), False)
        release()

    def of_chunk(meta: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, sizes, every = _unblob(meta, "<i8", "<i8", "<u8")
        unique, which = np.unique(every, return_inverse=True)
        frequency = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), np.uint8)
        if len(frequency) != len(unique):
            raise RuntimeError("a chunk changed between its tasks: read the documents from a stored table")
        frequency = frequency[which]
        ends = np.cumsum(sizes)
        out: list[tuple] = []
        for node, size, end in zip(ids.tolist(), sizes.tolist(), ends.tolist()):
            s, f = every[end - size : end], frequency[end - size : end]
            s, f = s[f > 1], f[f > 1]
            if len(s) >= least_overlap(size, threshold):
                out.append((node, size, s[np.lexsort((s, f))].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["node", "size", "shared"])

    texts = docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    # The exchange below asks for a chunk's rows again only as packed, never from this join.
    return _gathered(_answers(texts.mapInArrow(spread, _PACKED), parts, splits, False), parts, of_chunk, "node long, size long, shared binary")


# Step 4: T-occurrence search


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two arrays of distinct elements share."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Index:
    """Inverted lists over clusters of linked nodes, with DivideSkip search."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.lists: dict[int, list[int]] = {}
        self.parent: list[int] = []
        self.members: list[list[tuple]] = []

    def find(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = c = self.parent[self.parent[c]]
        return c

    def search(self, shared: list[int], least: int) -> list[int]:
        """The clusters in which ``least`` or more of ``shared`` occur."""
        found = [x for x in map(self.lists.get, shared) if x]
        if len(found) < least or least < 1:
            return []
        found.sort(key=len)
        n_long = min(int(least / (MU * log2(len(found[-1]) + 1) + 1)), least - 1)
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        need = least - len(long)
        out = []
        for c, run in groupby(heapq.merge(*short)):
            count = sum(1 for _ in run)
            if count < need:
                continue
            for i, x in enumerate(long):
                if count + len(long) - i < least:
                    break
                at = _bisect(x, c)
                count += at < len(x) and x[at] == c
            if count >= least:
                out.append(c)
        return out

    def partners(self, node: tuple) -> Iterator[tuple[int, tuple]]:
        """One linked member of each cluster that has any: (cluster, member). node: id, size, and the
        hashes of its shared shingles as an array without order."""
        for c in dict.fromkeys(map(self.find, self.search(node[2].tolist(), least_overlap(node[1], self.threshold)))):
            own = self.members[c]
            for i, other in enumerate(own):
                if other[0] != node[0] and other[1] * self.threshold <= node[1] and node[1] * self.threshold <= other[1] and links(overlap(node[2], other[2]), node[1], other[1], self.threshold):
                    if i:  # who links often is asked first
                        own[i], own[i // 2] = own[i // 2], own[i]
                    yield c, other
                    break

    def add(self, node: tuple, clusters: Iterable[int] = ()) -> None:
        """Puts a node into the clusters, which become one, or into a new one."""
        roots = sorted({self.find(c) for c in clusters}, key=lambda c: -len(self.members[c]))
        if roots:
            home = roots[0]
            for c in roots[1:]:
                self.parent[c] = home
                self.members[home] += self.members[c]
                self.members[c] = []
            self.members[home].append(node)
        else:
            home = len(self.parent)
            self.parent.append(home)
            self.members.append([node])
        for s in node[2].tolist():
            x = self.lists.setdefault(s, [])
            at = _bisect(x, home)
            if at == len(x) or x[at] != home:
                x.insert(at, home)


def _bisect(x: list[int], c: int) -> int:
    low, high = 0, len(x)
    while low < high:
        mid = (low + high) // 2
        if x[mid] < c:
            low = mid + 1
        else:
            high = mid
    return low


def _search_blocks(rows: DataFrame, n_blocks: int, threshold: Fraction) -> DataFrame:
    """a, b: enough links for the components. rows: block (a number; blocks are dealt to tasks in turn),
    kind (0: indexed and asking what is already there; 1: asking the block's whole index), node, size,
    shared."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, held = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if r["block"] != block:
                        block, index = r["block"], Index(threshold)
                    node = (r["node"], r["size"], np.frombuffer(r["shared"], "<u8"))
                    found = list(index.partners(node))
                    held += [(node[0], other[0]) for _, other in found]
                    if r["kind"] == 0:
                        index.add(node, [c for c, _ in found])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64())], ["a", "b"])
                    held = []
        release()

    parts = max(1, min(shuffle_partitions(rows.sparkSession), n_blocks))
    dealt = rows.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "kind", "size", "node")
    return dealt.select("block", "kind", "node", "size", "shared").mapInArrow(search, "a long, b long")


def numbered(groups: DataFrame, key: str, blocks: str) -> tuple[DataFrame, int]:
    """``groups`` with ``base``, how many blocks all groups before it have, and how many there are. A
    prefix sum in two steps; the driver holds a number a partition."""
    parts = shuffle_partitions(groups.sparkSession)
    placed = fitted(cut(groups.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))))
    sums = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum(blocks).alias("n")).collect()}
    before = np.cumsum([0, *(sums.get(i, 0) for i in range(parts))]).tolist()
    within = F.sum(blocks).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before[:parts]]), F.col("_part") + 1)
    return placed.withColumn("base", start + F.coalesce(within, F.lit(0))).drop("_part"), before[-1]


def length_bounds(threshold: Fraction, top: int = 1 << 40) -> np.ndarray:
    """The first length of each partition: a set is like sets of its own and the next one only."""
    out = [1]
    while out[-1] < top:
        out.append(int(out[-1] / threshold) + 1)
    return np.array(out)


def prefix_ties(sets: DataFrame, threshold: Fraction, by_length: bool = False) -> DataFrame:
    """a, b: each node tied to the least node that has the same prefix shingle; by_length: and is in
    the same or the next partition of lengths."""
    bounds = length_bounds(threshold)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, nodes = [], []
                for r in batch.slice(at, 512).to_pylist():
                    shared = np.frombuffer(r["shared"], "<i8")
                    # Those that nobody shares are the rarest, and use up their part of the prefix.
                    n = len(shared) - least_overlap(r["size"], threshold) + 1
                    keys.append(shared[:n])
                    if by_length:
                        part = int(np.searchsorted(bounds, r["size"], "right"))
                        own = keys[-1] ^ (np.int64(part) * np.int64(0x5851F42D4C957F2D))
                        keys[-1] = np.concatenate([own, keys[-1] ^ (np.int64(part + 1) * np.int64(0x5851F42D4C957F2D))])
                    nodes.append(np.full(len(keys[-1]), r["node"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["shingle", "node"])

    rows = sets.mapInArrow(prefixes, "shingle long, node long")
    first = rows.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select(F.col("shingle").alias("_s"), "first")
    return rows.join(first, F.col("shingle") == F.col("_s")).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()


def find_links(sets: DataFrame, threshold: Fraction, block: int = BLOCK, by_length: bool = False) -> DataFrame:
    """a, b: links whose components are those of all links between the sets."""
    groups = stored(components(prefix_ties(sets, threshold, by_length)), "groups")
    sizes = sets.select("node", F.octet_length("shared").alias("bytes")).join(groups, "node")
    sizes = sizes.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("members"), (F.sum("bytes") / 8).alias("shingles"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / BLOCK_SHINGLES)))
    sizes, n_blocks = numbered(sizes, "_label", "blocks")
    sizes = fitted(cut(sizes))
    member = sets.join(groups, "node").join(sizes, F.col("label") == F.col("_label"))
    small = member.where("blocks = 1").select(F.col("base").alias("block"), F.lit(0).alias("kind"), "node", "size", "shared")
    found = _search_blocks(small, n_blocks, threshold)
    if sizes.where("blocks > 1").isEmpty():
        return found
    chunk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = cut(member.where("blocks > 1").withColumn("chunk", chunk).select("label", "members", "blocks", "base", "chunk", "node", "size", "shared"))
    return found.union(_large(large, n_blocks, threshold, block))


def _large(large: DataFrame, n_blocks: int, threshold: Fraction, block: int) -> DataFrame:
    """Links in groups of more than a block."""
    # The pivots: of each group about PIVOTS nodes, chosen by hash among all its nodes.
    pivot = large.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("members")) < PIVOTS)
    first = pivot.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    first = first.select((F.col("base") + F.col("chunk")).alias("block"), F.lit(0).alias("kind"), "node", "size", "shared")
    first = first.union(large.select((F.col("base") + F.col("chunk")).alias("block"), F.lit(1).alias("kind"), "node", "size", "shared"))
    known = stored(_search_blocks(first, n_blocks, threshold), "pivot-links")
    labels = stored(components(known), "pivot-clusters").withColumnRenamed("label", "cluster")
    now = large.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("cluster", F.coalesce("cluster", "node"))
    bounds = F.array(*[F.lit(int(x)) for x in length_bounds(threshold)])
    now = cut(now.select("label", "node", "size", "cluster", F.size(F.filter(bounds, lambda x: x <= F.col("size"))).alias("length"), "shared"))
    most = now.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("label").alias("_label")).agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
    now = now.join(most, F.col("label") == F.col("_label")).withColumn("asks", F.col("cluster") != F.col("main")).drop("_label", "main", "cluster")
    # A link between two components has an end outside the main one: that end asks all blocks of sets
    # in its own and the neighbouring partitions of lengths. Where many ask, a block is searched in
    # parts, each with its share of the queries: no task grows with its group.
    own = now.groupBy("label", "length").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length("shared")) / 8).alias("shingles"), F.count_if("asks").alias("asking"))
    near = own.select("label", F.explode(F.array(F.col("length") - 1, "length", F.col("length") + 1)).alias("length"), "asking")
    near = near.groupBy("label", "length").agg(F.sum("asking").alias("asking"))
    blocks = own.drop("asking").join(near, ["label", "length"]).where("asking > 0")
    blocks = blocks.withColumn("chunks", F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES))).withColumn("parts", F.ceil(F.col("asking") / ASKING))
    blocks = blocks.select(F.struct("label", "length").alias("_of"), "chunks", "parts", (F.col("chunks") * F.col("parts")).alias("blocks"))
    blocks, n_blocks = numbered(blocks, "_of", "blocks")
    blocks = fitted(cut(blocks))
    deal = lambda name, n: F.pmod(F.xxhash64("node", F.lit(name)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    number = (F.col("base") + F.col("chunk") * F.col("parts") + F.col("part")).alias("block")
    indexed = now.join(blocks, F.struct("label", "length") == F.col("_of")).withColumn("chunk", deal("chunk", "chunks")).withColumn("part", every("parts"))
    asking = now.where("asks").withColumn("_near", F.explode(F.array(F.col("length") - 1, "length", F.col("length") + 1)))
    asking = asking.join(blocks, F.struct("label", F.col("_near").alias("length")) == F.col("_of")).withColumn("part", deal("part", "parts")).withColumn("chunk", every("chunks"))
    rows = [x.select(number, F.lit(kind).alias("kind"), "node", "size", "shared") for kind, x in enumerate((indexed, asking))]
    return known.union(_search_blocks(rows[0].union(rows[1]), n_blocks, threshold))


def classes(docs: DataFrame, set_of: SetsOf, threshold: Fraction, block: int = BLOCK, by_length: bool = False) -> DataFrame:
    """doc_id, mark, n_shingles, digest, near and label of every row of ``docs`` (doc_id, text, mark).
    label: the least doc_id that its text reaches; null for texts that have nothing in common with
    others, and for those that only rows with null ids have."""
    known = stored(describe(docs, set_of, threshold), "shingle-sets")
    nodes = known.where("near and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = stored(nodes.where("node is not null"), "shingle-nodes")
    sets = stored(sets_of(docs, nodes, set_of, threshold), "shingle-lists")
    labels = stored(components(find_links(sets, threshold, block, by_length)), "labels")
    found = nodes.join(labels, "node", "left").select(F.col("digest").alias("_digest"), F.coalesce("label", "node").alias("label"))
    return known.join(found, (F.col("digest") == F.col("_digest")) & F.col("near"), "left").drop("_digest")


def join(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("mark"))
    return classes(docs, lambda texts: shingle_sets(texts, n), threshold, block).select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


def stage(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row of each component: that with the least id, of equal ids that with the least hash of its
    text. Rows that only null ids have make classes of equal sets. Rows without shingles stay.

    A row is known by its id and its text's 64-bit hash; equal ones are told apart by nothing, so one of
    them stays. Only rows that equal another take part in that exchange."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark"))
    known = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")), lambda texts: shingle_sets(texts, n), threshold, block)
    one = F.coalesce(F.col("label").cast("string"), F.hex("digest"))
    rows = known.where("near and n_shingles > 0").groupBy(one.alias("one"), "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy(F.col("one").alias("_one")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")).alias("first"))
    rows = rows.join(first, F.col("one") == F.col("_one")).withColumn("stays", F.col("first") == F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark"))
    # A document may stay for one class and go for another only if ids repeat; then its text decides.
    verdict = cut(rows.where("not stays or rows > 1").select(F.col("doc_id").alias("_known"), F.col("mark").alias("_text"), "stays"))
    at = F.col("_id").eqNullSafe(F.col("_known")) & F.col("_mark").eqNullSafe(F.col("_text"))
    kept = own.join(verdict.drop("stays"), at, "left_anti")
    again = verdict.where("stays").drop("stays")
    if not again.isEmpty():
        kept = kept.union(own.join(again, at, "left_semi").dropDuplicates(["_id", "_mark"]))
    return kept.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for ``query()``: all pairs of different sets that share a shingle, and least labels
    along their links until none changes."""
    return rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from {docs}),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) end)) as sh from d),
k as (select *, md5(array_to_string(sh, chr(10))) as digest from s),
n as (select digest, min(doc_id) as node, any_value(sh) as sh from k where len(sh) > 0 group by digest),
p as (select node, len(sh) as size, unnest(sh) as shingle from n),
l as (select a.node as x, b.node as y from p a join p b on a.shingle = b.shingle and a.node < b.node
      and {THRESHOLD.denominator} * least(a.size, b.size) >= {THRESHOLD.numerator} * greatest(a.size, b.size)
      group by a.node, b.node, a.size, b.size having 100 * count(*) >= 75 * (a.size + b.size - count(*))),
e as (select x, y from l union all select y, x from l),
r as (select node as start, node as reached from n union select r.start, e.y from r join e on r.reached = e.x),
c as (select start, min(reached) as component_id from r group by start)
select k.doc_id, cast(len(k.sh) as bigint) as n_shingles, coalesce(c.component_id, k.doc_id) as component_id
from k left join n on n.digest = k.digest and len(k.sh) > 0 left join c on c.start = n.node"""
