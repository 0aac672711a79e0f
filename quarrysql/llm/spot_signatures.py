"""Document fingerprints by spot signatures.

Wherever a common word (an anchor) stands, it and the next ``CHAIN`` content words make a signature;
a fingerprint is the set of a text's signatures, 32 bits each. Boilerplate without running prose has
few anchors, so it weighs little. Sets are compared by their Jaccard likeness, pruned by their
lengths: of two sets whose lengths differ too much none is looked into.

``near_duplicates()`` links the documents of a table: a set of length n can only be like sets of
lengths n*t to n/t, so sets are partitioned by length and meet in their own and the next partition.
There, only sets that share one of their rarest signatures meet, in the blocks of the n-gram join's
search. Each row of ``query()`` has its component.

Defined cases: null text is empty; a text without words has an empty set; a text with words and no
complete chain has one signature, of all its words; two empty sets have likeness 1, an empty and
another 0; equal texts have equal fingerprints; words are cut at white space, lower-cased and
stripped of punctuation, and what is left empty is skipped. In ``with_edited()`` null ids come first
and rows of the same id are ordered by text; one document alone is its own next. Very long texts are
read whole: a text and its set must fit in a task's memory. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import slices
from .coded import coded_words, distinct, hashed
from .common import stored
from .memory import release
from .ngram_join import SLICE, classes
from .ordering import Ranges

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in is that it for on with as was be by this are from at an or not he a "
    "der die das und den von zu mit für des sich nicht auf dem ist im ein eine als auch "
    "de la le et les en du un pour que une est qui dans par sur au pas avec il "
    "el las los y del se no por con para su es una al lo como".split()
)
_ANCHORS = pa.array(sorted(ANCHORS))
CHAIN = 2
THRESHOLD = Fraction(3, 4)
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-–—…«»“”‘’¿¡"
_ANCHOR, _CONTENT, _NONE = 1, 2, 0


def _codes(words: pa.Array) -> np.ndarray:
    """Of raw words: a hash in the high bits, and in the two lowest whether it is an anchor, a content
    word or nothing."""
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=_STRIP)
    kinds = np.where(pc.is_in(plain, value_set=_ANCHORS).to_numpy(zero_copy_only=False), _ANCHOR, np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), _NONE, _CONTENT))
    return hashed(plain) & ~np.uint64(3) | kinds.astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct signatures of each text, as unsigned 32-bit integers."""
    codes, offsets = coded_words(texts, True, _codes)
    kinds = codes & np.uint64(3)
    content, anchors = np.flatnonzero(kinds == _CONTENT), np.flatnonzero(kinds == _ANCHOR)
    owner = np.searchsorted(offsets, anchors, "right") - 1
    after = np.searchsorted(content, anchors)
    # A chain is whole if its last content word is in the anchor's own text.
    last = np.append(content, np.full(CHAIN, len(codes) + 1))[after + CHAIN - 1]
    whole = last < offsets[1:][owner]
    anchors, after, owner = anchors[whole], after[whole], owner[whole]
    found = _mix(codes[anchors])
    for k in range(CHAIN):
        found = _mix(found + codes[content[after + k]])
    found = (found >> np.uint64(32)).astype(np.uint32)
    ends = np.searchsorted(owner, np.arange(len(offsets))).tolist()
    sets = []
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if a < b:
            sets.append(distinct(found[a:b]))
            continue
        some = codes[offsets[i] : offsets[i + 1]]
        some = some[(some & np.uint64(3)) != _NONE]
        sets.append(np.frombuffer(hashlib.blake2b(some.tobytes(), digest_size=4).digest(), "<u4").astype(np.uint32) if len(some) else np.zeros(0, np.uint32))
    return sets


def signatures(text: str | None) -> np.ndarray:
    """The signatures of one text."""
    return signature_sets(pa.array([text], pa.string()))[0]


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 if their lengths alone rule out ``floor``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < floor * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprint(sigs: np.ndarray) -> str:
    """The set as hexadecimal digits, eight a signature, ascending."""
    return sigs.astype(">u4").tobytes().hex()


def with_edited(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next
    document, and component_id: the label that ``labels`` (doc_id, mark, label) has for the id and the
    text's 64-bit hash, else the id. The texts are exchanged once: by ranges of the id, with a copy of
    each range's first document for the range before and the labels of the range's own."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = Ranges(docs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        known: dict[int, int] = {}  # the labels of the current id, by the hash of the text
        current: object = ()

        def compared(pairs: list[tuple]) -> pa.RecordBatch:
            """The result's rows of documents, each with the next one's text and signatures."""
            edited = [t[: len(t) - len(t) // 2] + following[: len(t) // 2] for _, t, _, _, following, _ in pairs]
            rows = []
            for (i, t, sigs, label, _, next_sigs), e, again in zip(pairs, edited, signature_sets(pa.array(edited, pa.string()))):
                rows.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(sigs), fingerprint(again), likeness(sigs, again), likeness(sigs, next_sigs), len(sigs), label))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "component_id"])

        over = False
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                pairs: list[tuple] = []
                for row, sigs in zip(some.to_pylist(), signature_sets(some.column("text"))):
                    if over:
                        break
                    if row["doc_id"] != current:
                        current, known = row["doc_id"], {}
                    if row["text"] is None:
                        known[row["mark"]] = row["label"]
                        continue
                    if held:
                        pairs.append((*held, row["text"], sigs))
                    held = (row["doc_id"], row["text"], sigs, known.get(row["mark"], row["doc_id"]))
                    over = row["ahead"]
                if pairs:
                    yield compared(pairs)
        release()

    parts = docs.withColumn("_code", F.explode(ranges.with_next(F.col("doc_id"))))
    parts = parts.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.lit(None).cast("long").alias("label"), F.shiftright("_code", 1).alias("_part"), (F.col("_code") % 2 == 1).alias("ahead"))
    if labels is not None:
        parts = parts.union(labels.select("doc_id", F.lit(None).cast("string"), "mark", "label", ranges.of(F.col("doc_id")), F.lit(False)))
    # Labels stand before the texts of their id.
    order = [F.col("ahead"), F.col("doc_id"), F.col("text").asc_nulls_first()]
    parts = parts.repartitionById(ranges.parts, F.col("_part")).sortWithinPartitions(*order).select("doc_id", "text", "mark", "label", "ahead")
    return parts.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, component_id long")


def _spread(texts: pa.Array) -> list[np.ndarray]:
    """Texts' signatures as sorted 64-bit integers, spread over their whole range: one to one."""
    wide = [s.astype(np.uint64) for s in signature_sets(texts)]
    return [np.sort((s << np.uint64(32) | s) * np.uint64(0x9E3779B97F4A7C15)) for s in wide]


def _classes(docs: DataFrame, threshold: Fraction) -> DataFrame:
    return classes(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")), _spread, threshold, by_length=True)


def near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_signatures and component_id: the least id among the documents that links of
    ``threshold`` likeness or more reach. Equal sets are one node, with the least of their ids; empty
    sets link with nothing; of rows with a null id, those that have a node's set get its component."""
    rows = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), threshold)
    return rows.select("doc_id", F.col("n_shingles").alias("n_signatures"), F.coalesce("label", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """The fingerprints of ``with_edited()`` with the components of ``near_duplicates()``."""
    found = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), THRESHOLD)
    labels = stored(found.where("label is not null and not (label <=> doc_id)").select("doc_id", "mark", "label").distinct(), "spot-labels")
    return with_edited(docs, labels)
