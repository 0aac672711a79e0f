"""Token counts by a two-tier lookup on the map side.

First tier: the pieces that are frequent in the whole corpus, with the number of their tokens, as one
compact table that is broadcast: at most ``TABLE`` pieces, as joined text and one byte each. Second tier: what it lacks
is encoded by the library and kept in a bounded cache of the worker. No piece is shuffled to be
counted; the only rows exchanged are each task's heavy hitters (at most 1/``SHARE`` of them), from
which the table is made. The table decides how fast a count is, never what it is.

Pieces are what ``bpe.cut`` makes, each a whole number of the library's own pre-tokens.
``.model`` files go through sentencepiece, whole texts at a time and without a table.

Defined cases: null text is empty and has no tokens; repeated rows are counted one by one; very long
texts, of many lines or one, are counted whole, in time that grows with their length; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import cut, encoder, slices
from .common import stored
from .memory import of_worker

LIMIT = 1024
TABLE = 1 << 15
SHARE = 2e-5


def heavy(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """piece, count: every piece that makes up ``SHARE`` of a task's pieces or more, by lossy counting.

    What is as frequent in the corpus is as frequent in some task, so none is missed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, pruned = Counter(), 0, 0
        width = round(4 / SHARE)
        for batch in batches:
            for some in slices(batch, text):
                parts, _ = cut(pc.fill_null(some.column(0), "").cast(pa.string()))
                found = parts.value_counts()
                before, total = total, total + len(parts)
                seen.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
                if total // width > before // width:
                    pruned = total // width
                    seen = Counter({k: n for k, n in seen.items() if n > pruned})
        least = max(2, SHARE * total - pruned)
        top = [(k, n) for k, n in seen.items() if n >= least]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "count"])

    found = docs.select(text).mapInArrow(count, "piece string, count long")
    return found.groupBy("piece").agg(F.sum("count").alias("count"))


def frequent(docs: DataFrame, tokenizer: str, text: str = "text", most: int = TABLE) -> list[str]:
    """The most frequent pieces, ``most`` at most.

    Pieces are counted by the logarithm of their counts first, which gives the least count that leaves
    so many; only those come to the driver, so what it gets doesn't grow with the corpus.
    """
    found = stored(heavy(docs, tokenizer, text), "frequent-pieces").withColumn("level", F.floor(8 * F.log2("count")))
    levels = sorted(((r["level"], r["n"]) for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for level, n in levels:
        if total + n > most:
            break
        least, total = level, total + n
    if least is None:
        return []
    return [r["piece"] for r in found.where(F.col("level") >= least).select("piece").collect()]


def pack(pieces: list[str], tokenizer: str) -> tuple[bytes, bytes]:
    """The table: its pieces joined by NUL, and the number of tokens of each."""
    pieces = [p for p in pieces if "\0" not in p]
    counts = encoder(tokenizer, count=True).ask(pieces)
    short = [(p, n) for p, n in zip(pieces, counts) if n < 256]
    return "\0".join(p for p, _ in short).encode(), np.array([n for _, n in short], np.uint8).tobytes()


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(table[0].decode().split("\0"), table[1]))


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = tokenizer.endswith(".json")
    if pieces:
        packed = pack(frequent(docs, tokenizer), tokenizer)
        shared, mark = spark.sparkContext.broadcast(packed), zlib.crc32(packed[0])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts = pc.fill_null(some.column("text"), "")
                if pieces:
                    own = encoder(tokenizer, count=True)
                    table = of_worker("token counts", f"table {tokenizer} {mark}", lambda: unpack(shared.value))
                    found = own.counts(texts, table)
                else:
                    found = np.array(list(map(len, _model(tokenizer).encode(texts.to_pylist(), num_threads=1))), np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lookup, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _model(path: str):
    from sentencepiece import SentencePieceProcessor

    return of_worker("token counts", path, lambda: SentencePieceProcessor(model_file=path))


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return count(docs, tokenizer)
