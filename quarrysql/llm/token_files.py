"""Token-id output: flat files of unsigned integers and 64-bit document offsets.

A store is a folder with three files a shard: ``.ids`` (every id, little-endian, 16 bits if the
vocabulary allows, else 32), ``.offsets`` (unsigned 64-bit, one more than documents, in ids from the
shard's start) and ``.docs`` (signed 64-bit document ids); and a Parquet table ``index`` with one row a shard: its file stem,
counts and ``base``, the ids before it, from a prefix sum. Shards follow each other in ascending
document id. Readers map the files into memory.

Each attempt of a task writes files of its own name and only the attempt whose row is committed to
the index counts, so lost executors and repeated tasks do no harm.

Defined cases: null text is empty and still gets its end id; documents with a null id come first and
keep it; rows with the same id are ordered by text; an empty table gives an empty store. A task
holds a few megabytes of texts at a time, or one longer text. Other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import encoder, slices, vocabulary_size
from .common import work_dir
from .files import attempt_name, locate, mapped
from .ordering import Ranges

END_ID = 2
INDEX = "shard int, stem string, n_docs long, n_null long, n_tokens long, width int"


def id_dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a store to ``path`` and returns its index."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = Ranges(docs)
    dtype = id_dtype(max(vocabulary_size(tokenizer), end_id + 1))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, dtype=dtype)
        number = TaskContext.get().partitionId()
        system, folder = locate(path)
        system.create_dir(folder, recursive=True)
        stem = attempt_name(f"shard-{number:06d}")
        lengths, ids, nulls = [], [], 0
        with system.open_output_stream(f"{folder}/{stem}.ids") as out:
            for batch in batches:
                for some in slices(batch, "text"):
                    found, sizes = own.encode(some.column("text"), end_id)
                    out.write(found.tobytes())
                    lengths.append(sizes)
                    nulls += some.column("doc_id").null_count
                    ids.append(some.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        if not lengths:
            system.delete_file(f"{folder}/{stem}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        for kind, array in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
            with system.open_output_stream(f"{folder}/{stem}.{kind}") as out:
                out.write(array.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "stem": [stem], "n_docs": [len(offsets) - 1], "n_null": [nulls], "n_tokens": [int(offsets[-1])], "width": pa.array([np.dtype(dtype).itemsize], pa.int32())})

    parts = docs.withColumn("_part", ranges.of(F.col("doc_id"))).repartitionById(ranges.parts, F.col("_part")).sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    parts.mapInArrow(shard, INDEX).write.parquet(f"{path}/written")
    # One row a shard: the prefix sum needs no more than that in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = spark.read.schema(INDEX).parquet(f"{path}/written").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    index.write.parquet(f"{path}/index")
    index = spark.read.schema(f"{INDEX}, base long").parquet(f"{path}/index")
    _drop_leftovers(index, path)
    return index


def _drop_leftovers(index: DataFrame, path: str) -> None:
    """Removes what attempts without a row in the index have written."""
    system, folder = locate(path)
    kept = {r["stem"] for r in index.select("stem").toLocalIterator()}
    for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if x.type == fs.FileType.File and os.path.splitext(x.base_name)[0] not in kept:
            system.delete_file(x.path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    index = spark.read.schema(f"{INDEX}, base long").parquet(f"{path}/index")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{path}/{row['stem']}"
                ids, offsets, docs = mapped(f"{stem}.ids", f"<u{row['width']}"), mapped(f"{stem}.offsets", "<u8").astype(np.int64), mapped(f"{stem}.docs", "<i8")
                for at in range(0, row["n_docs"], 4096):
                    to = min(at + 4096, row["n_docs"])
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    null = np.arange(at, to) < row["n_null"]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(docs[at:to]), pa.int64(), mask=null), "start": row["base"] + offsets[at:to], "n_tokens": offsets[at + 1 : to + 1] - offsets[at:to], "ids_crc32": pa.array(crc, pa.int64())})

    return index.repartitionById(shards, F.col("shard")).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = work_dir(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
