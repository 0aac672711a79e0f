"""WARC archives whose records are compressed one by one against a shared Zstandard dictionary.

An archive (``.warc.zst``) starts with a skippable frame (magic number 0x184D2A5D) that holds the
dictionary; every record follows as a frame of its own, so each can be read alone, given its offset
and that dictionary. The dictionary is built for each archive from records of that archive: of its
records, in parts of ``SAMPLE_PART`` bytes, every k-th, so that about ``SAMPLE_BYTES`` from all over
the archive are read, a documented bound; every record is archived whole. Archives hold about
``ARCHIVE_BYTES`` of records, or one longer record, so what a task keeps in memory is bounded.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id becomes
a ``response`` record; the others become ``revisit`` records that refer to it and carry no payload.
The map side finds digests and combines them before the exchange, and only (digest, page_id) pairs
of digests that occur twice or more come back to the pages.

Each attempt of a task writes archives of its own name; only those in the committed list count.

Defined cases: null html is an empty payload; a null or empty url gives no target URI, and white space
and control characters in one are percent-encoded; very long pages are archived and read back whole,
each in a task's memory; rows that repeat a page_id share its record id, null ones have ids of their
own; pages with a null page_id keep it, and revisit if an equal payload has a page_id, else are all responses; rows that
repeat the largest page_id are all responses; an empty table gives no archive and an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored, work_dir
from .files import attempt_name, locate

#: The magic number of the frame that holds the dictionary, and of dictionaries.
DICTIONARY_FRAME, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
#: Fixed value: the profile of revisits of the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES, SAMPLE_PART = 2 << 20, 16 << 10
ARCHIVE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "archive string, n_records long, n_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if it refers to a page."""
    name = "null" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Page-ID": name,
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
        "WARC-Refers-To-Page-ID": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes]):
    """A trained dictionary; of too few or too short records, one of their raw content."""
    import zstandard

    parts = [r[at : at + SAMPLE_PART] for r in records for at in range(0, len(r), SAMPLE_PART)]
    parts = parts[:: max(1, -(-sum(map(len, parts)) // SAMPLE_BYTES))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(parts)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes]) -> int:
    """The dictionary's frame, then a frame a record; the bytes written."""
    import zstandard

    shared = build_dictionary(records)
    raw = shared.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=True)
    total = 8 + len(raw)
    for r in records:
        frame = press.compress(r)
        out.write(frame)
        total += len(frame)
    return total


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    import zstandard

    magic, length = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    raw = source.read(length)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    left = source.read(1 << 20)
    while left:
        one = press.decompressobj()
        parts = [one.decompress(left)]
        while not one.eof:
            more = source.read(1 << 20)
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(more))
        left = one.unused_data or source.read(1 << 20)
        yield b"".join(parts)


def plan(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html and, of revisits, refers_to.

    The join is left to adaptive execution, which splits the partition of a hot payload.
    """
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    hashed = pages.withColumn("_digest", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1("html"))))
    copies = hashed.where("_digest is not null").groupBy(F.col("_digest").alias("_of")).agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_of", "_first")
    joined = hashed.join(copies, F.col("_digest") == F.col("_of"), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, **columns: str) -> DataFrame:
    """Writes the archives to the folder ``path``; their list: archive, n_records, n_bytes."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = locate(path)
        system.create_dir(folder, recursive=True)
        task, waiting, size, part = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pa.RecordBatch:
            name = attempt_name(f"part-{task:06d}-{part:04d}") + ".warc.zst"
            with system.open_output_stream(f"{folder}/{name}") as out:
                n = write_archive(out, waiting)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(waiting)], "n_bytes": [n]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    waiting.append(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date))
                    size += len(waiting[-1])
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        waiting, size, part = [], 0, part + 1
        if waiting:
            yield close()

    return stored(plan(pages, min_bytes, **columns).mapInArrow(archives, MANIFEST), "warc-list")


def read(archives: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record."""
    spark: SparkSession = archives.sparkSession

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = locate(path)
        number = lambda x: None if x in (None, "null") else int(x)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                found: list[tuple] = []
                with system.open_input_stream(f"{folder}/{name}") as source:
                    for data in read_archive(source):
                        head, block = parse(data)
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(head["WARC-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), digest(payload)) != (n, said):
                                raise ValueError(f"{name}: the payload of page {head['WARC-Page-ID']} is damaged")
                        found.append((number(head["WARC-Page-ID"]), n, said, kind, number(head.get("WARC-Refers-To-Page-ID")), head.get("WARC-Target-URI")))
                kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*found), kinds)], [k for k, _ in kinds])

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def query(pages: DataFrame) -> DataFrame:
    path = work_dir(pages.sparkSession, "warc")
    return read(write(pages, path), path)


def sql(pages: str = "pages") -> str:
    """DuckDB SQL for ``query()``."""
    url = "coalesce(url, '')"
    for code in (*range(1, 33), 127):
        url = f"replace({url}, chr({code}), '%{code:02X}')"
    return f"""
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex,
         max(page_id) over (partition by sha1(coalesce(html, ''))) as first
  from {pages}),
b as (select *, cast(from_hex(hex) as bit)::varchar as bits from p)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(1 + list_sum(list_transform(range(0, 5), lambda k: cast(substr(bits, i * 5 + k + 1, 1) as int) * (16 >> k))) as int), 1)), '') as payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to,
       nullif({url}, '') as url
from b"""
