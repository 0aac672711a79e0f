"""Decoders of files by MIME type.

A codec is either a Spark reader, or a Python function from an open text file to records, which runs
on executors, a file at a time.
"""

from __future__ import annotations

import csv
import io
import mimetypes
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from ..types import struct

#: What is read of the first file to learn how CSV is written there: so many lines, then characters.
SAMPLE_LINES, SAMPLE_CHARS = 2_000, 200_000
DELIMITERS = ",;\t|"
Where = str | list[str]


@dataclass(frozen=True)
class Codec:
    """``read(spark, folder or files, schema, first file, parameters)`` gives records and ``_file``."""

    read: Callable[[SparkSession, Where, T.StructType | None, str, dict[str, str]], DataFrame]


_CODECS: dict[str, Codec] = {}


def codec(mime: str) -> Codec | None:
    """The codec of a MIME type, with the parameters that stand in it (``text/csv; header=absent``)."""
    base, *rest = (x.strip() for x in mime.split(";"))
    found = _CODECS.get(base)
    if found is None or not rest:
        return found
    given = dict(x.split("=", 1) for x in rest if "=" in x)
    return Codec(lambda spark, where, schema, first, _=None: found.read(spark, where, schema, first, given))


def guess(path: str) -> str:
    return mimetypes.guess_type(path)[0] or "application/octet-stream"


def exact(reader: DataFrameReader) -> DataFrameReader:
    """A reader that takes paths as they are, without patterns in them."""
    return reader.option("__globPaths__", "false").option("recursiveFileLookup", True)


def _file():
    from ..operators.files import plain_path

    return plain_path(F.col("_metadata.file_path")).alias("_file")


def _reader(form: str, **options) -> Codec:
    def read(spark, where, schema, first, given=None):
        reader = exact(spark.read.format(form).options(**options))
        return (reader.schema(schema) if schema is not None else reader).load(where).select("*", _file())

    return Codec(read)


def delimiter(sample: str) -> str:
    """The one that cuts the most lines of a sample into the same number of cells, two at least; a comma
    if none does."""
    best, most = ",", 0
    for mark in DELIMITERS:
        sizes = Counter(len(row) for row in csv.reader(io.StringIO(sample), delimiter=mark) if row)
        cells, lines = max(sizes.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        if cells > 1 and lines > most:
            best, most = mark, lines
    return best


def _headed(sample: str) -> bool:
    try:
        return csv.Sniffer().has_header(sample)
    except csv.Error:
        return True


def _read_csv(spark: SparkSession, where: Where, schema: T.StructType | None, first: str, given: dict[str, str] | None = None) -> DataFrame:
    """The first line of every file is its header and never a record. Without a schema all values are
    strings, and columns are named by the first file's header if it looks like one, else ``column_0``
    and so on; a schema's values are cast to it, and found by their names in the header or, if it
    doesn't have them, by position.

    Parameters: ``header=absent`` makes the first line a record, ``header=present`` takes its names in any
    case; ``breaks=none`` says that no value holds a line break, so that large files can be split.
    """
    given = given or {}
    sample = "\n".join(r[0] for r in exact(spark.read).text(first).take(SAMPLE_LINES))[:SAMPLE_CHARS]
    mark, absent = delimiter(sample), given.get("header") == "absent"
    reader = exact(spark.read).options(sep=mark, quote='"', escape='"', header=not absent, multiLine=given.get("breaks") != "none", enforceSchema=True)
    names = next(csv.reader(io.StringIO(sample), delimiter=mark), [])
    strings = lambda names: T.StructType([T.StructField(x, T.StringType()) for x in names])
    if schema is None:
        headed = given.get("header") == "present" or not absent and _headed(sample)
        return reader.schema(strings(names if headed else [f"column_{i}" for i in range(len(names))])).csv(where).select("*", _file())
    raw = reader.schema(strings(names if not absent and set(schema.names) <= set(names) else schema.names)).csv(where)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], _file())


def decodes(mime: str, schema: Callable | T.StructType | None = None):
    """Registers ``function(file) -> records`` for a MIME type. ``schema``: of the records, or what
    gives it from an open file; else the schema declared with the table."""

    def register(function: Callable[[io.TextIOBase], Iterator]):
        def read(spark, where, declared, first, given=None):
            own = declared if declared is not None else schema
            if callable(own):
                own = own(io.StringIO(exact(spark.read).text(first, wholetext=True).first()[0]))
            if own is None:
                raise ValueError(f"records of {mime} need a schema")
            out = T.StructType([*struct(own).fields, T.StructField("_file", T.StringType())])

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for text, path in zip(batch["value"], batch["_file"]):
                        rows = [(*(r.values() if isinstance(r, dict) else r), path) for r in function(io.StringIO(text))]
                        yield pd.DataFrame(rows, columns=out.names)

            texts = exact(spark.read).text(where, wholetext=True).select("value", _file())
            return texts.mapInPandas(run, out)

        _CODECS[mime] = Codec(read)
        return function

    return register


_CODECS["text/csv"] = Codec(_read_csv)
_CODECS["text/tab-separated-values"] = Codec(_read_csv)
_CODECS["application/json"] = _reader("json")
_CODECS["application/parquet"] = _CODECS["application/vnd.apache.parquet"] = _reader("parquet")
_CODECS["application/orc"] = _reader("orc")
mimetypes.add_type("application/parquet", ".parquet")
mimetypes.add_type("application/orc", ".orc")
