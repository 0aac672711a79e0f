"""Table functions over files: files, extract_path, contents and decode.

Paths are columns, and what a pattern reads from them are expressions over those columns. Where a
filter names such columns only, Spark prunes files before it opens them: ``decode_tree`` derives them
from the scan's own file path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.codecs import codec, exact, guess

_GROUP = re.compile(r"\{(\w+)\}")


def pattern(template: str) -> tuple[str, list[str]]:
    """The regular expression of ``a/{name}.csv``, and its names in order. A name matches anything but
    a slash."""
    names, out, at = [], "^", 0
    for m in _GROUP.finditer(template):
        out += re.escape(template[at : m.start()]) + "([^/]*)"
        names.append(m[1])
        at = m.end()
    return out + re.escape(template[at:]), names


def plain(column: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(column, "^file:/+", "/")


def plain_path(column: Column) -> Column:
    """A scan's file path without that scheme and with its escapes read."""
    return plain(F.call_function("url_decode", F.replace(column, F.lit("+"), F.lit("%2B"))))


def files(spark: SparkSession, root_dir: str, filename_column: str = "path") -> DataFrame:
    """A row for each file below a folder. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root_dir)
    return found.select(plain(F.col("path")).alias(filename_column))


def extract_path(df: DataFrame, template: str, path_column: str = "path") -> DataFrame:
    """The rows whose path begins as the pattern says, with a string column for each of its names."""
    expression, names = pattern(template)
    path = F.col(f"`{path_column}`")
    df = df.where(path.rlike(expression))
    return df.withColumns({name: F.regexp_extract(path, expression, i + 1) for i, name in enumerate(names)})


def _named(df: DataFrame, path_column: str) -> list[str]:
    """The distinct paths of a column, in order. The driver holds them, as it does the list of files of
    any scan."""
    column = F.col(f"`{path_column}`")
    return sorted(r[0] for r in df.where(column.isNotNull()).select(column).distinct().toLocalIterator())


def contents(df: DataFrame, path_column: str = "path", content_column: str = "contents") -> DataFrame:
    """The rows with the whole text of the file each names. Only the files named are read; rows without
    a path go."""
    names = _named(df, path_column)
    if not names:
        return df.where("false").withColumn(content_column, F.lit(None).cast("string"))
    texts = exact(df.sparkSession.read).text(names, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("_file"), F.col("value").alias("_text"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != content_column]
    return df.join(texts, plain(F.col(f"`{path_column}`")) == F.col("_file")).select(*kept, F.col("_text").alias(content_column))


def decode(df: DataFrame, mime: str = "auto", schema: T.StructType | None = None, path_column: str = "path") -> DataFrame:
    """A row for each record of the file that each row names: its columns, then the record's. Only the
    files named are read; of columns without a schema, the first file in order gives the names."""
    spark = df.sparkSession
    names = _named(df, path_column)
    if not names:
        extra = [f for f in (schema or T.StructType()) if f.name not in df.columns]
        return df.where("false").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    kinds: dict[str, list[str]] = {}
    for name in names:
        kinds.setdefault(guess(name) if mime == "auto" else mime, []).append(name)
    records = None
    for kind, own in kinds.items():
        some = decode_tree(spark, own, kind, schema, own[0], set(df.columns))
        if records is None:
            records, schema = some, schema or T.StructType([f for f in some.schema if f.name != "_file"])
        else:
            records = records.unionByName(some)
    return df.join(records, plain(F.col(f"`{path_column}`")) == F.col("_file")).drop("_file")


def decode_tree(spark: SparkSession, root: str | list[str], mime: str, schema: T.StructType | None, first: str, taken: set[str]) -> DataFrame:
    """The records of all files below a folder, or of those listed, with the ``_file`` each is from; columns in ``taken``
    are left out, as the path's value wins."""
    own = codec(mime)
    if own is None:
        raise ValueError(f"no codec for {mime!r}")
    if schema is not None:
        schema = T.StructType([f for f in schema if f.name not in taken])
    records = own.read(spark, root, schema, first, {})
    kept = [F.col(f"`{f.name}`") for f in records.schema if f.name not in taken or f.name == "_file"]
    return records.select(*kept)
