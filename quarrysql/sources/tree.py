"""Folders as tables, with column values in the files' paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.files import contents, decode_tree, extract_path, files, pattern
from ..types import struct
from .base import Source
from .codecs import guess

_OPTIONS = {"root_dir", "pattern", "filename_column", "content_column", "decode", "schema"}


class Trees(Source):
    """``Trees(name=dict(root_dir=..., pattern=..., filename_column=..., content_column=..., decode=...,
    schema=...))``.

    Decoded tables read their path columns from the scan's file path, so a filter that names path
    columns only is evaluated on the list of files, and the others are never opened.
    """

    def __init__(self, **tables):
        for name, options in tables.items():
            if unknown := set(options) - _OPTIONS:
                raise ValueError(f"{name}: unknown options {', '.join(sorted(unknown))}")
        self.tables = tables

    def names(self):
        return iter(self.tables)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        own = self.tables[name]
        root = own["root_dir"].rstrip("/")
        filename, content, mime = own.get("filename_column"), own.get("content_column"), own.get("decode")
        schema = struct(own["schema"]) if own.get("schema") else None
        template = f"{root}/{own['pattern'].lstrip('/')}" if own.get("pattern") else None
        if mime in (None, "none"):
            df = files(spark, root, filename or "path")
            df = extract_path(df, template, filename or "path") if template else df
            df = contents(df, filename or "path", content) if content else df
            return df if filename or not template else df.drop("path")
        listed = files(spark, root)
        first = (extract_path(listed, template) if template else listed).agg(F.min("path")).first()[0]
        names = pattern(template)[1] if template else []
        if first is None:
            kinds = {f.name: f.dataType for f in schema} if schema else {}
            return listed.where("false").select(*[F.lit("").alias(x) for x in names], *[F.lit(None).cast(k).alias(x) for x, k in kinds.items() if x not in names])
        records = decode_tree(spark, root, guess(first) if mime == "auto" else mime, schema, first, set(names))
        if template:
            records = extract_path(records, template, "_file")
        own_columns = [c for c in records.columns if c not in ("_file", *names)]
        lead = [F.col("_file").alias(filename)] if filename else []
        return records.select(*lead, *names, *own_columns)
