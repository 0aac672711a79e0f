"""Stored tables: Parquet folders, JDBC, and locations named in a query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .base import Source


class Parquet(Source):
    """The ``<name>.parquet`` of a folder that Spark can read."""

    def __init__(self, folder: str, *tables: str):
        self.folder, self.tables = folder.rstrip("/"), tables

    def names(self):
        return iter(self.tables)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}.parquet")


class Locations(Source):
    """A path or URL in place of a name: ``from 's3a://bucket/folder/'``. Folders named ``key=value``
    become columns, and filters on them prune folders."""

    def __init__(self, form: str = "csv", **options):
        self.form, self.options = form, options or ({"header": True} if form == "csv" else {})

    def has(self, name: str) -> bool:
        return bool(re.match(r"[a-z][a-z0-9+.-]*:/|/", name))

    def load(self, spark, name):
        ending = re.search(r"\.(parquet|orc|json|csv)/?$", name)
        form = ending[1] if ending else self.form
        return spark.read.format(form).options(**(self.options if form == self.form else {"header": True} if form == "csv" else {})).load(name)


class Jdbc(Source):
    """Tables of a database, by Spark's JDBC source, which pushes filters and columns down."""

    def __init__(self, url: str, *tables: str, **options):
        self.url, self.tables, self.options = url, tables, options

    def names(self):
        return iter(self.tables)

    def load(self, spark, name):
        return spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()
