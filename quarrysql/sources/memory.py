"""Tables of Python dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..types import struct
from .base import Source


class Dicts(Source):
    """``Dicts(users=dict(schema=..., rows=[...]))``, or only the rows, whose types are then inferred.

    A field that a row lacks is null, or empty if it is repeated.
    """

    def __init__(self, **tables):
        self.tables = tables

    def names(self):
        return iter(self.tables)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        table = self.tables[name]
        if not isinstance(table, dict):
            return spark.createDataFrame(table)
        kinds = struct(table["schema"])
        blank = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in kinds}
        return spark.createDataFrame([tuple(r.get(f.name, blank[f.name]) for f in kinds) for r in table.get("rows", ())], kinds)
