"""The same queries over streams: a streaming DataFrame is a relation like any other.

Filters, projections, joins with tables and windowed aggregations over a watermark are as Spark's
Structured Streaming has them; sorting and limits aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.base import Source


class Streams(Source):
    """``Streams(events=dict(format="parquet", path=..., schema=..., watermark=("ts", "10 minutes")))``"""

    def __init__(self, **tables):
        self.tables = tables

    def names(self):
        return iter(self.tables)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        own = dict(self.tables[name])
        reader = spark.readStream.format(own.pop("format", "parquet"))
        schema, path, watermark = own.pop("schema", None), own.pop("path", None), own.pop("watermark", None)
        reader = reader.options(**own)
        df = (reader.schema(schema) if schema is not None else reader).load(path)
        return df.withWatermark(*watermark) if watermark else df
