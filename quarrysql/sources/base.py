"""What a source is: relations by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, types as T


class Source:
    """A subclass gives ``names()`` and ``load()``; ``has()`` may know more names than it lists."""

    def names(self) -> Iterator[str]:
        return iter(())

    def has(self, name: str) -> bool:
        return name in set(self.names())

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        raise NotImplementedError

    def schema(self, spark: SparkSession, name: str) -> T.StructType:
        return self.load(spark, name).schema


class Dual(Source):
    """The empty name: one row without columns."""

    def has(self, name: str) -> bool:
        return name == ""

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.range(1).select()


class Frames(Source):
    """DataFrames that exist already."""

    def __init__(self, **frames: DataFrame):
        self.frames = frames

    def names(self):
        return iter(self.frames)

    def load(self, spark, name):
        return self.frames[name]
