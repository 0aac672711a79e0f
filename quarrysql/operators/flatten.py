"""flatten: arrays to rows, records to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def flatten(df: DataFrame, field: str) -> DataFrame:
    """A row for each element of an array, or the fields of a record as columns ``field_sub`` in its
    place, or both. Rows without an element, or without the record, go."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.ArrayType):
        df = df.withColumn(field, F.explode(F.col(f"`{field}`")))
        kind = kind.elementType
        if not isinstance(kind, T.StructType):
            return df
    elif not isinstance(kind, T.StructType):
        raise ValueError(f"flatten needs a repeated field or a record; {field!r} is {kind.simpleString()}")
    columns = []
    for c in df.columns:
        columns += [F.col(f"`{c}`.`{s}`").alias(f"{c}_{s}") for s in kind.names] if c == field else [F.col(f"`{c}`")]
    return df.where(F.col(f"`{field}`").isNotNull()).select(*columns)
