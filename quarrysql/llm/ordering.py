"""Rows in the order of an id over partitions, with bounds that are known before the shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import shuffle_partitions, stored_bytes

RANGE_BYTES = 128 << 20


class Ranges:
    """Bounds of about equally many rows each; every bound is an id that a row has.

    Only the id column is read. The driver holds one bound a partition. Null ids come first. There are
    ``spark.sql.shuffle.partitions`` parts, or more if each would stand for over ``RANGE_BYTES`` of stored
    rows: what a task keeps of its range doesn't grow with the corpus.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", parts: int | None = None):
        n = parts or max(shuffle_partitions(df.sparkSession), stored_bytes(df) // RANGE_BYTES)
        steps = [i / n for i in range(n)]
        row = df.agg(F.percentile_approx(key, steps, F.lit(min(max(10_000, 20 * n), 1_000_000))).alias("at"), F.min(key).alias("low"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
        self.nulls = row["nulls"] > 0
        self.bounds = np.array(sorted({row["low"], *row["at"]} if row["at"] else []), np.int64)
        self.parts = max(1, len(self.bounds))

    def of(self, key: Column) -> Column:
        """The partition of an id."""
        bounds = self.bounds

        @F.pandas_udf("int")
        def where(ids: pd.Series) -> pd.Series:
            return _place(bounds, ids)

        return where(key)

    def with_next(self, key: Column) -> Column:
        """Where a row is needed, as codes: twice its partition; and, if it may open its partition,
        twice the partition before and 1, for which it is the row to come. The last partition's row
        to come is the very first row."""
        bounds, nulls = self.bounds, self.nulls

        @F.pandas_udf("array<int>")
        def where(ids: pd.Series) -> pd.Series:
            own = _place(bounds, ids)
            opens = ids.isna().to_numpy() & nulls
            if len(bounds):
                held = ids.notna().to_numpy() & (bounds[own] == ids.fillna(-1).to_numpy())
                opens |= held & ((own.to_numpy() > 0) | (not nulls))
            n = max(1, len(bounds))
            return pd.Series([[2 * p, 2 * ((p - 1) % n) + 1] if o else [2 * p] for p, o in zip(own, opens)], ids.index)

        return where(key)


def _place(bounds: np.ndarray, ids: pd.Series) -> pd.Series:
    if not len(bounds):
        return pd.Series(np.zeros(len(ids), np.int32), ids.index)
    known = ids.notna().to_numpy()
    at = np.zeros(len(ids), np.int32)
    at[known] = np.maximum(np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), "right") - 1, 0)
    return pd.Series(at, ids.index)
