"""Connected components of an undirected graph, by alternating stars over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fitted

#: A task's edges are made a forest in parts of so many.
PART = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a task's edges a forest with the same components, every node hung on its
    component's least one there."""

    def united(us: list[int], vs: list[int]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for u, v in zip(us, vs):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = np.array([(x, find(x)) for x in parent], np.int64).reshape(-1, 2)
        rows = rows[rows[:, 0] != rows[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["u", "v"])

    us: list[int] = []
    vs: list[int] = []
    for batch in batches:
        us += batch.column(0).to_pylist()
        vs += batch.column(1).to_pylist()
        if len(us) >= PART:
            yield united(us, vs)
            us, vs = [], []
    if us:
        yield united(us, vs)


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node in ``edges`` (a long, b long); label: the least node it reaches.

    Large stars tie each node's greater neighbours to its least one, small stars its smaller ones;
    when nothing changes, every node hangs on its component's least node. Before the first round each
    task makes its own edges a forest, which leaves fewer of them and shorter ways. A round is two
    aggregations and a join by node, with partial aggregation before the exchange and the join left to
    adaptive execution, and ends in a checkpoint.
    """
    # The checkpoint also parts the forests from Python before them: a task has one worker.
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = cut(fitted(now).mapInArrow(_forest, "u long, v long").distinct())
    before = None
    while True:
        size = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if size == before or not size[0]:
            break
        before = size
        now = fitted(now, size[0])
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
