"""Built-in aggregates, and folds that users write."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion


def _count(*args: Column) -> Column:
    return F.count(args[0]) if args else F.count(F.lit(1))


BUILTIN: dict[str, Callable[..., Column]] = {
    "count": _count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max, "min_by": F.min_by, "max_by": F.max_by, "avg": F.avg, "sum": F.sum,
    "stddev": F.stddev, "variance": F.variance, "approx_count_distinct": F.approx_count_distinct, "collect_list": F.collect_list, "collect_set": F.collect_set, "first": F.first,
}


@dataclass(frozen=True)
class Fold:
    """``function(state, *args)`` from ``initial`` (a value, or what makes one), then ``finalize``.

    A fold is sequential: one task takes a group's rows, one after the other, in no set order. Queries
    run it by ``stream``, which holds a batch of rows at a time. Called as a function it is a column
    for any ``agg``; that one needs a group's arguments together, as an array of structs, so its groups
    must fit a task.
    """

    function: Callable
    returns: T.DataType
    initial: object = None
    finalize: Callable | None = None

    def steps(self) -> tuple[Callable, Callable, Callable]:
        """What makes a state, takes rows into one, and ends one; workers need no package for them."""
        function, initial, finalize = self.function, self.initial, self.finalize

        def fresh():
            return initial() if callable(initial) else pickle.loads(pickle.dumps(initial))

        def take(state, rows):
            for r in rows:
                state = function(state, *r)
            return state

        return fresh, take, finalize or (lambda state: state)

    def __call__(self, *args: Column) -> Column:
        fresh, take, end = self.steps()
        packed = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]) if args else F.struct(F.lit(0).alias("none"))
        if not args:
            return F.udf(lambda rows: end(take(fresh(), [() for _ in rows])), self.returns)(F.collect_list(packed))
        return F.udf(lambda rows: end(take(fresh(), rows or ())), self.returns)(F.collect_list(packed))


def stream(df: DataFrame, keys: list[str], calls: list[tuple[Fold, list[Column]]], name: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with a column ``name``, and of each call the aggregate over that column, for groups by
    ``keys``, that is its result.

    Spark brings groups together by its own rules of equal keys (in runs of a sort, which spills) and
    marks each group's last row. Rows pass through Python in batches; at a last row the column has the
    results of all calls, else null.
    """
    window = Window.partitionBy(*[_sortable(F.col(k), df.schema[k].dataType) for k in keys]).orderBy(F.lit(0))
    args = [[a.alias(f"a{i}") for i, a in enumerate(own)] for _, own in calls]
    kinds = [df.select(*own).schema if own else T.StructType() for own in args]
    steps = [fold.steps() for fold, _ in calls]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        states = [fresh() for fresh, _, _ in steps]
        for batch in batches:
            last_of_group, *columns = batch if isinstance(batch, tuple) else (batch,)
            size = len(last_of_group)
            rows, at = [], 0
            for kind in kinds:
                own = pa.Table.from_arrays(columns[at : at + len(kind)], names=kind.names)
                rows.append(ArrowTableToRowsConversion.convert(own, kind, return_as_tuples=True) if kind.names else [()] * size)
                at += len(kind)
            found, start = {}, 0
            for last in pc.indices_nonzero(last_of_group).to_pylist():
                states = [take(s, r[start : last + 1]) for (_, take, _), s, r in zip(steps, states, rows)]
                found[last] = cloudpickle.dumps([end(s) for (_, _, end), s in zip(steps, states)])
                states, start = [fresh() for fresh, _, _ in steps], last + 1
            states = [take(s, r[start:]) for (_, take, _), s, r in zip(steps, states, rows)]
            yield pa.array([found.get(i) for i in range(size)], pa.binary()) if found else pa.nulls(size, pa.binary())

    def result(i: int) -> Column:
        fresh, _, end = steps[i]
        # A table without rows has no last row, but without keys it has a result.
        pick = F.udf(lambda found: end(fresh()) if found is None else pickle.loads(found)[i], calls[i][0].returns)
        return pick(F.get(F.collect_list(name), F.lit(0)))

    folded = F.arrow_udf(run, T.BinaryType()).asNondeterministic()
    ends = f"{name}_ends"
    df = df.withColumn(ends, F.lead(F.lit(False), 1, True).over(window))
    return df.withColumn(name, folded(F.col(ends), *[a for own in args for a in own])), [result(i) for i in range(len(calls))]


def _sortable(column: Column, kind: T.DataType) -> Column:
    """A key that windows take: maps, which have no order, become sorted entries."""
    if "map<" not in kind.simpleString():
        return column
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(_sortable(e["key"], kind.keyType).alias("key"), _sortable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sortable(x, kind.elementType))
    return F.when(column.isNotNull(), F.struct(*[_sortable(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
