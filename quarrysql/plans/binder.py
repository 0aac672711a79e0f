"""Syntax trees to DataFrames.

Inside, every column has a name of its own; a scope says which qualified name each one answers to.
So self joins, equal names and positions need no care from Spark's resolution, and qualifiers outlive
projections. Names are given back once, at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import aggregates, scalar
from ..types import DECLARED, cast_type, type_name
from . import nodes as n

_numbers = itertools.count()


class BindError(ValueError):
    """A name, type or clause that can't be bound."""


def fresh() -> str:
    return f"_q{next(_numbers)}"


@dataclass(frozen=True)
class Slot:
    """A column of a scope: its qualifier, its name, and its name inside."""

    qualifier: str | None
    name: str
    column: str


@dataclass(frozen=True)
class Bound:
    df: DataFrame
    slots: tuple[Slot, ...]

    def find(self, path: str) -> Slot:
        qualifier, _, name = path.rpartition(".")
        found = [s for s in self.slots if s.name == name and (not qualifier or s.qualifier == qualifier)]
        if not found:
            low = path.lower()
            found = [s for s in self.slots if s.name.lower() == low.rpartition(".")[2] and (not qualifier or (s.qualifier or "").lower() == qualifier.lower())]
        if not found:
            raise BindError(f"no column {path!r}; there are {', '.join(f'{s.qualifier}.{s.name}' if s.qualifier else s.name for s in self.slots) or 'none'}")
        if len(found) > 1:
            raise BindError(f"{path!r} is ambiguous")
        return found[0]

    def alias(self, name: str) -> "Bound":
        return replace(self, slots=tuple(replace(s, qualifier=name) for s in self.slots))

    def output(self) -> DataFrame:
        """The DataFrame with the names of its columns; repeated ones are numbered."""
        seen: dict[str, int] = {}
        columns = []
        for s in self.slots:
            seen[s.name] = seen.get(s.name, 0) + 1
            columns.append(F.col(s.column).alias(s.name if seen[s.name] == 1 else f"{s.name}_{seen[s.name]}"))
        return self.df.select(*columns)


def scan(df: DataFrame, qualifier: str | None) -> Bound:
    """A DataFrame as a scope."""
    slots = tuple(Slot(qualifier, c, fresh()) for c in df.columns)
    return Bound(df.select(*[F.col(f"`{c}`").alias(s.column) for c, s in zip(df.columns, slots)]), slots)


class Binder:
    """Binds against a catalogue: ``load(name)``, ``scalar_function(name)``, ``aggregate(name)`` and
    ``table_function(name)``, and the parameters of an execution."""

    def __init__(self, catalog, params: tuple = ()):
        self.catalog, self.params = catalog, params

    # Relations

    def relation(self, node: n.Node) -> Bound:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _load(self, node: n.Load) -> Bound:
        return scan(self.catalog.load(node.name), node.name or None)

    def _frame(self, node: n.Frame) -> Bound:
        return scan(node.df, node.name or None)

    def _alias(self, node: n.Alias) -> Bound:
        return self.relation(node.relation).alias(node.name)

    def _tablecall(self, node: n.TableCall) -> Bound:
        args = []
        for a in node.args:
            args.append(self.constant(a) if isinstance(a, (n.Literal, n.Parameter, n.Unary)) else self.relation(a).output())
        return scan(self.catalog.table_function(node.name, args), node.name)

    def _join(self, node: n.Join) -> Bound:
        left, right = self.relation(node.left), self.relation(node.right)
        slots = left.slots + right.slots
        if node.on is None and not node.outer:
            return Bound(left.df.crossJoin(right.df), slots)
        probe = Bound(left.df.limit(0).crossJoin(right.df.limit(0)), slots)
        on = self.predicate(node.on, probe) if node.on is not None else F.lit(True)
        return Bound(left.df.join(right.df, on, "left" if node.outer else "inner"), slots)

    def _unionall(self, node: n.UnionAll) -> Bound:
        left, right = self.relation(node.left), self.relation(node.right)
        if len(left.slots) != len(right.slots):
            raise BindError(f"UNION ALL of {len(left.slots)} and {len(right.slots)} columns")
        a, b = ([x.df.schema[s.column].dataType for s in x.slots] for x in (left, right))
        kinds = []
        for i, (x, y) in enumerate(zip(a, b)):
            if x != y and not isinstance(y, T.NullType) and type_name(x) != type_name(y):
                raise BindError(f"UNION ALL of {x.simpleString()} and {y.simpleString()} in column {i}")
            # Types of one declared name may differ in width; both sides become the widest.
            kinds.append(x if x == y or isinstance(y, T.NullType) else DECLARED.get(type_name(x), x))
        sides = [x.df.select(*[F.col(s.column).cast(k).alias(s.column) for s, k in zip(x.slots, kinds)]) for x in (left, right)]
        df = sides[0].union(sides[1])
        return self._cut(self._sort(Bound(df, left.slots), node.order), node)

    def _sort(self, bound: Bound, order: tuple[n.Order, ...]) -> Bound:
        keys = [self.direction(self.column(o.key, bound), o) for o in order if not isinstance(o.key, n.Literal)]
        return replace(bound, df=bound.df.orderBy(*keys)) if keys else bound

    @staticmethod
    def direction(column: Column, order: n.Order) -> Column:
        return column.desc_nulls_last() if order.descending else column.asc_nulls_first()

    def _cut(self, bound: Bound, node) -> Bound:
        df = bound.df
        if node.offset is not None:
            df = df.offset(int(self.constant(node.offset)))
        if node.limit is not None:
            df = df.limit(int(self.constant(node.limit)))
        return replace(bound, df=df)

    def _select(self, node: n.Select) -> Bound:
        source = self.relation(node.source)
        if node.where is not None:
            source = replace(source, df=source.df.where(self.predicate(node.where, source)))
        grouped = node.group or any(self.has_aggregate(i) for i in node.items) or node.having is not None
        if grouped:
            return self._cut(self._grouped(node, source), node)
        if node.items == (n.Star(),) and not node.distinct:
            return self._cut(self._sort(source, node.order), node)
        items = self.expand(node.items, source)
        slots = tuple(Slot(*self.naming(i, source), fresh()) for i in items)
        columns = [self.column(i, source).alias(s.column) for i, s in zip(items, slots)]
        out = Bound(source.df.select(*columns), slots)
        if node.distinct:
            return self._cut(self._sort(replace(out, df=out.df.distinct()), node.order), node)
        # Keys that the output lacks are taken along from the input.
        keys, more = [], []
        for o in node.order:
            if isinstance(o.key, n.Literal):
                continue
            try:
                keys.append(self.direction(self.column(o.key, out), o))
            except BindError:
                more.append(self.column(o.key, source).alias(fresh_name := fresh()))
                keys.append(self.direction(F.col(fresh_name), o))
        df = source.df.select(*columns, *more)
        if keys:
            df = df.orderBy(*keys)
        if more:
            df = df.select(*[s.column for s in slots])
        return self._cut(Bound(df, slots), node)

    def _grouped(self, node: n.Select, source: Bound) -> Bound:
        items = self.expand(node.items, source)
        named = {name: (i.arg if isinstance(i, n.As) else i) for i, (_, name) in ((i, self.naming(i, source)) for i in items)}
        keys: dict[n.Node, str] = {}
        df = source.df
        for g in node.group:
            # A bare name is the output's before it is the input's.
            expr = named.get(g.path, g) if isinstance(g, n.Name) else g
            if self.has_aggregate(expr):
                raise BindError("an aggregate can't be a group key")
            keys[expr] = fresh()
            df = df.withColumn(keys[expr], self.column(expr, source))
        source = replace(source, df=df)
        sorted_by = [o.key if isinstance(o.key, n.Name) else self.inline(o.key, named) for o in node.order]
        source, folded = self.folded((*items, *(() if node.having is None else (self.inline(node.having, named),)), *sorted_by), source, list(keys.values()))
        df = source.df
        scope = Group(self, source, keys, bool(node.group), folded)
        slots = tuple(Slot(*self.naming(i, source), fresh()) for i in items)
        columns = [scope.column(i).alias(s.column) for i, s in zip(items, slots)]
        having, sorts, hidden = None, [], []
        by_name = {s.name: s.column for s in slots}

        def outer(expr: n.Node) -> str:
            if isinstance(expr, n.Name) and expr.path in by_name:
                return by_name[expr.path]
            hidden.append(scope.column(expr if not isinstance(expr, n.Name) else named.get(expr.path, expr)).alias(name := fresh()))
            return name

        if node.having is not None:
            having = outer(self.inline(node.having, named))
        for o in node.order:
            if not isinstance(o.key, n.Literal):
                sorts.append(self.direction(F.col(outer(o.key if isinstance(o.key, n.Name) else self.inline(o.key, named))), o))
        out = df.groupBy(*keys.values()).agg(*columns, *hidden)
        if having:
            out = out.where(self.truth(F.col(having), out.schema[having].dataType))
        if node.distinct:
            out = out.select(*[s.column for s in slots]).distinct()
        if sorts:
            out = out.orderBy(*sorts)
        return Bound(out.select(*[s.column for s in slots]), slots)

    def folded(self, exprs: tuple[n.Node, ...], source: Bound, keys: list[str]) -> tuple[Bound, dict[str, Column]]:
        """The source with a column of what users' folds in ``exprs`` give, and each fold's result as an
        aggregate over it. A stream can't be sorted: its folds stay aggregates over the arguments."""
        calls: dict[str, tuple[n.Call, aggregates.Fold]] = {}  # by all of the text: 1 and 1.0 are equal nodes
        if not source.df.isStreaming:
            walk(exprs, lambda x: calls.update({repr(x): (x, fold)}) or x if isinstance(x, n.Call) and not x.distinct and isinstance(fold := self.catalog.aggregate(x.name), aggregates.Fold) else x)
        if not calls:
            return source, {}
        args = [(fold, [self.column(a, source) for a in call.args if not isinstance(a, n.Star)]) for call, fold in calls.values()]
        df, results = aggregates.stream(source.df, keys, args, fresh())
        return replace(source, df=df), dict(zip(calls, results))

    def inline(self, expr: n.Node, named: dict[str, n.Node]) -> n.Node:
        """``expr`` with the names of select items replaced by what they stand for."""
        return walk(expr, lambda x: named[x.path] if isinstance(x, n.Name) and x.path in named else x)

    def expand(self, items: tuple[n.Node, ...], source: Bound) -> list[n.Node]:
        out: list[n.Node] = []
        for i in items:
            if isinstance(i, n.Star):
                some = [s for s in source.slots if i.of is None or s.qualifier == i.of]
                if not some and i.of is not None:
                    raise BindError(f"no relation {i.of!r}")
                out += [Ready(s) for s in some]
            else:
                out.append(i)
        return out

    def naming(self, item: n.Node, source: Bound) -> tuple[str | None, str]:
        """Qualifier and name of a select item."""
        if isinstance(item, n.As):
            return None, item.name
        if isinstance(item, Ready):
            return item.slot.qualifier, item.slot.name
        if isinstance(item, n.Name):
            s = source.find(item.path)
            return s.qualifier, s.name
        if isinstance(item, n.Position) and isinstance(item.key, int):
            return source.slots[item.key].qualifier, source.slots[item.key].name
        if isinstance(item, n.Call):
            return None, item.name
        return None, "?column?"

    # Expressions

    def has_aggregate(self, node: n.Node) -> bool:
        found = []
        walk(node, lambda x: found.append(x) or x if isinstance(x, n.Call) and self.catalog.aggregate(x.name) else x)
        return bool(found)

    def constant(self, node: n.Node):
        if isinstance(node, n.Literal):
            return node.value
        if isinstance(node, n.Parameter):
            return self.params[node.number]
        if isinstance(node, n.Unary) and node.op == "-":
            return -self.constant(node.arg)
        raise BindError(f"not a constant: {node}")

    def predicate(self, node: n.Node, scope: Bound) -> Column:
        column = self.column(node, scope)
        return self.truth(column, kind(scope.df, column))

    @staticmethod
    def truth(column: Column, of: T.DataType) -> Column:
        if isinstance(of, T.NumericType):
            return column != 0
        return column != "" if isinstance(of, T.StringType) else column

    def column(self, node: n.Node, scope) -> Column:
        """The column of an expression. scope: a Bound or a Group."""
        return Expression(self, scope).column(node)


@dataclass(frozen=True)
class Ready(n.Node):
    """A slot that a star stands for."""

    slot: Slot


def kind(df: DataFrame, column: Column) -> T.DataType:
    """What analysis says an expression's type is; nothing runs."""
    return df.select(column.alias("x")).schema[0].dataType


def walk(node, change: Callable):
    """The tree with every node changed, from the leaves."""
    if isinstance(node, tuple):
        return tuple(walk(x, change) for x in node)
    if not isinstance(node, n.Node) or isinstance(node, (Ready, n.Frame)):
        return change(node) if isinstance(node, n.Node) else node
    values = {k: walk(v, change) if isinstance(v, (tuple, n.Node)) else v for k, v in node.__dict__.items()}
    return change(type(node)(**values))


class Group:
    """The scope of a grouped select: keys, aggregates, and any row's value of the rest."""

    def __init__(self, binder: Binder, source: Bound, keys: dict[n.Node, str], explicit: bool, folded: dict[str, Column]):
        self.binder, self.source, self.keys, self.explicit, self.folded = binder, source, keys, explicit, folded

    def column(self, node: n.Node) -> Column:
        return Expression(self.binder, self).column(node)

    def kind(self, column: Column) -> T.DataType:
        return self.source.df.groupBy(*self.keys.values()).agg(column.alias("x")).schema["x"].dataType

    def free(self, column: Column, path: str) -> Column:
        if not self.explicit:
            raise BindError(f"{path!r} is neither aggregated nor grouped by")
        return F.first(column)


class Expression:
    """Builds the columns of one scope."""

    def __init__(self, binder: Binder, scope):
        self.binder, self.scope = binder, scope
        self.group = scope if isinstance(scope, Group) else None
        self.bound: Bound = scope.source if self.group else scope

    def kind(self, column: Column) -> T.DataType:
        return self.group.kind(column) if self.group else kind(self.bound.df, column)

    def column(self, node: n.Node) -> Column:
        if self.group and node in self.group.keys:
            return F.col(self.group.keys[node])
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _slot(self, slot: Slot) -> Column:
        if self.group:
            for key, name in self.group.keys.items():
                if isinstance(key, n.Name) and self.bound.find(key.path) == slot or isinstance(key, Ready) and key.slot == slot:
                    return F.col(name)
            return self.group.free(F.col(slot.column), slot.name)
        return F.col(slot.column)

    def _ready(self, node: Ready) -> Column:
        return self._slot(node.slot)

    def _name(self, node: n.Name) -> Column:
        return self._slot(self.bound.find(node.path))

    def _position(self, node: n.Position) -> Column:
        if not isinstance(node.key, int):
            return self._slot(self.bound.find(node.key))
        if node.key >= len(self.bound.slots):
            raise BindError(f"there is no column ${node.key}")
        return self._slot(self.bound.slots[node.key])

    def _as(self, node: n.As) -> Column:
        return self.column(node.arg)

    def _literal(self, node: n.Literal) -> Column:
        return F.lit(node.value).cast("long") if type(node.value) is int else F.lit(node.value)

    def _parameter(self, node: n.Parameter) -> Column:
        if node.number >= len(self.binder.params):
            return F.lit(None)
        return self._literal(n.Literal(self.binder.params[node.number]))

    def _tuple(self, node: n.Tuple) -> Column:
        return F.struct(*[self.column(x).alias(f"_{i}") for i, x in enumerate(node.items)])

    def _star(self, node: n.Star) -> Column:
        raise BindError("* stands only in a select list or in count(*)")

    def _unary(self, node: n.Unary) -> Column:
        arg = self.column(node.arg)
        if node.op == "-":
            return -arg
        return ~F.coalesce(self.binder.truth(arg, self.kind(arg)), F.lit(False))

    def _between(self, node: n.Between) -> Column:
        return self.column(node.arg).between(self.column(node.low), self.column(node.high))

    def _case(self, node: n.Case) -> Column:
        out = F
        for test, then in node.branches:
            t = self.column(test)
            out = out.when(self.binder.truth(t, self.kind(t)), self.column(then))
        return out.otherwise(self.column(node.otherwise)) if node.otherwise is not None else out

    def _cast(self, node: n.Cast) -> Column:
        return self.column(node.arg).cast(cast_type(node.to))

    def _binary(self, node: n.Binary) -> Column:
        op = node.op
        if op == "in":
            return self._in(node)
        if op in ("->", "->>"):
            key = self.binder.constant(node.right)
            return (scalar.json_get if op == "->" else scalar.json_get_text)(self.column(node.left), key)
        a, b = self.column(node.left), self.column(node.right)
        if op in ("and", "or"):
            a, b = (self.binder.truth(x, self.kind(x)) for x in (a, b))
            return a & b if op == "and" else a | b
        if op == "like":
            return F.like(a, b)
        if op in ("rlike", "regexp"):
            return F.rlike(a, b)
        if op in ("=", "is"):
            return a.eqNullSafe(b)
        if op in ("!=", "is not"):
            return ~a.eqNullSafe(b)
        if op == "+" and all(isinstance(self.kind(x), T.StringType) for x in (a, b)):
            return F.concat(a, b)
        if op == "/":
            return scalar.floor_divide(a, b) if all(scalar.is_integral(self.kind(x)) for x in (a, b)) else a / b
        return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)

    def _in(self, node: n.Binary) -> Column:
        items = node.right.items if isinstance(node.right, n.Tuple) else (node.right,)
        value = self.column(node.left)
        if items and all(isinstance(i, n.Literal) and i.value is not None for i in items):
            return F.coalesce(value.isin([i.value for i in items]), F.lit(False))
        out = F.lit(False)
        for i in items:
            out = out | value.eqNullSafe(self.column(i))
        return out

    def _call(self, node: n.Call) -> Column:
        catalog = self.binder.catalog
        build = catalog.aggregate(node.name)
        if build:
            if not self.group:
                raise BindError(f"{node.name}() is an aggregate and can't stand here")
            if repr(node) in self.group.folded:
                return self.group.folded[repr(node)]
            inner = Expression(self.binder, self.bound)
            args = [inner.column(a) for a in node.args if not isinstance(a, n.Star)]
            if node.distinct:
                build = catalog.aggregate(f"{node.name}_distinct")
                if not build:
                    raise BindError(f"{node.name}(distinct) isn't known")
            return build(*args)
        return catalog.scalar_function(node.name)(*[self.column(a) for a in node.args])


__all__ = ["AnalysisException", "BindError", "Binder", "Bound", "scan"]
