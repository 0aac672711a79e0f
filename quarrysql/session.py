"""The session: sources, views, functions and queries."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from .builder import QueryBuilder
from .functions import aggregates, scalar
from .operators import files
from .operators.flatten import flatten
from .plans import nodes as n
from .plans.binder import Binder, walk
from .plans.parser import parse_statement
from .sources.base import Dual, Source
from .types import spark_type, struct


class Query:
    """A statement of a session. It is bound when its schema or rows are asked for."""

    def __init__(self, dataset: "DataSet", node: n.Node):
        self.dataset, self.node = dataset, node

    def df(self, *params) -> DataFrame:
        return Binder(self.dataset, params).relation(self.node).output()

    @property
    def schema(self) -> T.StructType:
        return self.df().schema

    def execute(self, *params):
        return self.dataset.execute(self, *params)

    def __iter__(self) -> Iterator[Row]:
        return iter(self.execute())

    def dump(self) -> None:
        self.dataset.dump(self.schema, self.df())

    def create_view(self, name: str) -> None:
        self.dataset.create_view(name, self)


class DataSet:
    """What queries can name. Sources are asked in the order in which they were added; views come
    first."""

    def __init__(self, spark: SparkSession, legacy_precedence: bool = False):
        self.spark, self.legacy_precedence = spark, legacy_precedence
        self.sources: list[Source] = [Dual()]
        self.views: dict[str, DataFrame] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.folds: dict[str, Callable[..., Column]] = {}
        self.tables: dict[str, Callable[..., DataFrame]] = {
            "flatten": flatten,
            "files": lambda *a: files.files(spark, *a),
            "extract_path": files.extract_path,
            "contents": files.contents,
            "decode": lambda df, mime="auto", schema=None, path_column="path": files.decode(df, mime, None if schema is None else self.get_schema(schema) if isinstance(schema, str) else struct(schema), path_column),
        }
        self._loaded: dict[str, DataFrame] = {}
        self._compile: Callable[[Query], Callable] = lambda query: lambda ctx: query.df(*ctx["params"]).toLocalIterator()
        self._dump: Callable | None = None

    # Sources and views

    def add_source(self, source: Source) -> Source:
        if not any(s is source for s in self.sources):
            self.sources.append(source)
        return source

    add_adapter = add_server = add_source

    def source_for(self, name: str) -> Source | None:
        return next((s for s in self.sources if s.has(name)), None)

    adapter_for = source_for

    def load(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]
        if name not in self._loaded:
            source = self.source_for(name)
            if source is None:
                raise LookupError(f"no relation {name!r}")
            self._loaded[name] = source.load(self.spark, name)
        return self._loaded[name]

    def get_relation(self, name: str) -> DataFrame | None:
        return self.load(name) if name in self.views or self.source_for(name) else None

    def get_schema(self, name: str) -> T.StructType:
        return self.load(name).schema

    @property
    def relations(self) -> list[tuple[str, T.StructType]]:
        names = dict.fromkeys(name for s in self.sources for name in s.names())
        return [(name, self.get_schema(name)) for name in names]

    def create_view(self, name: str, query: "str | Query | DataFrame | n.Node") -> None:
        """The view is what the query means now; later views of the same names don't change it."""
        if isinstance(query, str):
            query = self.query(query)
        elif isinstance(query, n.Node):
            query = Query(self, query)
        self.views[name] = query if isinstance(query, DataFrame) else query.df()

    def get_view(self, name: str) -> DataFrame | None:
        return self.views.get(name)

    # Functions

    def add_function(self, name: str, function: Callable, returns=None) -> None:
        """A scalar function if ``returns`` declares a field (or is a type); a table function if
        ``returns`` is callable or the function is marked ``table``: called with the relation and
        constants, it gives a DataFrame, or rows of the schema that ``returns`` gives. One that has an
        attribute ``resolve`` is a table function too: ``resolve(function, dataset, *arguments)`` gives its
        DataFrame when a query is bound. Scalar functions get their values in Arrow batches; pandas
        functions (``F.pandas_udf``) are taken as they are."""
        if name in self.functions or name in self.tables:
            raise ValueError(f"function {name!r} is registered already")
        if hasattr(function, "resolve"):
            self.tables[name] = lambda *args: function.resolve(function, self, *args)
        elif getattr(function, "table", False):
            self.tables[name] = function
        elif getattr(function, "evalType", 0):
            self.functions[name] = function
        elif callable(returns) and not isinstance(returns, T.DataType):
            self.tables[name] = self._rows(function, returns)
        else:
            kind = returns if isinstance(returns, T.DataType) else T._parse_datatype_string(returns) if isinstance(returns, str) else spark_type(returns or {"type": "STRING"})
            own = F.udf(function, kind, useArrow=True)
            self.functions[name] = own
            if returns is not None:
                self.spark.udf.register(name, function, kind)

    def _rows(self, function: Callable, returns: Callable) -> Callable[..., DataFrame]:
        def table(*args):
            kinds = struct(returns(*args))
            if args and isinstance(args[0], DataFrame):
                rest = args[1:]

                def run(batches):
                    import pandas as pd

                    for batch in batches:
                        yield pd.DataFrame([tuple(r) for r in function(batch.itertuples(index=False), *rest)], columns=kinds.names)

                return args[0].mapInPandas(run, kinds)
            return self.spark.createDataFrame([tuple(r) for r in function(*args)], kinds)

        return table

    def function(self, returns=None, name: str | None = None):
        def register(f):
            self.add_function(name or f.__name__, f, returns)
            return f

        return register

    def add_aggregate(self, name: str, function: Callable, returns, initial=None, finalize: Callable | None = None) -> None:
        kind = returns if isinstance(returns, T.DataType) else T._parse_datatype_string(returns) if isinstance(returns, str) else spark_type(returns)
        self.folds[name] = aggregates.Fold(function, kind, initial, finalize)

    def aggregate(self, returns=None, initial=None, name: str | None = None, finalize: Callable | None = None):
        """Of a name that is given, what builds its aggregate; else a decorator that registers one."""
        if isinstance(returns, str) and initial is None and name is None and finalize is None:
            return self.folds.get(returns) or aggregates.BUILTIN.get(returns) or (aggregates.BUILTIN.get(returns.lower()) if returns not in self.functions else None)

        def register(f):
            self.add_aggregate(name or f.__name__, f, returns, initial, finalize)
            return f

        return register

    def scalar_function(self, name: str) -> Callable[..., Column]:
        found = self.functions.get(name) or scalar.BUILTIN.get(name) or scalar.BUILTIN.get(name.lower())
        if not found:
            raise NameError(f"no function {name!r}")
        return found

    def get_function(self, name: str) -> Callable:
        return self.tables.get(name) or self.aggregate(name) or self.scalar_function(name)

    def table_function(self, name: str, args: list) -> DataFrame:
        if name not in self.tables:
            raise NameError(f"no table function {name!r}")
        return self.tables[name](*args)

    # Queries

    def set_compiler(self, compiler: Callable[[Query], Callable]) -> None:
        """``compiler(query)`` gives what runs it, which is called with ``{"dataset", "params"}``."""
        self._compile = compiler

    def set_dump_func(self, dump: Callable[[T.StructType, DataFrame], None]) -> None:
        self._dump = dump

    def dump(self, schema: T.StructType, df: DataFrame) -> None:
        if self._dump is not None:
            self._dump(schema, df)

    def execute(self, query: "Query | str", *params):
        if isinstance(query, str):
            query = self.query(query)
        return self._compile(query)({"dataset": self, "params": params})

    def query(self, statement: str) -> Query:
        return Query(self, parse_statement(statement, self.legacy_precedence))

    def sql(self, statement: str, *params) -> DataFrame:
        """The DataFrame of a statement."""
        return self.query(statement).df(*params)

    def frm(self, relation) -> QueryBuilder:
        return QueryBuilder(self).frm(relation)

    def select(self, *columns: str) -> QueryBuilder:
        return QueryBuilder(self).select(*columns)


def replace_views(node: n.Node, dataset: DataSet) -> n.Node:
    """The tree with each load of a view replaced by what the view means."""
    return walk(node, lambda x: n.Frame(dataset.views[x.name], x.name) if isinstance(x, n.Load) and x.name in dataset.views else x)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, for those that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quarrysql_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "quarrysql-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._quarrysql_shipped = True
