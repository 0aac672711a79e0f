"""Queries by method calls. Every step gives a new builder; nothing is shared or remembered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, types as T

from .plans import nodes as n
from .plans import parser


@dataclass(frozen=True)
class QueryBuilder:
    dataset: object = field(compare=False)
    columns: str = "*"
    source: n.Node | None = None
    conditions: tuple[str, ...] = ()
    keys: tuple[n.Node, ...] = ()
    ordering: tuple[n.Order, ...] = ()
    most: int | None = None
    skipped: int | None = None

    def _parse(self, how, text: str):
        return how(text, self.dataset.legacy_precedence)

    def select(self, *columns: str) -> "QueryBuilder":
        return replace(self, columns=", ".join(columns) or "*")

    def frm(self, relation) -> "QueryBuilder":
        """A relation's text, a query, a builder or a DataFrame."""
        return replace(self, source=self._relation(relation, parser.parse_from))

    def _relation(self, relation, how) -> n.Node:
        if isinstance(relation, str):
            return self._parse(how, relation)
        if isinstance(relation, DataFrame):
            return n.Frame(relation)
        return relation.node

    def join(self, relation, on: str | None = None, outer: bool = False) -> "QueryBuilder":
        right = self._relation(relation, parser.parse_join)
        return replace(self, source=n.Join(self.source or n.Load(""), right, self._parse(parser.parse, on) if on else None, outer))

    def where(self, condition: str) -> "QueryBuilder":
        """Several conditions must all hold."""
        return replace(self, conditions=(*self.conditions, condition))

    def group_by(self, keys: str) -> "QueryBuilder":
        return replace(self, keys=self._parse(parser.parse_group_by, keys))

    def order_by(self, keys: str) -> "QueryBuilder":
        return replace(self, ordering=self._parse(parser.parse_order_by, keys))

    def limit(self, n_rows: int) -> "QueryBuilder":
        return replace(self, most=n_rows)

    def offset(self, n_rows: int) -> "QueryBuilder":
        return replace(self, skipped=n_rows)

    @property
    def node(self) -> n.Select:
        where = None
        for text in self.conditions:
            one = self._parse(parser.parse, text)
            where = one if where is None else n.Binary("and", where, one)
        number = lambda x: None if x is None else n.Literal(x)
        return n.Select(self._parse(parser.parse_select, self.columns), self.source or n.Load(""), where, self.keys, None, self.ordering, number(self.most), number(self.skipped))

    operations = node

    @property
    def query(self):
        from .session import Query

        return Query(self.dataset, self.node)

    @property
    def schema(self) -> T.StructType:
        return self.query.schema

    def df(self, *params) -> DataFrame:
        return self.query.df(*params)

    def execute(self, *params):
        return self.query.execute(*params)

    def __iter__(self) -> Iterator[Row]:
        return iter(self.query)

    def dump(self) -> None:
        self.query.dump()

    def create_view(self, name: str) -> "QueryBuilder":
        self.query.create_view(name)
        return self
