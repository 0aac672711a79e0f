"""The syntax tree: frozen values, so that equal text gives equal nodes."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """An expression or a relation."""


@dataclass(frozen=True)
class Name(Node):
    path: str


@dataclass(frozen=True)
class Star(Node):
    of: str | None = None


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Position(Node):
    key: int | str


@dataclass(frozen=True)
class Parameter(Node):
    number: int


@dataclass(frozen=True)
class Tuple(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    to: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


@dataclass(frozen=True)
class As(Node):
    """A select item with its name."""

    arg: Node
    name: str


@dataclass(frozen=True)
class Load(Node):
    """A relation by name; the empty name has one row and no columns."""

    name: str


@dataclass(frozen=True)
class TableCall(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Alias(Node):
    relation: Node
    name: str


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node
    on: Node | None
    outer: bool = False


@dataclass(frozen=True)
class Order(Node):
    key: Node
    descending: bool = False


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Node, ...] = (Star(),)
    source: Node = Load("")
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[Order, ...] = ()
    limit: Node | None = None
    offset: Node | None = None
    distinct: bool = False


@dataclass(frozen=True)
class UnionAll(Node):
    left: Node
    right: Node
    order: tuple[Order, ...] = ()
    limit: Node | None = None
    offset: Node | None = None


@dataclass(frozen=True)
class Frame(Node):
    """A relation that is a DataFrame already."""

    df: object = field(compare=False)
    name: str = ""
