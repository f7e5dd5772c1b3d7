"""Nodes of a parsed expression.  start and end are offsets in the authored text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(eq=False)
class Node:
    start: int = field(default=0, kw_only=True)
    end: int = field(default=0, kw_only=True)
    type: Any = field(default=None, kw_only=True)

    def children(self) -> Iterator[Node]:
        return iter(())


@dataclass(eq=False)
class Lit(Node):
    """bool, int, float, str, bytes, None or Span; spelled keeps a duration as it was written."""

    value: Any
    spelled: str | None = None


@dataclass(eq=False)
class Const(Node):
    """A known list or map that took the place of what computed it; slot names it in a residual's text."""

    value: Any
    slot: int = -1


@dataclass(eq=False)
class Var(Node):
    name: str


@dataclass(eq=False)
class Select(Node):
    """x.f, has(x.f) if test, x.?f if maybe."""

    of: Node
    field: str
    test: bool = False
    maybe: bool = False

    def children(self):
        yield self.of


@dataclass(eq=False)
class Index(Node):
    of: Node
    key: Node
    maybe: bool = False

    def children(self):
        yield self.of
        yield self.key


@dataclass(eq=False)
class Call(Node):
    """Operators, functions and methods; the receiver of a method is the first argument."""

    name: str
    args: list[Node]
    member: bool = False

    def children(self):
        yield from self.args


@dataclass(eq=False)
class ListOf(Node):
    items: list[Node]

    def children(self):
        yield from self.items


@dataclass(eq=False)
class MapOf(Node):
    entries: list[tuple[Node, Node]]

    def children(self):
        for k, v in self.entries:
            yield k
            yield v


@dataclass(eq=False)
class Fold(Node):
    """kind: exists, all, exists_one, filter, map; keep is the predicate, value the expression of map."""

    kind: str
    over: Node
    var: str
    keep: Node | None
    value: Node | None = None

    def children(self):
        yield self.over
        if self.keep is not None:
            yield self.keep
        if self.value is not None:
            yield self.value


@dataclass(frozen=True, order=True)
class Span:
    """A duration in nanoseconds."""

    ns: int


def walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children():
        yield from walk(c)
