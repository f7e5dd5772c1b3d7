"""The shape of a condition: its conjuncts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .ast import Call, Index, Lit, Node, Select, Var

_flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


@dataclass(frozen=True)
class Conjunct:
    """path operator literal, as far as a conjunct has them; a duration is given as it was written."""

    path: tuple | None
    operator: str | None = None
    literal: Any = None


def path_of(e: Node) -> tuple | None:
    if isinstance(e, Var):
        return (e.name,)
    if isinstance(e, Select) and not e.test and (p := path_of(e.of)):
        return (*p, e.field)
    if isinstance(e, Index) and isinstance(e.key, Lit) and (p := path_of(e.of)):
        return (*p, e.key.value)
    return None


def conjuncts(e: Node) -> list[Conjunct]:
    if isinstance(e, Call) and e.name == "&&":
        return [c for a in e.args for c in conjuncts(a)]
    if isinstance(e, Call) and e.name in _flip:
        a, b = e.args
        op = e.name
        if isinstance(a, Lit) and not isinstance(b, Lit):
            a, b, op = b, a, _flip[op]
        if (p := path_of(a)) is not None:
            return [Conjunct(p, op, (b.spelled or b.value) if isinstance(b, Lit) else None)]
    return [Conjunct(path_of(e))]
