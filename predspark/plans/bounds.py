"""Bounds on what may be compiled: a text's length, its nesting, and a static estimate of its cost."""

from __future__ import annotations

from dataclasses import dataclass

from predspark.errors import Problem

from .ast import Const, Fold, Node
from .lexer import tokens


@dataclass(frozen=True)
class Limits:
    """Names and defaults are fixed values of the language."""

    max_source_len: int = 8192
    max_depth: int = 32
    max_cost: int = 1_000_000
    max_list_len: int = 1_000_000
    max_total_elements: int = 1_000_000
    max_unroll: int = 256


#: Elements that a fold over a collection of unknown size is taken to have.
ASSUMED = 100


def check_source(text: str, limits: Limits) -> Problem | None:
    if len(text.encode("utf-8", "surrogatepass")) > limits.max_source_len:
        return Problem(f"the expression is longer than {limits.max_source_len} bytes", 0, len(text))
    depth = run = 0
    for t in tokens(text):
        if t.kind == "op" and t.value in "([{?":
            depth, run = depth + 1, 0
        elif t.kind == "op" and t.value in ")]}":
            depth, run = depth - 1, 0
        elif t.kind == "op" and t.value in "!-":
            run += 1
        else:
            run = 0
        if depth + run >= limits.max_depth:
            return Problem(f"the expression nests deeper than {limits.max_depth}", t.start, t.end)
    return None


def cost(e: Node) -> int:
    if isinstance(e, Fold):
        n = len(e.over.value) if isinstance(e.over, Const) else ASSUMED
        return 1 + cost(e.over) + max(1, n) * sum(cost(x) for x in (e.keep, e.value) if x is not None)
    return 1 + sum(cost(c) for c in e.children())
