"""Tests against known lists, in forms that stay inside generated code and reach the scan."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from predspark.plans.ast import Call, Fold, Lit, Node, Var

#: Prefixes up to which a chain of StartsWith is used, which Parquet scans can push down.
CHAIN = 16


def is_one_of(x: Column, values: list[str]) -> Column:
    return x.isin(*dict.fromkeys(values)) if values else F.when(x.isNotNull(), F.lit(False))


def starts_with_any(x: Column, prefixes: list[str]) -> Column:
    """x starts with one of the prefixes: a chain for a few; else, after dropping prefixes of which another is a
    prefix, one IN per distinct length over the first characters of x."""
    prefixes = sorted(set(prefixes))
    least: list[str] = []
    for p in prefixes:
        if not least or not p.startswith(least[-1]):
            least.append(p)
    if not least:
        return F.when(x.isNotNull(), F.lit(False))
    if "" in least:
        return F.when(x.isNotNull(), F.lit(True))
    if len(least) <= CHAIN:
        tests = [F.startswith(x, F.lit(p)) for p in least]
    else:
        by_length: dict[int, list[str]] = defaultdict(list)
        for p in least:
            by_length[len(p)].append(p)
        tests = [F.substring(x, 1, n).isin(*own) for n, own in sorted(by_length.items())]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def recognise(e: Fold, items: list) -> tuple[str, Node, str] | None:
    """For exists over known strings: ("equal", x, ""), ("prefix", x, suffix) or ("either", x, suffix), for
    x == r, x.startsWith(r + suffix), and their disjunction."""
    if e.kind != "exists" or not all(isinstance(i, str) for i in items):
        return None
    terms = e.keep.args if isinstance(e.keep, Call) and e.keep.name == "||" else [e.keep]
    found = [_term(t, e.var) for t in terms]
    if None in found:
        return None
    if len(found) == 1:
        return found[0]
    from predspark.plans.unparse import unparse

    kinds = {f[0]: f for f in found}
    if len(found) == 2 and set(kinds) == {"equal", "prefix"} and unparse(found[0][1]) == unparse(found[1][1]):
        return ("either", found[0][1], kinds["prefix"][2])
    return None


def _term(t: Node, var: str) -> tuple[str, Node, str] | None:
    if not isinstance(t, Call):
        return None
    is_var = lambda n: isinstance(n, Var) and n.name == var
    free = lambda n: not _reads(n, var)
    if t.name == "==":
        for a, b in (t.args, t.args[::-1]):
            if is_var(b) and free(a):
                return ("equal", a, "")
    if t.name == "startsWith" and free(t.args[0]):
        p = t.args[1]
        if is_var(p):
            return ("prefix", t.args[0], "")
        if isinstance(p, Call) and p.name == "+" and is_var(p.args[0]) and isinstance(p.args[1], Lit) and isinstance(p.args[1].value, str):
            return ("prefix", t.args[0], p.args[1].value)
    return None


def _reads(e: Node, var: str) -> bool:
    if isinstance(e, Var):
        return e.name == var
    if isinstance(e, Fold):
        return _reads(e.over, var) or e.var != var and any(_reads(x, var) for x in (e.keep, e.value) if x is not None)
    return any(_reads(c, var) for c in e.children())


__all__ = ["is_one_of", "recognise", "starts_with_any"]
