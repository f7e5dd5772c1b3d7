"""Python (JSON-like) values under a declared type."""

from __future__ import annotations

from typing import Any

from predspark.errors import SpecializeProblem
from predspark.functions import durations
from predspark.plans.ast import Span
from predspark.plans.bounds import Limits
from predspark.types import BOOL, BYTES, DURATION, DYN, LEAST_INT, MOST_INT, NULL, NUM, STR, ListOf, MapOf, Record, Type


def bind(v: Any, t: Type, path: str = "value", limits: Limits | None = None) -> Any:
    """v in the form that evaluation wants.  The type leads: missing optional fields stay absent, undeclared keys are
    dropped unless the record has a type for them, and a value of another kind is an error."""
    limits = limits or Limits()
    count = [0]

    def fail(path: str, t: Type, v: Any):
        raise SpecializeProblem(f"{path}: the type is {t}, the value {v!r}")

    def go(v: Any, t: Type, path: str) -> Any:
        count[0] += 1
        if count[0] > limits.max_total_elements:
            raise SpecializeProblem(f"{path}: more than {limits.max_total_elements} elements")
        if t == BOOL and isinstance(v, bool) or t == STR and isinstance(v, str) or t == BYTES and isinstance(v, bytes) or t == NULL and v is None:
            return v
        if t == NUM and isinstance(v, (int, float)) and not isinstance(v, bool):
            return fail(path, t, v) if isinstance(v, int) and not LEAST_INT <= v <= MOST_INT else v
        if t == DURATION:
            if isinstance(v, Span):
                return v
            d = durations.parse(v) if isinstance(v, str) else None
            return d if d is not None else fail(path, t, v)
        if isinstance(t, ListOf) and isinstance(v, (list, tuple)):
            if len(v) > limits.max_list_len:
                raise SpecializeProblem(f"{path}: more than {limits.max_list_len} elements")
            return [go(x, t.of, f"{path}[{i}]") for i, x in enumerate(v)]
        if isinstance(t, MapOf) and isinstance(v, dict):
            return {go(k, t.key, path): go(x, t.value, f"{path}[{k!r}]") for k, x in v.items()}
        if isinstance(t, Record) and isinstance(v, dict):
            out = {}
            for k, f in t.fields:
                if k in v:
                    out[k] = go(v[k], f.type, f"{path}.{k}")
                elif not f.optional:
                    raise SpecializeProblem(f"{path}.{k} is required and absent")
            if t.rest is not None:
                declared = {k for k, _ in t.fields}
                out.update((k, go(x, t.rest, f"{path}.{k}")) for k, x in v.items() if k not in declared)
            return out
        if t == DYN:
            return v
        return fail(path, t, v)

    return go(v, t, path)
