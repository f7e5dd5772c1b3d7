"""Trees to Columns.

NULL stands for an evaluation error: AND, OR, exists and forall then absorb errors as the language wants.  Where Spark
would turn NULL, NaN or a range error into something else, a guard keeps it an error; nothing that is made here can
make a job fail."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predspark.functions import durations, patterns
from predspark.functions.hosts import Host
from predspark.functions.numbers import WIDE, Number, common, compute, exactly, negate, relation
from predspark.plans.ast import Call, Const, Fold, Index, ListOf, Lit, MapOf, Node, Select, Span, Var
from predspark.plans.evaluate import sorted_keys
from predspark.plans.specialize import put
from predspark.types import DURATION, EITHER, INTERVAL, NANOS, NULL, NUM, STR, Record, Type, to_spark
from predspark.types import ListOf as ListType
from predspark.types import MapOf as MapType

from . import matchers

#: Elements of a literal range up to which a fold is written out, which stays inside generated code.
WRITE_OUT = 16
#: The field of a struct that holds keys which its record does not declare.
REST = "_rest"


@dataclass
class Value:
    type: Type
    dt: T.DataType
    col: Column | None = None
    num: Number | None = None
    members: Mapping[str, Value] | None = None  # of a root whose fields are columns of the row

    @property
    def column(self) -> Column:
        if self.num is not None:
            return self.num.column()
        if self.col is None:
            return F.struct(*[v.column.alias(k) for k, v in self.members.items()])
        return self.col

    def known(self) -> Column:
        return self.num.known() if self.num is not None else self.column.isNotNull()


def value_of(c: Column, t: Type, dt: T.DataType) -> Value:
    return Value(t, dt, num=Number.of(c, dt)) if t == NUM else Value(t, dt, c)


def number(n: Number) -> Value:
    return Value(NUM, n.type, num=n)


def both(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


class Lowering:
    def __init__(self, roots: Mapping[str, Value], hosts: Mapping[str, Host]) -> None:
        self.roots, self.hosts = roots, hosts

    def lower(self, e: Node, local: Mapping[str, Value] | None = None, accept: bool = False) -> Value:
        """accept: the result only admits rows, so FALSE may stand for an error (cheaper, and the scan sees more)."""
        local = local or {}
        if isinstance(e, (Lit, Const)):
            return self.constant(e.value, e.type)
        if isinstance(e, Var):
            return local.get(e.name) or self.roots[e.name]
        if isinstance(e, Select):
            return self.select(e, local)
        if isinstance(e, Index):
            return self.index(e, local)
        if isinstance(e, ListOf):
            return self.array([self.lower(x, local) for x in e.items], e.type)
        if isinstance(e, MapOf):
            return self.map_literal(e, local)
        if isinstance(e, Fold):
            return self.fold(e, local, accept)
        return self.call(e, local, accept)

    # constants and collections

    def constant(self, v: Any, t: Type | None) -> Value:
        if v is None:
            return Value(NULL, T.BooleanType(), F.lit(True))
        if isinstance(v, bool):
            return Value(t, T.BooleanType(), F.lit(v))
        if isinstance(v, (int, float)):
            return number(Number.literal(v))
        if isinstance(v, str):
            return Value(t, T.StringType(), F.lit(v))
        if isinstance(v, bytes):
            return Value(t, T.BinaryType(), F.lit(bytearray(v)))
        if isinstance(v, Span):
            if v.ns % 1000 == 0:
                return Value(DURATION, INTERVAL, whole_interval(v.ns // 1000))
            return Value(DURATION, NANOS, F.lit(str(v.ns)).cast(NANOS))
        if isinstance(v, dict):
            if not v:
                return Value(t, T.MapType(T.StringType(), T.StringType()), F.create_map())
            keys = self.array([self.constant(k, None) for k in sorted_keys(v)], ListType(t.key))
            vals = self.array([self.constant(v[k if not isinstance(k, bool) else ("bool", k)], t.value) for k in sorted_keys(v)], ListType(t.value))
            return Value(t, T.MapType(keys.dt.elementType, vals.dt.elementType), F.map_from_arrays(keys.col, vals.col))
        return self.array([self.constant(x, t.of if isinstance(t, ListType) else None) for x in v], t)

    def array(self, items: list[Value], t: Type) -> Value:
        if not items:
            return Value(t, T.ArrayType(T.StringType()), F.array().cast("array<string>"))
        if all(i.num is not None for i in items):
            dt = items[0].dt
            for i in items[1:]:
                dt = common(dt, i.dt)
            cols = [i.num.column(dt) for i in items]
        else:
            dt, cols = items[0].dt, [i.column for i in items]
        sure = all(isinstance(i.num.value if i.num else None, (int, float)) for i in items)
        col = F.array(*cols)
        return Value(t, T.ArrayType(dt), col if sure else F.when(both([i.known() for i in items]), col))

    def map_literal(self, e: MapOf, local: Mapping[str, Value]) -> Value:
        last: dict[Any, tuple[Value, Value]] = {}
        for n, (k, v) in enumerate(e.entries):
            last[(type(k.value) is bool, k.value) if isinstance(k, Lit) else ("at", n)] = (self.lower(k, local), self.lower(v, local))
        if not last:
            return Value(e.type, T.MapType(T.StringType(), T.StringType()), F.create_map())
        keys, vals = self.array([k for k, _ in last.values()], ListType(e.type.key)), self.array([v for _, v in last.values()], ListType(e.type.value))
        return Value(e.type, T.MapType(keys.dt.elementType, vals.dt.elementType), F.map_from_arrays(keys.col, vals.col))

    # reads

    def field(self, of: Value, key: str, t: Type) -> Value:
        if of.members is not None:
            return of.members[key]
        if isinstance(of.dt, T.MapType):
            return value_of(F.try_element_at(of.column, F.lit(key)), t, of.dt.valueType)
        if isinstance(of.dt, T.VariantType):
            return Value(t, T.VariantType(), F.try_variant_get(of.column, f"$[{key!r}]", "variant"))
        if key in of.dt.names:
            return value_of(of.column.getField(key), t, of.dt[key].dataType)
        rest = of.dt[REST].dataType
        return value_of(F.try_element_at(of.column.getField(REST), F.lit(key)), t, rest.valueType)

    def present(self, of: Value, key: str) -> Column:
        if of.members is not None:
            return of.members[key].column.isNotNull()
        if isinstance(of.dt, T.MapType):
            return F.map_contains_key(of.column, key)
        got = self.field(of, key, STR)
        here = got.column.isNotNull()
        return F.when(of.column.isNotNull(), here)

    def select(self, e: Select, local: Mapping[str, Value]) -> Value:
        of = self.lower(e.of, local)
        if e.test:
            return Value(e.type, T.BooleanType(), self.present(of, e.field))
        return self.field(of, e.field, e.type)

    def index(self, e: Index, local: Mapping[str, Value]) -> Value:
        of = self.lower(e.of, local)
        if isinstance(of.type, Record):
            return self.field(of, e.key.value, e.type)
        key = self.lower(e.key, local)
        if isinstance(of.type, ListType):
            at = key.num.index()
            at = F.when((at >= 0) & (at < (1 << 31) - 1), at.cast("int"))
            return value_of(F.get(of.column, at), e.type, of.dt.elementType)
        return value_of(F.try_element_at(of.column, self.key(key, of.dt.keyType)), e.type, of.dt.valueType)

    def key(self, key: Value, dt: T.DataType) -> Column:
        if key.num is None:
            return key.column
        return key.num.double() if isinstance(dt, T.DoubleType) else key.num.index().cast(dt)

    # equality

    def equal(self, a: Value, b: Value) -> Column:
        if a.type == NULL or b.type == NULL:
            same = a.type == NULL and b.type == NULL
            other = b if a.type == NULL else a
            return F.lit(True) if same else F.when(other.known(), F.lit(False))
        if a.num is not None:
            return relation("==", a.num, b.num)
        if isinstance(a.type, ListType):
            x, y = a.dt.elementType, b.dt.elementType
            pairs = F.zip_with(a.column, b.column, lambda p, q: self.equal(value_of(p, a.type.of, x), value_of(q, b.type.of, y)))
            n = F.size(a.column) == F.size(b.column)
            return F.when(~n, F.lit(False)).when(n, F.forall(pairs, lambda p: p))
        if isinstance(a.type, MapType):
            n = F.size(a.column) == F.size(b.column)

            def entry(k: Column) -> Column:
                x = value_of(F.try_element_at(a.column, k), a.type.value, a.dt.valueType)
                k = k if a.dt.keyType == b.dt.keyType else k.cast(b.dt.keyType)
                y = value_of(F.try_element_at(b.column, k), b.type.value, b.dt.valueType)
                return F.when(F.map_contains_key(b.column, k), self.equal(x, y)).otherwise(F.lit(False))

            return F.when(~n, F.lit(False)).when(n, F.forall(F.map_keys(a.column), entry))
        if isinstance(a.type, Record):
            out = []
            for k, f in a.type.fields:
                x, y = self.field(a, k, f.type), self.field(b, k, f.type)
                same = self.equal(x, y)
                out.append(F.when(x.known() & y.known(), same).when(x.known() | y.known(), F.lit(False)).otherwise(F.lit(True)) if f.optional else same)
            return both(out) if out else F.lit(True)
        if a.type == DURATION:
            x, y = self.spans(a, b)
            return x == y
        return a.column == b.column

    def spans(self, a: Value, b: Value) -> tuple[Column, Column]:
        if a.dt == b.dt:
            return a.column, b.column
        return nanos(a), nanos(b)

    # folds

    def fold(self, e: Fold, local: Mapping[str, Value], accept: bool) -> Value:
        items = None
        if isinstance(e.over, Const):
            items = sorted_keys(e.over.value) if isinstance(e.over.value, dict) else list(e.over.value)
        elif isinstance(e.over, ListOf) and all(isinstance(x, Lit) for x in e.over.items):
            items = [x.value for x in e.over.items]
        boolean = T.BooleanType()
        if items is not None and e.kind in ("exists", "all"):
            if found := matchers.recognise(e, items):
                kind, x, suffix = found
                x = self.lower(x, local).column
                if kind == "equal":
                    return Value(e.type, boolean, matchers.is_one_of(x, items))
                test = matchers.starts_with_any(x, [i + suffix for i in items])
                return Value(e.type, boolean, test | matchers.is_one_of(x, items) if kind == "either" else test)
            if len(items) <= WRITE_OUT and isinstance(e.over.type, ListType):
                if not items:
                    return Value(e.type, boolean, F.lit(e.kind == "all"))
                each = [self.lower(put(e.keep, e.var, Const(i, type=e.over.type.of)), local, accept).column for i in items]
                out = each[0]
                for c in each[1:]:
                    out = out | c if e.kind == "exists" else out & c
                return Value(e.type, boolean, out)
        over = self.lower(e.over, local)
        if isinstance(over.type, MapType):
            element, dt = over.type.key, over.dt.keyType
            keys = F.map_keys(over.column)
            xs = F.array_sort(keys) if e.kind in ("filter", "map") else keys
        else:
            element, dt, xs = over.type.of, over.dt.elementType, over.column
        inner = lambda x: {**local, e.var: value_of(x, element, dt)}
        keep = (lambda x: self.lower(e.keep, inner(x)).column) if e.keep is not None else None
        if e.kind in ("exists", "all") and isinstance(over.type, ListType):
            parts = parts_of(e.keep, "||" if e.kind == "exists" else "&&")
            short = [self.by_extremes(e, p, over, accept) for p in parts]
            if any(c is not None for c in short):
                each = [c if c is not None else self.fold(Fold(e.kind, e.over, e.var, p, type=e.type), local, accept).column for c, p in zip(short, parts, strict=True)]
                return Value(e.type, boolean, reduce(or_ if e.kind == "exists" else and_, each))
        if e.kind == "exists":
            return Value(e.type, boolean, F.exists(xs, lambda x: self.lower(e.keep, inner(x), accept).column))
        if e.kind == "all":
            return Value(e.type, boolean, F.forall(xs, keep))
        if keep is not None:
            sure = ~F.exists(xs, lambda x: keep(x).isNull())
            xs = F.when(sure, F.filter(xs, keep))
        if e.kind == "exists_one":
            return Value(e.type, boolean, F.size(xs) == 1)
        if e.value is None:
            return Value(e.type, T.ArrayType(dt), xs)
        seen: list[Value] = []

        def made(x: Column) -> Column:
            v = self.lower(e.value, inner(x))
            seen.append(v)
            return v.column

        out = F.transform(xs, made)
        return Value(e.type, T.ArrayType(seen[0].dt), F.when(~F.exists(out, lambda x: x.isNull()), out))

    def by_extremes(self, e: Fold, part: Node, over: Value, accept: bool) -> Column | None:
        """One comparison of the elements, or of a field of theirs, with a number: the least or the greatest element
        decides, inside generated code.  What is NULL or NaN is an error that a decided fold absorbs."""
        if not (isinstance(part, Call) and part.name in ("<", "<=", ">", ">=") and isinstance(part.args[1], Lit) and isinstance(part.args[1].value, (int, float))):
            return None
        x, dt, xs = part.args[0], over.dt.elementType, over.column
        if isinstance(x, Select) and not x.test and not x.maybe and isinstance(dt, T.StructType) and x.field in dt.names:
            x, xs, dt = x.of, xs.getField(x.field), dt[x.field].dataType
        if not (isinstance(x, Var) and x.name == e.var and isinstance(dt, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))):
            return None
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            nan = F.lit(math.nan).cast(dt)
            most = F.array_max(xs)
            most = F.when(F.isnan(most), F.array_max(F.array_remove(xs, nan))).otherwise(most)
            clean = F.coalesce(~F.arrays_overlap(xs, F.array(nan)), F.lit(False))  # NULL if there is a NULL
        else:
            most, clean = F.array_max(xs), (F.size(xs) == 0) | F.get(F.sort_array(xs), F.lit(0)).isNotNull()
        extreme = most if (e.kind == "exists") == (part.name in (">", ">=")) else F.array_min(xs)
        decided = relation(part.name, Number.of(extreme, dt), Number.literal(part.args[1].value))
        if e.kind == "exists":
            return F.coalesce(decided, F.lit(False)) if accept else F.when(decided, F.lit(True)).when(clean, F.lit(False))
        return F.when(~decided, F.lit(False)).when(xs.isNotNull() & clean, F.lit(True))

    # calls

    def call(self, e: Call, local: Mapping[str, Value], accept: bool) -> Value:
        name, boolean = e.name, T.BooleanType()
        truth = lambda c: Value(e.type, boolean, c)
        if name in ("&&", "||"):
            a, b = (self.lower(x, local, accept).column for x in e.args)
            return truth(a & b if name == "&&" else a | b)
        if name == "!":
            return truth(~self.lower(e.args[0], local).column)
        if name == "?:":
            return self.conditional(e, local)
        if name == "in":
            return truth(self.contains(e, local))
        if name in self.hosts:
            host = self.hosts[name]
            args = [self.lower(a, local) for a in e.args]
            if host.columns is None:
                return value_of(host.in_python([a.num.column(EITHER) if a.num is not None else a.column for a in args]), host.result, host.result_type())
            out = host.columns(*[a.column if a.num is None or a.num.type != EITHER else a.num.double() for a in args])
            return value_of(exactly(out), NUM, EITHER) if host.result == NUM else value_of(out, host.result, to_spark(host.result))
        args = [self.lower(a, local) for a in e.args]
        a, b = (*args, None, None)[:2]
        if name in ("==", "!="):
            if a.num is not None and b.num is not None:
                return truth(relation(name, a.num, b.num, accept))
            same = self.equal(a, b)
            return truth(same if name == "==" else ~same if a.type in (NULL, DURATION) or isinstance(a.type, (ListType, MapType, Record)) or b.type == NULL else a.column != b.column)
        if name in ("<", "<=", ">", ">="):
            if a.num is not None:
                return truth(relation(name, a.num, b.num, accept))
            x, y = self.spans(a, b) if a.type == DURATION else (a.column, b.column)
            return truth({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[name])
        if name == "-_":
            return number(negate(a.num))
        if name in ("+", "-", "*", "/"):
            if a.num is not None:
                return number(compute(name, a.num, b.num))
            if a.type == DURATION:
                x, y = nanos(a), nanos(b)
                r = (x + y if name == "+" else x - y).cast(WIDE)
                most = F.lit(str(durations.MOST_SECONDS * 10**9)).cast(WIDE)
                return Value(DURATION, NANOS, F.when(F.abs(r) <= most, r.cast(NANOS)))
            if isinstance(a.type, ListType) and a.type.of == NUM and a.dt != b.dt:
                dt = common(a.dt.elementType, b.dt.elementType)
                return Value(e.type, T.ArrayType(dt), F.concat(widened(a, dt), widened(b, dt)))
            return Value(e.type, a.dt, F.concat(a.column, b.column))
        if name == "size":
            return number(Number(F.size(a.column).cast("bigint"), None, 32))
        if name in ("getSeconds", "getMilliseconds"):
            ns = nanos(a)
            unit = F.lit(10**9 if name == "getSeconds" else 10**6).cast(NANOS)
            return number(Number(F.try_divide((ns - F.try_mod(ns, unit)).cast("decimal(21,0)"), unit).cast("bigint"), None, 63))
        if name == "duration":
            return Value(DURATION, NANOS, parsed_duration(a.column))
        if name == "matches":
            return truth(self.matches(a.column, e.args[1], b.column))
        fn = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}[name]
        return truth(fn(a.column, b.column))

    def conditional(self, e: Call, local: Mapping[str, Value]) -> Value:
        c = self.lower(e.args[0], local).column
        a, b = self.lower(e.args[1], local), self.lower(e.args[2], local)
        pick = lambda x, y: F.when(c, x).when(~c, y)
        if a.num is not None:
            dt = common(a.dt, b.dt)
            return value_of(pick(a.num.column(dt), b.num.column(dt)), NUM, dt)
        if e.type == DURATION and a.dt != b.dt:
            return Value(DURATION, NANOS, pick(nanos(a), nanos(b)))
        return Value(e.type, a.dt, pick(a.column, b.column))

    def contains(self, e: Call, local: Mapping[str, Value]) -> Column:
        item, where = e.args
        t = where.type
        if isinstance(t, Record):
            return self.present(self.lower(where, local), item.value)
        x = self.lower(item, local)
        values = where.value if isinstance(where, Const) and isinstance(where.value, (list, tuple)) else [i.value for i in where.items] if isinstance(where, ListOf) and all(isinstance(i, Lit) for i in where.items) else None
        if values is not None and (t.of == STR or not values):
            return matchers.is_one_of(x.column, list(values))
        if values is not None and x.num is not None and all(isinstance(v, (int, float)) and abs(v) <= 1 << 53 for v in values if v == v):
            values = [v for v in values if v == v]
            parts = []
            if x.num.i is not None:
                whole = [int(v) for v in values if v == int(v)]
                parts.append(x.num.i.isin(*whole) if whole else F.when(x.num.i.isNotNull(), F.lit(False)))
            if x.num.d is not None:
                parts.append(x.num.d.isin(*[float(v) for v in values]) if values else F.when(x.num.d.isNotNull(), F.lit(False)))
            return parts[0] if len(parts) == 1 else F.coalesce(*parts)
        of = self.lower(where, local)
        if isinstance(t, MapType):
            key = self.key(x, of.dt.keyType)
            if x.num is None:
                return F.map_contains_key(of.column, key)
            return F.when(x.known() & of.known(), F.coalesce(F.map_contains_key(of.column, F.when(x.known(), key)), F.lit(False)))
        element = of.dt.elementType
        return F.when(x.known(), F.exists(of.column, lambda y: self.equal(value_of(y, t.of, element), x)))

    def matches(self, text: Column, pattern: Node, dynamic: Column) -> Column:
        if isinstance(pattern, Lit):
            java = patterns.as_java(pattern.value)
            return F.lit(None).cast("boolean") if java is None else F.rlike(text, F.lit(java))
        @F.pandas_udf("boolean")
        def found(texts: pd.Series, own: pd.Series) -> pd.Series:
            def one(t, p):
                try:
                    return None if t is None or p is None else patterns.found(p, t)
                except patterns.Unsupported:
                    return None

            return pd.Series([one(t, p) for t, p in zip(texts, own, strict=True)], dtype=object)

        return found(text, dynamic)


def parts_of(e: Node, name: str) -> list[Node]:
    """The sides of nested && or ||."""
    return [p for a in e.args for p in parts_of(a, name)] if isinstance(e, Call) and e.name == name else [e]


def widened(v: Value, dt: T.DataType) -> Column:
    """A list of numbers with elements of a wider type."""
    own = v.dt.elementType
    return v.column if own == dt else F.transform(v.column, lambda x: Number.of(x, own).column(dt))


def whole_interval(us: int) -> Column:
    sign, us = ("-" if us < 0 else ""), abs(us)
    days, us = divmod(us, 86_400_000_000)
    seconds, us = divmod(us, 1_000_000)
    return F.expr(f"INTERVAL '{sign}{days} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{us:06d}' DAY TO SECOND")


def nanos(v: Value) -> Column:
    """A duration as whole nanoseconds."""
    if v.dt == NANOS:
        return v.column
    c = v.column.cast("interval second").cast("decimal(20,6)")
    return (c.cast("decimal(38,6)") * 1_000_000_000).cast(NANOS)


def parsed_duration(text: Column) -> Column:
    """The duration at the start of a text, in nanoseconds; NULL if there is none or it is out of range."""
    part = "([0-9]+\\.?[0-9]*|\\.[0-9]+)(ns|us|µs|ms|h|m|s)"
    body = F.regexp_extract(text, f"^[-+]?((?:{part.replace('(', '(?:')})+)", 1)
    sizes = F.create_map(*[F.lit(x) for u, n in durations.UNITS.items() for x in (u, n)])
    each = F.zip_with(F.regexp_extract_all(body, F.lit(part), 1), F.regexp_extract_all(body, F.lit(part), 2), lambda n, u: n.try_cast("decimal(24,9)") * F.try_element_at(sizes, u).cast("decimal(14,0)"))
    total = F.floor(F.aggregate(each, F.lit(0).cast("decimal(38,9)"), lambda a, x: F.try_add(a, x).cast("decimal(38,9)"))).cast(WIDE)
    total = F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)
    most = F.lit(str(durations.MOST_SECONDS * 10**9)).cast(WIDE)
    return F.when(body != "", F.when(F.abs(total) <= most, total.cast(NANOS))).when(F.rlike(text, F.lit("^[-+]?0")), F.lit(0).cast(NANOS))


__all__ = ["Lowering", "Value", "value_of"]
