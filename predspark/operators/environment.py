"""Environments and programs: the API of the expression language."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predspark.errors import CheckProblem, Problem, SpecializeProblem
from predspark.functions import patterns, signatures
from predspark.functions.hosts import Host
from predspark.plans import bounds, parser, shape, unparse
from predspark.plans.ast import Call, Fold, Lit, Node, Select, Var, walk
from predspark.plans.check import Checker, Demand, type_of
from predspark.plans.evaluate import evaluate
from predspark.plans.specialize import specialize
from predspark.sources.values import bind
from predspark.types import BOOL, BYTES, NUM, STR, Field, Record, Type, from_spark, same, to_spark

from .lower import Lowering, Value, value_of

RESULTS = {"bool": BOOL, "string": STR, "double": NUM, "bytes": BYTES}


@dataclass
class Root:
    type: Type
    column: Column | None = None
    dt: T.DataType | None = None
    fields: Mapping[str, tuple[Column, T.DataType]] | None = None

    def value(self, name: str) -> Value:
        if self.fields is not None:
            return Value(self.type, T.StructType(), members={k: value_of(c, self.type.get(k).type, dt) for k, (c, dt) in self.fields.items()})
        return value_of(F.col(name) if self.column is None else self.column, self.type, self.dt or to_spark(self.type))


@dataclass
class Environment:
    """The names that expressions may read, with their types, and the caller's functions.  Each compile() is on its
    own, so one environment serves many programs."""

    roots: dict[str, Root] = field(default_factory=dict)
    hosts: dict[str, Host] = field(default_factory=dict)
    closed: dict[tuple[str, ...], tuple[str, ...]] = field(default_factory=dict)
    limits: bounds.Limits = field(default_factory=bounds.Limits)

    @classmethod
    def from_df(cls, df: DataFrame, root: str | None = None, required: Iterable[str] | None = None, **options) -> Environment:
        """The columns of df as fields of one root, or each as a root of its own.  Nullable columns and struct fields
        are optional unless required names their dotted path; None makes all of them required, so that a null is an
        error of the rows that have it."""
        env = cls(**options)
        every = frozenset(required) if required is not None else frozenset(_paths(df.schema, ""))
        row = from_spark(df.schema, root or "row", every)
        columns = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        if root is not None:
            env.roots[root] = Root(row, fields=columns)
        else:
            for name, f in row.fields:
                env.roots[name] = Root(f.type, *columns[name])
        return env

    def declare(self, name: str, type: Type, column: Column | None = None, dt: T.DataType | None = None) -> Environment:
        """Add a root.  Its values are in column (default: the column of that name) in the form dt (default: the
        declared form of the type)."""
        self.roots[name] = Root(type, column, dt)
        return self

    def declare_facts(self, name: str, **facts: tuple[Type | Field, Column]) -> Environment:
        """Add a record whose fields are computed: name=(type, column), an optional one as Field(type, True).  A plan
        computes what its program reads and nothing else; Spark may compute a column any number of times, so it has to
        be deterministic.  NULL is an absent optional field, else an error."""
        own = {k: (t if isinstance(t, Field) else Field(t), c) for k, (t, c) in facts.items()}
        self.roots[name] = Root(Record(tuple((k, f) for k, (f, _) in own.items()), None, name), fields={k: (c, to_spark(f.type)) for k, (f, c) in own.items()})
        return self

    def declare_closed(self, path: str, values: Iterable[str]) -> Environment:
        """Declare that a string at a dotted path is one of at most 64 values; programs that compare it with another
        literal do not compile.  Meaning is unchanged; such tests become IN, which scans push down."""
        values = tuple(values)
        if not 0 < len(set(values)) == len(values) <= 64:
            raise ValueError("a closed set has 1 to 64 different values")
        self.closed[tuple(path.split("."))] = values
        return self

    def register(self, name: str, host: Host) -> Environment:
        if name in signatures.reserved():
            raise ValueError(f"`{name}` is a name of the language")
        self.hosts[name] = host
        return self

    def parse(self, source: str) -> Node:
        problem = bounds.check_source(source, self.limits)
        if problem:
            raise CheckProblem(source, [problem])
        return parser.parse(source)

    def compile(self, source: str, returning: str | None = "bool", known: Mapping[str, Any] | None = None) -> Program:
        """Check an expression.  returning: bool, string, double or bytes, or None for any type.  known: values of
        roots that are fixed; they are computed away, and prove what they have present."""
        tree = self.parse(source)
        if (cost := bounds.cost(tree)) > self.limits.max_cost:
            raise CheckProblem(source, [Problem(f"the expression may cost {cost} steps; {self.limits.max_cost} are allowed", 0, len(source))])
        values = {}
        for name, v in (known or {}).items():
            if name not in self.roots:
                raise SpecializeProblem(f"{name} is not declared; there are {', '.join(self.roots)}")
            values[name] = bind(v, self.roots[name].type, name, self.limits)
        demand = self._check(source, tree, values, returning)
        if not values:
            return Program(self, source, tree, tree, demand)
        plan = specialize(tree, values, self.limits.max_unroll, unroll=False)
        residual = specialize(tree, values, self.limits.max_unroll, unroll=True)
        if (cost := bounds.cost(residual)) > self.limits.max_cost:
            raise CheckProblem(source, [Problem(f"the specialized expression may cost {cost} steps; {self.limits.max_cost} are allowed", 0, len(source))])
        try:
            demand = self._check(source, residual, {}, returning)
            self._check(source, plan, {}, returning)
        except CheckProblem as problem:
            raise SpecializeProblem(f"the residual does not check: {problem}") from problem
        return Program(self, unparse.with_legend(residual), plan, residual, demand)

    def _check(self, source: str, tree: Node, known: Mapping[str, Any], returning: str | None) -> Demand:
        hosts = {k: (h.params, h.result, h.member) for k, h in self.hosts.items()}
        checker = Checker({k: r.type for k, r in self.roots.items()}, hosts, dict(known))
        t = checker.check(tree)
        problems = checker.problems
        if not problems and returning is not None and not same(t, RESULTS[returning]):
            problems.append(Problem(f"the result is {t}, not {returning}", tree.start, tree.end))
        for n in walk(tree):
            if isinstance(n, Call) and n.name == "matches" and isinstance(n.args[-1], Lit) and not problems:
                try:
                    patterns.as_java(n.args[-1].value)
                except patterns.Unsupported as why:
                    problems.append(Problem(str(why), n.args[-1].start, n.args[-1].end))
            if self.closed and isinstance(n, Call) and n.name in ("==", "!=") and not problems:
                for a, b in (n.args, n.args[::-1]):
                    values = self.closed.get(shape.path_of(a) or ())
                    if values and isinstance(b, Lit) and b.value not in values:
                        problems.append(Problem(f"{b.value!r} is not in the closed set", b.start, b.end, values))
        if problems:
            raise CheckProblem(source, sorted(problems, key=lambda p: p.start))
        return checker.demand


def _paths(s: T.StructType, prefix: str) -> Iterable[str]:
    for f in s.fields:
        yield f"{prefix}{f.name}"
        inner = f.dataType
        while isinstance(inner, (T.ArrayType, T.MapType)):
            inner = inner.elementType if isinstance(inner, T.ArrayType) else inner.valueType
        if isinstance(inner, T.StructType):
            yield from _paths(inner, f"{prefix}{f.name}.")


@dataclass(frozen=True)
class Program:
    """A checked expression."""

    env: Environment
    source: str
    plan: Node  # what becomes a Column
    tree: Node  # what source() spells and Python evaluates
    demand: Demand
    built: dict[bool, Value] = field(default_factory=dict, compare=False, repr=False)

    @property
    def type(self) -> Type:
        return self.tree.type

    @property
    def result_kind(self) -> str:
        return next(k for k, t in RESULTS.items() if same(t, self.type))

    def conjuncts(self) -> list[shape.Conjunct]:
        return shape.conjuncts(self.tree)

    def with_hosts(self, **hosts: Any) -> Program:
        """Bind declared functions that had no implementation: name=callable on values, or a Host."""
        own = {k: h if isinstance(h, Host) else replace(self.env.hosts[k], python=h) for k, h in hosts.items()}
        return replace(self, env=replace(self.env, hosts={**self.env.hosts, **own}), built={})

    def value(self, accept: bool = False) -> Value:
        """The lowered expression, made once: large known lists are many literals."""
        if accept not in self.built:
            roots = {k: r.value(k) for k, r in self.env.roots.items() if k in self.demand.roots()}
            self.built[accept] = Lowering(roots, self.env.hosts).lower(self.plan, {}, accept)
        return self.built[accept]

    def column(self, accept: bool = False) -> Column:
        """The value; NULL is an error.  A number is a bigint, decimal or double, or a struct of both where rows differ."""
        return self.value(accept).column

    def double(self) -> Column:
        """A number as the nearest double."""
        return self.value().num.double()

    def tag(self, values: Sequence[str]) -> Column:
        """The place of a string result in values, from 0; -1 for another string, NULL for an error."""
        if self.result_kind != "string" or not 0 < len(set(values)) == len(values):
            raise ValueError("a tag is the place of a string among different values")
        c = self.column()
        return F.when(c.isNotNull(), F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int") - 1)

    def filter(self, df: DataFrame) -> DataFrame:
        """The rows that the program admits: those for which it is true.  An error admits nothing."""
        return df.where(self.column(accept=True))

    def verdict(self) -> Column:
        """'true', 'false' or 'error'."""
        c = self.column()
        return F.when(c, "true").when(~c, "false").otherwise("error")

    def element_fields(self, *path: str) -> set[str]:
        """The fields that the program reads of the elements of a list, whose path ends in `path`; all, if an element
        is used as a whole."""
        kind, out = None, set()
        counted = {id(n.args[0]) for n in walk(self.plan) if isinstance(n, Call) and n.name == "size"}
        for fold in (n for n in walk(self.plan) if isinstance(n, Fold) and (shape.path_of(n.over) or ())[-len(path) :] == path):
            kind = fold.over.type.of
            body = [x for x in (fold.keep, fold.value) if x is not None]
            named = [n for x in body for n in walk(x) if isinstance(n, Select) and isinstance(n.of, Var) and n.of.name == fold.var]
            uses = sum(isinstance(n, Var) and n.name == fold.var for x in body for n in walk(x))
            if uses != len(named) or fold.kind == "filter" and id(fold) not in counted:
                return {k for k, _ in kind.fields}
            out |= {n.field for n in named}
        return out or ({k for k, _ in kind.fields[:1]} if isinstance(kind, Record) else set())

    def read(self, df: DataFrame) -> DataFrame:
        """df with the columns that the program reads."""
        names = {str(p[1]) if r.fields is not None and len(p) > 1 else p[0] for p in self.demand.paths for r in [self.env.roots[p[0]]]}
        return df.select(*[c for c in df.columns if c in names])

    def evaluate(self, **values: Any) -> Any:
        """The value for one set of values, in Python."""
        hosts = {k: h.python for k, h in self.env.hosts.items() if h.python}
        return evaluate(self.tree, {k: bind(v, self.env.roots[k].type, k, self.env.limits) for k, v in values.items()}, hosts)


def decide_all(df: DataFrame, programs: Mapping[str, Program], verdicts: bool = False) -> DataFrame:
    """df with a column for each program, in one pass over the rows."""
    return df.select("*", *[(p.verdict() if verdicts else p.column()).alias(k) for k, p in programs.items()])


def reverse_index(programs: Mapping[str, Program]) -> dict[tuple, list[str]]:
    """The programs that read each path."""
    out: dict[tuple, list[str]] = {}
    for k, p in programs.items():
        for path in p.demand.pruned():
            out.setdefault(path, []).append(k)
    return out


__all__ = ["Environment", "Host", "Program", "Record", "Root", "decide_all", "reverse_index", "type_of"]
