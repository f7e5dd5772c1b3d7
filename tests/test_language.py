"""Syntax, types, presence, demand, shape: what is decided before any job."""

import pytest

from predspark.errors import CheckProblem, ExpressionError, SpecializeProblem, SyntaxProblem
from predspark.functions.hosts import Host
from predspark.operators.environment import Environment, reverse_index
from predspark.plans import parser, unparse
from predspark.types import BOOL, BYTES, DURATION, DYN, NUM, STR, Field, ListOf, MapOf, Record, Unusable, optional


@pytest.fixture
def env():
    item = Record.of("item", n=NUM, note=optional(STR))
    body = Record((("a", Field(NUM)), ("o", Field(NUM, True)), ("r", Field(Record.of("r", c=optional(NUM), d=NUM))), ("h", Field(Record((("x-t", Field(STR)),), STR, "h"))), ("items", Field(ListOf(item))), ("blob", Field(DYN))), None, "body")
    e = Environment()
    for k, t in {"body": body, "m": MapOf(STR, NUM), "u": MapOf(STR, NUM, total=True), "xs": ListOf(NUM), "ss": ListOf(STR), "d": DURATION, "b": BYTES, "f": BOOL, "t": Unusable("no instants")}.items():
        e.declare(k, t)
    return e


GOOD = [
    "body.a > 1 && f",
    "has(body.o) && body.o > 1",
    "body.o > 1 && has(body.o)",
    "!has(body.o) || body.o > 1",
    "has(body.o) ? body.o > 1 : false",
    "'k' in m && m['k'] > 1",
    "m.all(k, m[k] > 0)",
    "u['anything'] > 1",
    "body.h['x-t'] == 'a'",
    "'other' in body.h && body.h['other'] == 'a'",
    "body.?o.orValue(0) > 1",
    "m[?'k'].orValue(1) == 1",
    "body.?o.hasValue()",
    "has(body.r.c) && body.r.c > 1",
    "body.items.all(i, i.?note.orValue('') != 'x')",
    "body.items.exists(i, has(i.note) && i.note == 'x')",
    "has(body.blob.k)",
    "{'a': 1}['a'] == 1",
    "d > 30s && d < 1h30m",
    "d == duration('1m')",
    "b == b'\\x00a'",
    "xs == []",
    "1 in xs && 'a' in ss && 'k' in m",
    "size(xs) > 1 && xs.size() > 1",
    "xs.map(x, x > 1, x * 2) == [4]",
    "r'\\d' == '\\\\d' // a comment",
    "'''a\"b''' != \"\\u00e9\"",
    "0x1F == 31 && .5 < 1e3 && -9223372036854775808 < 18446744073709551615",
    "[1, 2].existsOne(x, x == 1)",
    "xs.exists(body, body > 1)",
    "body.a == null || true",
]
BAD = [
    ("body.o > 1", "may be absent"),
    ("has(body.o) || body.o > 1", "may be absent"),
    ("has(body.o) ? true : body.o > 1", "may be absent"),
    ("m['k'] > 1", "may be absent"),
    ("'j' in m && m['k'] > 1", "may be absent"),
    ("{'a': 1}['b'] == 1", "may be absent"),
    ("body.items.all(i, i.note == 'x')", "may be absent"),
    ("body.?o == 1", "optional"),
    ("xs[?0].orValue(1) == 1", "optional index"),
    ("m[ss[0]] > 1", "computed key"),
    ("body.no == 1", "no field"),
    ("nope == 1", "undeclared name"),
    ("nope(1) == 1", "undeclared function"),
    ("body.blob == 1", "narrowed"),
    ("t == t", "cannot be used"),
    ("f < true", "no form"),
    ("b + b == b", "no form"),
    ("size('x') == 1", "no form"),
    ("1 == 'a'", "no form"),
    ("[1, 'a'] == []", "one type"),
    ("f ? 1 : 'a'", "no form"),
    ("5 % 2 == 1", "remainder"),
    ("int('1') == 1", "not converted"),
    ("timestamp('x') == 1", "instants"),
    ("type(1) == type(2)", "types are not values"),
    ("dyn(1) == 1", "static type"),
    ("1u == 1", "without u"),
    ("d > 1d", "unknown unit"),
    ("m.`k` == 1", "backticks"),
    ("Msg{a: 1} == 1", "messages"),
    ("[?f] == []", "cannot be optional"),
    ("xs.all(i, x, true)", "one variable"),
    ("f &&", "expected"),
    ("'abc", "unterminated"),
    ("18446744073709551616 == 1", "out of range"),
    ("body.a", "result is double"),
    ("(" * 40 + "f" + ")" * 40, "nests deeper"),
    ("f" + " || f" * 2000, "longer"),
    ("xs.all(a, xs.all(b, xs.all(c, a + b > c)))", "may cost"),
]


@pytest.mark.parametrize("text", GOOD)
def test_accepted(env, text):
    env.compile(text)


@pytest.mark.parametrize("text,why", BAD)
def test_refused(env, text, why):
    with pytest.raises(ExpressionError) as e:
        env.compile(text)
    assert why in str(e.value)


def test_problems_point_at_the_text(env):
    with pytest.raises(CheckProblem) as e:
        env.compile("f && body.itmes.exists(i, true) && nope")
    assert str(e.value).splitlines()[1].index("^") == 5 and "items" in e.value.first.available and len(e.value.all) == 2
    assert isinstance(e.value, ExpressionError) and not isinstance(e.value, SyntaxProblem)


@pytest.mark.parametrize("text", [t for t in GOOD if "//" not in t])
def test_unparsed_text_parses_to_the_same(text):
    once = unparse.unparse(parser.parse(text))
    assert unparse.unparse(parser.parse(once)) == once


def test_demand_and_shape(env):
    p = env.compile("body.a > 1 && 'k' in m && m['k'] > 2 && d > 40s && xs.exists(x, x > body.r.d)")
    assert p.demand.pruned() == [("body", "a"), ("body", "r", "d"), ("d",), ("m", "k"), ("xs",)]
    assert p.demand.roots() == ["body", "d", "m", "xs"] and p.demand.keyed("m") == [("m", "k")] and ("xs",) in p.demand.whole
    shown = [(c.path, c.operator, c.literal) for c in p.conjuncts()]
    assert shown[0] == (("body", "a"), ">", 1) and shown[3] == (("d",), ">", "40s") and shown[4] == (None, None, None)
    assert reverse_index({"p": p, "q": env.compile("body.a == 1")})[("body", "a")] == ["p", "q"]


def test_specialized_text(env):
    env.declare("policy", Record.of("policy", roots=ListOf(STR), limit=NUM, on=BOOL))
    known = {"policy": {"roots": ["/etc", "/proc"], "limit": 7, "on": True}}
    p = env.compile("policy.on && ss.exists(s, s == policy.roots[0]) && policy.roots.exists(r, ss[0] == r || ss[0].startsWith(r + '/'))", known=known)
    assert "policy" not in p.source and '"/etc/"' in p.source and p.demand.roots() == ["ss"]
    assert env.compile("!policy.on && f", known=known).source == "false"
    assert "$k0" in env.compile("policy.roots.exists_one(r, r == ss[0])", known=known).source
    assert env.compile("1 / 0 > policy.limit || f", known=known).demand.roots() == []
    assert env.compile("[1][policy.limit] == 1 || f", known=known).demand.roots() == ["f"]
    with pytest.raises(SpecializeProblem):
        env.compile("policy.on", known={"policy": {"roots": [], "limit": "x", "on": True}})


def test_known_values_prove_presence(env):
    env.declare("conf", MapOf(STR, NUM))
    assert env.compile("conf['a'] < xs[0]", known={"conf": {"a": 1}}).demand.roots() == ["xs"]
    with pytest.raises(CheckProblem):
        env.compile("conf['b'] < xs[0]", known={"conf": {"a": 1}})


def test_hosts_and_closed_sets(env):
    env.register("twice", Host((NUM,), NUM, python=lambda x: 2 * x))
    assert env.compile("twice(body.a) == 4").evaluate(body={"a": 2, "r": {"d": 1}, "h": {"x-t": ""}, "items": [], "blob": 1})
    with pytest.raises(ValueError):
        env.register("size", Host((NUM,), NUM))
    with pytest.raises(CheckProblem):
        env.compile("twice('a') == 1")
    env.declare("mode", STR).declare_closed("mode", ["read", "write"])
    env.compile("mode == 'read'")
    with pytest.raises(CheckProblem):
        env.compile("mode == 'exec'")
