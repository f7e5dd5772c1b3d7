"""Columns against the Python evaluator, and against DuckDB."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from predspark.errors import EvaluationError
from predspark.functions.hosts import Host
from predspark.operators.environment import Environment
from predspark.plans.bounds import Limits
from predspark.sources import json_text
from predspark.streaming.documents import Document, decide_documents, verdict
from predspark.types import BOOL, DURATION, NUM, STR, Field, ListOf, MapOf, Record

ROW = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("f", T.BooleanType()),
        T.StructField("xs", T.ArrayType(T.DoubleType())),
        T.StructField("ns", T.ArrayType(T.LongType())),
        T.StructField("ss", T.ArrayType(T.StringType())),
        T.StructField("m", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("r", T.StructType([T.StructField("a", T.DoubleType()), T.StructField("o", T.DoubleType()), T.StructField("t", T.StringType())])),
    ]
)
ROOTS = {"n": NUM, "x": NUM, "s": STR, "f": BOOL, "xs": ListOf(NUM), "ns": ListOf(NUM), "ss": ListOf(STR), "m": MapOf(STR, NUM), "r": Record((("a", Field(NUM)), ("o", Field(NUM, True)), ("t", Field(STR))), None, "r")}
NUMBERS = [0.0, -0.0, 1.0, -2.5, 3.0, 1.5, math.nan, math.inf, -math.inf, 2.0**53, 2.0**63, -(2.0**63), 2.0**64, 1e300]
INTS = [0, 1, -1, 2, 3, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]


def environment():
    env = Environment(limits=Limits(max_cost=10**9, max_depth=200))
    for f in ROW.fields:
        env.declare(f.name, ROOTS[f.name], F.col(f.name), f.dataType)
    return env


def values(r):
    strings = ["", "a", "ab", "b"]
    row = {"n": r.choice(INTS), "x": r.choice(NUMBERS), "s": r.choice(strings), "f": r.random() < 0.5}
    row |= {"xs": [r.choice(NUMBERS) for _ in range(r.randint(0, 3))], "ns": [r.choice(INTS) for _ in range(r.randint(0, 3))], "ss": [r.choice(strings) for _ in range(r.randint(0, 3))]}
    row["m"] = {k: r.choice(NUMBERS) for k in "abc" if r.random() < 0.6}
    row["r"] = {"a": r.choice(NUMBERS), "t": r.choice(strings)} | ({"o": r.choice(NUMBERS)} if r.random() < 0.5 else {})
    return row


def program(r, want, depth, local):
    """A random program of a type; local: variables in scope by type."""
    go = lambda t, more=(): program(r, t, depth - 1, local | dict(more))
    own = [k for k, t in local.items() if t == want]
    if want == "num":
        leaf = ["n", "x", "r.a", "2", "1.5", "-1", "9007199254740993", *own, "(has(r.o) ? r.o : 0)", "r.?o.orValue(n)", "('a' in m ? m['a'] : 1)"]
        if depth <= 0 or r.random() < 0.3:
            return r.choice(leaf)
        return r.choice([lambda: f"({go('num')} {r.choice('+-*/')} {go('num')})", lambda: f"(-({go('num')}))", lambda: f"({go('bool')} ? {go('num')} : {go('num')})", lambda: f"size({go('list')})", lambda: f"{r.choice(['xs', 'ns'])}[{go('num')}]", lambda: f"{go('list')}[0]"])()
    if want == "str":
        if depth <= 0 or r.random() < 0.4:
            return r.choice(["s", "r.t", "'a'", "'ab'", "''", *own])
        return r.choice([lambda: f"({go('str')} + {go('str')})", lambda: f"({go('bool')} ? {go('str')} : {go('str')})", lambda: f"ss[{go('num')}]"])()
    if want == "list":
        if depth <= 0 or r.random() < 0.4:
            return r.choice(["xs", "ns", "[1, 2.5]", "[n, 3]"])
        v = f"v{depth}"
        return r.choice([lambda: f"({go('list')} + {go('list')})", lambda: f"{go('list')}.map({v}, {go('num', [(v, 'num')])})", lambda: f"{go('list')}.filter({v}, {go('bool', [(v, 'num')])})", lambda: f"[{go('num')}, {go('num')}]"])()
    if depth <= 0:
        return r.choice(["f", "true", "s == 'a'", "n > 1", "x < 2", "has(r.o)", "'b' in m"])
    v = f"v{depth}"
    return r.choice(
        [
            lambda: f"({go('bool')} {r.choice(['&&', '||'])} {go('bool')})",
            lambda: f"!({go('bool')})",
            lambda: f"({go('num')} {r.choice(['==', '!=', '<', '<=', '>', '>='])} {go('num')})",
            lambda: f"({go('str')} {r.choice(['==', '!=', '<', '>='])} {go('str')})",
            lambda: f"{go('str')}.{r.choice(['startsWith', 'endsWith', 'contains'])}({go('str')})",
            lambda: f"({go('num')} in {go('list')})",
            lambda: f"({go('str')} in ss)",
            lambda: f"{go('list')}.{r.choice(['exists', 'all', 'exists_one'])}({v}, {go('bool', [(v, 'num')])})",
            lambda: f"ss.exists({v}, {go('bool', [(v, 'str')])})",
            lambda: f"m.all({v}, m[{v}] > {go('num')})",
            lambda: f"({go('list')} == {go('list')})",
            lambda: f"({go('bool')} ? {go('bool')} : {go('bool')})",
        ]
    )()


def rows_of(spark, data):
    return spark.createDataFrame([tuple(d[f.name] if f.name != "r" else (d["r"]["a"], d["r"].get("o"), d["r"]["t"]) for f in ROW.fields) + (i,) for i, d in enumerate(data)], T.StructType([*ROW.fields, T.StructField("id", T.IntegerType())])).coalesce(1)


def expected(p, d):
    try:
        return p.evaluate(**d)
    except EvaluationError:
        return None


@pytest.mark.parametrize("seed", range(4))
def test_columns_agree_with_python(spark, seed):
    r = random.Random(seed)
    env, data = environment(), [values(r) for _ in range(12)]
    df = rows_of(spark, data).cache()
    programs = []
    while len(programs) < 40:
        text = program(r, "bool", 3, {})
        programs.append((text, env.compile(text)))
    for s in range(0, len(programs), 10):
        part = programs[s : s + 10]
        got = df.select("id", *[p.column().alias(f"p{k}") for k, (_, p) in enumerate(part)]).orderBy("id").collect()
        admitted = [{x["id"] for x in p.filter(df).select("id").collect()} for _, p in part[:2]]
        for k, (text, p) in enumerate(part):
            want = [expected(p, d) for d in data]
            assert [g[f"p{k}"] for g in got] == want, text
            if k < 2:
                assert admitted[k] == {i for i, w in enumerate(want) if w}, text


@pytest.mark.parametrize("seed", range(3))
def test_specialized_programs_agree(seed):
    """A program with some roots known decides as the whole program does."""
    r = random.Random(100 + seed)
    env = environment()
    for _ in range(120):
        text, d = program(r, "bool", 3, {}), values(r)
        known = {k: d[k] for k in ROOTS if r.random() < 0.5}
        p = env.compile(text, known=known)
        assert expected(p, {k: v for k, v in d.items() if k not in known}) == expected(env.compile(text), d), (text, known)


def test_verdicts_durations_and_patterns(spark):
    df = spark.createDataFrame([(1, "a1\n", [1]), (2, "b", [5, 6])], "k int, s string, xs array<int>")
    env = Environment.from_df(df)
    env.declare("d", DURATION, F.expr("INTERVAL '90.5' SECOND"))
    run = lambda text: [x[0] for x in df.select(env.compile(text).verdict()).collect()]
    assert run("xs[1] == 6") == ["error", "true"]
    assert run("xs[1] == 6 && k == 2") == ["false", "true"]
    assert run("xs[1] == 6 || k == 1") == ["true", "true"]
    assert run("s.matches('[0-9]$')") == ["false", "false"] and run("s.matches('(?=a)')") == ["error", "error"]
    assert run("s.matches('^' + s)") == ["true", "true"]
    assert run("d > 1m30s && d.getSeconds() == 90 && d.getMilliseconds() == 90500 && (d + 500ms) == 91s") == ["true", "true"]
    assert run("duration(s) == 1s") == ["error", "error"] and run("d + duration('315576000000s') > 1s") == ["error", "error"]
    env.register("bad", Host((NUM,), NUM, python=lambda x: 1 / (x - 1)))
    assert run("bad(k) == 1") == ["error", "true"] and run("bad(k) == 1 || true") == ["true", "true"]


def test_known_lists_become_matchers(spark):
    df = spark.createDataFrame([("/etc",), ("/etc/x",), ("/etcx",), ("/var/7/q",), (None,)], "p string")
    env = Environment.from_df(df).declare("roots", ListOf(STR))
    many = ["/etc", "/etc/deep", *[f"/var/{i}" for i in range(300)]]
    p = env.compile("roots.exists(r, p == r || p.startsWith(r + '/'))", known={"roots": many})
    assert [x["p"] for x in p.filter(df).collect()] == ["/etc", "/etc/x", "/var/7/q"]
    plan = p.filter(df)._jdf.queryExecution().executedPlan().toString()
    assert "exists(" not in plan and "*(1) Filter" in plan


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    p = Environment.from_df(df, root="o").compile('o.o_orderstatus == "F" && o.o_totalprice > 1000')
    plan = p.read(p.filter(df))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_total" in plan and "o_custkey" not in plan


def test_json_binding(spark):
    t = Record((("a", Field(NUM)), ("s", Field(STR, True)), ("d", Field(DURATION, True)), ("xs", Field(ListOf(NUM), True)), ("r", Field(Record.of("r", b=BOOL), True))), NUM, "body")
    rows = ['{"a": 18446744073709551615}', '{"a": 1.5, "s": "x", "d": "1m", "xs": [1, 2.5], "r": {"b": true}, "more": 3}', '{"a": "1"}', '{"s": null, "a": 1}', "not json", '{"a":1,"a":2}', None]
    df = json_text.bind(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string"), "body", F.col("j"), t)
    env = Environment().declare("body", t, F.col("body"), json_text.bound_type(t))
    run = lambda text: [x[0] for x in df.orderBy("i").select(env.compile(text).verdict()).collect()]
    assert run("body.a == 18446744073709551615") == ["true", "false", "error", "false", "error", "error", "error"]
    assert run("has(body.s) && body.s == 'x'")[:4] == ["false", "true", "false", "false"]
    assert run("has(body.d) && body.d == 60s && has(body.xs) && body.xs[1] == 2.5 && has(body.r) && body.r.b && 'more' in body && body['more'] == 3")[:2] == ["false", "true"]


EVENTS = [("begin_object", None), ("key", "pad"), ("begin_array", None), ("begin_object", None), ("end_object", None), ("end_array", None), ("key", "a"), ("begin_object", None), ("key", "tier"), ("part", "go"), ("string", "ld"), ("end_object", None), ("key", "n"), ("number", "5"), ("key", "n"), ("number", "500"), ("end_object", None), ("end", None)]
DOC = Record.of("doc", a=Record.of("a", tier=STR), n=NUM, o=Field(NUM, True))


def test_documents_decide_early():
    env = Environment().declare("doc", DOC)

    def when(text):
        p = env.compile(text)
        doc = Document(DOC, {q[1:] for q in p.demand.paths})
        for i, e in enumerate(EVENTS):
            doc.push(*e)
            doc = Document(DOC, doc.wanted, doc.state())  # as it comes back from a state store
            if (v := verdict(p, "doc", doc)) is not None:
                return v, i

    assert when('doc.a.tier == "gold"') == ("true", 10)
    assert when('doc.a.tier == "gold" && doc.n < 100') == ("true", 13)
    assert when("doc.n == 500") == ("false", 13)  # the first of two equal keys counts
    assert when("has(doc.o) && doc.o > 1") == ("false", 16)
    assert when('doc.a.tier != "gold" && doc.n < 100') == ("false", 10)


def test_documents_as_a_stream(spark, tmp_path):
    env = Environment().declare("doc", DOC)
    p = env.compile('doc.a.tier == "gold" && doc.n < 100')
    rows = [(d, i, k, t) for d in (1, 2, 3) for i, (k, t) in enumerate(EVENTS) if not (d == 2 and k == "number")]
    schema = "doc_id long, seq int, kind string, text string"
    batch = decide_documents(spark.createDataFrame(rows, schema), p, "doc")
    want = [(1, "true"), (2, "error"), (3, "true")]
    assert sorted(map(tuple, batch.collect())) == want
    for n, part in enumerate((rows[:20], rows[20:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if n == 0:
            stream = decide_documents(spark.readStream.schema(schema).json(str(tmp_path / "in")), p, "doc").writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        stream.processAllAvailable()
    stream.stop()
    assert sorted(map(tuple, spark.sql("select * from decided").collect())) == want


def test_registered_queries_match_sql(spark, sf):
    import glob

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM '{f}'")
    sql = __spark_entry__.oracle_sql()
    names = [n for n in __spark_entry__.queries() if n.startswith("q")]
    assert len(names) > 40
    for n in names:
        got, want = __spark_entry__.queries()[n](spark, sf).toPandas(), con.sql(sql[n]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), n
    assert __spark_entry__.entry(spark).count() > 0
