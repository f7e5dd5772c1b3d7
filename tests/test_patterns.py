"""The pattern dialect: what it accepts, and Java and Python reading its patterns alike."""

import time

import pytest
from pyspark.sql import functions as F

from predspark.errors import CheckProblem
from predspark.functions import patterns
from predspark.operators.environment import Environment
from predspark.operators.prefix_join import below_roots
from predspark.plans.bounds import Limits
from predspark.sources.values import bind
from predspark.streaming.documents import decide_documents
from predspark.types import NUM, STR, Field, Record

#: pattern: a text it is found in, and one it is not.
GOOD = {
    r"\p{L}+": ("é", "1"),
    r"\pL": ("a", "1"),
    r"\x{61}": ("a", "b"),
    "(?<n>a)": ("a", "b"),
    "(?P<n>a)b": ("ab", "a"),
    "[[:alpha:]]+": ("x", ":1"),
    "(?i-u)K": ("k", "K"),
    "(?i)k": ("K", "x"),
    "^a$": ("a", "a\n"),
    "(?m)^a$": ("b\na\nc", "ba"),
    "a.c": ("abc", "a\nc"),
    "(?s)a.c": ("a\nc", "ac"),
    "[a-z&&[^aeiou]]": ("b", "a"),
    "[0-9--4]": ("5", "4"),
    "[a-c~~b-d]": ("d", "b"),
    r"\bfoo\b": ("a foo b", "afoo"),
    r"[^\d\s]": ("a", "1 "),
    "a{2,3}?$": ("aaa", "a"),
    "(?x) a b # c": ("ab", "a b"),
    "[]a]": ("]", "b"),
    "[^]a]": ("b", "]"),
    "(?:ab)**c": ("ababc", "ab"),
    r"\u{e9}": ("é", "e"),
    r"[\p{Greek}--\p{Lu}]": ("α", "Α"),
    "(?U)a+": ("aa", "b"),
    r"[a\-z]": ("-", "b"),
    "x}": ("x}", "x"),
    "[[:^digit:]]": ("a", "1"),
    r"\w+\W\w": ("é b", "ab"),
    "a|(?i)b|c": ("C", "A"),
    "(a(?i)b)c": ("aBc", "aBC"),
    r"(?-u)\w": ("a", "é"),
    r"\b{start}o": ("an ox", "box"),
}
BAD = ["a{,3}", "(", ")", "[", "a{", "*", "(?=a)", r"(a)\1", "a{3,2}", r"\p{Nope}", "[z-a]", "(?z)", "(?<n>a)(?<n>b)", r"\q", "(?i-)a", "\\", "+a", "(?P<1>a)", r"(?-u)\W", "(?-u).", "x{1000000000}"]


def test_java_and_python_find_alike(spark):
    for p, (yes, no) in GOOD.items():
        texts = [yes, no, "", "é b K k\n", "12 foo\tbar"]
        want = [patterns.found(p, t) for t in texts]
        assert want[:2] == [True, False], p
        got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(F.rlike("t", F.lit(patterns.as_java(p))).alias("v")).collect()
        assert [r["v"] for r in got] == want, p


def test_other_patterns_are_errors():
    for p in BAD:
        assert patterns.as_java(p) is None and patterns.found(p, "a") is None, p
    with pytest.raises(CheckProblem):
        Environment().declare("s", STR).compile(r's.matches("\\p{scx=Greek}")')


def test_nested_conditions_compile_in_linear_time():
    env = Environment(limits=Limits(max_depth=64)).declare("f", NUM)
    start = time.perf_counter()
    env.compile("(f > 1 && (f > 2 || " * 15 + "f > 3" + "))" * 15)
    env.compile(" && ".join(["f > 1"] * 500))
    assert time.perf_counter() - start < 1


def test_integers_out_of_range_do_not_bind():
    assert bind(2**64 - 1, NUM) == 2**64 - 1
    with pytest.raises(Exception, match="value"):
        bind(2**64, NUM)


def test_a_root_that_is_neither_streamed_nor_bound_is_refused(spark):
    doc = Record((("k", Field(NUM, True)),), None, "doc")
    p = Environment().declare("doc", doc).declare("limit", NUM).compile("has(doc.k) && doc.k > limit")
    events = spark.createDataFrame([(1, 0, "begin_object", None), (1, 1, "key", "k"), (1, 2, "number", "x"), (1, 3, "end_object", None), (1, 4, "end", None), (2, 0, "begin_object", None), (2, 1, "key", "k"), (2, 2, "number", "7"), (2, 3, "end_object", None), (2, 4, "end", None)], "doc_id long, seq int, kind string, text string")
    with pytest.raises(CheckProblem, match="limit"):
        decide_documents(events, p, "doc")
    got = {r["doc_id"]: r["verdict"] for r in decide_documents(events, p, "doc", bound={"limit": 5}).collect()}
    assert got == {1: "error", 2: "true"}


def test_rows_below_roots(spark):
    rows = [(1, "/a"), (2, "/a/b"), (3, "/ab"), (4, "/c/d/e"), (5, None), (6, ""), (2, "/a/b"), (7, "/c/d")]
    df = spark.createDataFrame(rows, "id int, path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/c/d",), (None,), ("/c/d",)], "root string")
    got = sorted(r["id"] for r in below_roots(df, F.col("path"), roots, F.col("root")).collect())
    assert got == [1, 2, 2, 4, 7]
