"""Registered queries of the expression engine, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predspark.errors import ExpressionError
from predspark.folders import shared_root
from predspark.functions.hosts import Host
from predspark.operators.environment import Environment, decide_all
from predspark.operators.prefix_join import below_roots
from predspark.shipping import ship_package
from predspark.sources import json_text
from predspark.streaming.documents import decide_documents
from predspark.types import DURATION, NUM, STR, Field, ListOf, MapOf, Record

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def admitted(name: str, source: str, key: str, text: str, where: str, root: str = "r", known: dict | None = None, closed: dict | None = None) -> None:
    """A query for the keys of the rows that an expression admits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        env = Environment.from_df(df, root=root)
        for path, values in (closed or {}).items():
            env.declare_closed(path, values)
        return env.compile(text).filter(df).select(key)

    QUERIES[name], SQL[name] = run, f"SELECT {key} FROM {source} WHERE {where}"


def computed(name: str, source: str, key: str, text: str, returning: str, sql: str, root: str = "r") -> None:
    """A query for an expression's value in every row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        p = Environment.from_df(df, root=root).compile(text, returning)
        return df.select(key, (p.double() if returning == "double" else p.column()).alias("value"))

    QUERIES[name], SQL[name] = run, f"SELECT {key}, {sql} AS value FROM {source}"


admitted("q01_eq_and_gt", "orders", "o_orderkey", 'r.o_orderstatus == "F" && r.o_totalprice > 100000', "o_orderstatus = 'F' AND o_totalprice > 100000")
admitted("q02_or_not", "orders", "o_orderkey", '!(r.o_orderstatus == "O") || r.o_totalprice < 5000', "NOT o_orderstatus = 'O' OR o_totalprice < 5000")
admitted("q03_in_literal", "events", "event_id", 'r.event_type in ["click", "view"]', "event_type IN ('click', 'view')")
admitted("q04_starts_with", "orders", "o_orderkey", 'r.o_orderpriority.startsWith("1-")', "starts_with(o_orderpriority, '1-')")
admitted("q05_ends_contains", "part", "p_partkey", 'r.p_name.endsWith("1") || r.p_name.contains("red")', "suffix(p_name, '1') OR contains(p_name, 'red')")
admitted("q06_matches", "orders", "o_orderkey", 'r.o_orderpriority.matches("^[12]-")', "regexp_matches(o_orderpriority, '^[12]-')")
computed("q07_ternary", "lineitem", "l_orderkey", 'r.l_quantity > 25 ? "big" : "small"', "string", "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END")
computed("q08_arithmetic", "lineitem", "l_orderkey", "r.l_extendedprice * (1 - r.l_discount)", "double", "l_extendedprice * (1 - l_discount)")
computed("q09_real_division", "orders", "o_orderkey", "r.o_orderkey / 2", "double", "o_orderkey / 2.0::DOUBLE")
admitted("q10_negation", "customer", "c_custkey", "-r.c_acctbal > 0", "-c_acctbal > 0")
computed("q10_concat", "customer", "c_custkey", 'r.c_mktsegment + "/" + r.c_name', "string", "c_mktsegment || '/' || c_name")


def items(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> tuple[DataFrame, Environment]:
    """Line items as a list of records for each order (a handful; a list is one value, so a group has to fit a task)."""
    lines = table(spark, sf_dir, "lineitem")
    names = [c for c, t in lines.dtypes if c not in ("l_orderkey", "l_shipdate") and (names is None or c in names)]
    df = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*names)).alias("items"))
    return df, Environment.from_df(df, root="g")


def per_order(name: str, text: str, sql: str, returning: str = "bool") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # only the fields that the program reads are grouped
        read = items(spark, sf_dir)[1].compile(text, returning).element_fields("items")
        df, env = items(spark, sf_dir, read)
        p = env.compile(text, returning)
        return df.select("l_orderkey", (p.double() if returning == "double" else p.column()).alias("value"))

    QUERIES[name], SQL[name] = run, f"SELECT l_orderkey, {sql} AS value FROM lineitem GROUP BY l_orderkey"


per_order("q11_exists", "g.items.exists(i, i.l_quantity > 49)", "bool_or(l_quantity > 49)")
per_order("q12_all", "g.items.all(i, i.l_discount < 0.1)", "bool_and(l_discount < 0.1)")
per_order("q13_exists_one", "g.items.exists_one(i, i.l_linenumber == 1)", "count(*) FILTER (WHERE l_linenumber = 1) = 1")
per_order("q14_filter_size", 'size(g.items.filter(i, i.l_returnflag == "R"))', "CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE)", "double")
per_order("q15_map_in", '"R" in g.items.map(i, i.l_returnflag)', "bool_or(l_returnflag = 'R')")
per_order("q16_map_filtered", "size(g.items.map(i, i.l_tax > 0.05, i.l_quantity))", "CAST(count(*) FILTER (WHERE l_tax > 0.05) AS DOUBLE)", "double")
admitted("q17_all_components", "embeddings", "vec_id", "r.embedding.all(x, x > -0.3 && x < 0.3)", "len(list_filter(embedding, lambda x: x > -0.3::DOUBLE AND x < 0.3::DOUBLE)) = len(embedding)")
admitted("q18_index", "embeddings", "vec_id", "r.embedding[0] > 0", "embedding[1] > 0")

PROPS = Record((("k", Field(NUM, True)), ("missing", Field(NUM, True))), None, "props")
K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def props(spark: SparkSession, sf_dir: str, demanded: set[str]) -> tuple[DataFrame, Environment]:
    df = json_text.bind(table(spark, sf_dir, "events"), "parsed", F.col("props"), PROPS, demanded)
    return df, Environment().declare("e", PROPS, F.col("parsed"), json_text.bound_type(PROPS))


@query(f"SELECT event_id FROM events WHERE {K} > 50")
def q19_json_has(spark, sf_dir):
    df, env = props(spark, sf_dir, {"k"})
    return env.compile("has(e.k) && e.k > 50").filter(df).select("event_id")


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS DOUBLE) AS value FROM events")
def q20_or_value(spark, sf_dir):
    """A field that is there in two of three rows, and one that never is."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.format_string('{"k": %d}', "event_id"))
    df = json_text.bind(table(spark, sf_dir, "events"), "parsed", text, PROPS)
    env = Environment().declare("e", PROPS, F.col("parsed"), json_text.bound_type(PROPS))
    return df.select("event_id", env.compile("e.?k.orValue(-1) + e.?missing.orValue(0)", "double").double().alias("value"))


@query(f"SELECT event_id FROM events WHERE {K} > 50")
def q21_map_key(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    env = Environment().declare("m", MapOf(STR, NUM), F.col("m"), T.MapType(T.StringType(), T.LongType()))
    return env.compile('"k" in m && m["k"] > 50').filter(df).select("event_id")


@query("SELECT event_id FROM events WHERE event_id * 1500 > 30000")
def q22_duration(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("gap", F.col("event_id") * F.expr("INTERVAL '1.5' SECOND"))
    env = Environment().declare("gap", DURATION, F.col("gap"))
    return env.compile("gap > 30s").filter(df).select("event_id")


ROOTS = ["http://ththre.example.com/fr", "http://onthe.example.com", "https://anor.example.com/en", *[f"http://{a}{b}.example.com" for a in "abcdefghij" for b in "kl"]]


@query("SELECT page_id FROM pages WHERE " + " OR ".join(f"url = '{r}' OR starts_with(url, '{r}/')" for r in ROOTS))
def q23_specialized_prefix(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    env = Environment.from_df(df, root="pg").declare("policy", Record.of("policy", roots=ListOf(STR)))
    p = env.compile('policy.roots.exists(r, pg.url == r || pg.url.startsWith(r + "/"))', known={"policy": {"roots": ROOTS}})
    return p.filter(df).select("page_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q24_known_in(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    env = Environment.from_df(df, root="c").declare("policy", Record.of("policy", segments=ListOf(STR)))
    p = env.compile("c.c_mktsegment in policy.segments", known={"policy": {"segments": ["BUILDING", "MACHINERY"]}})
    return p.filter(df).select("c_custkey")


admitted("q25_closed_set", "events", "event_id", 'r.event_type == "click" || r.event_type == "purchase"', "event_type IN ('click', 'purchase')", closed={"r.event_type": ["signup", "error", "click", "view", "purchase"]})


@query("SELECT o_orderkey FROM orders WHERE 2 * o_totalprice > 500000")
def q26_host_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    env = Environment.from_df(df, root="o").register("twice", Host((NUM,), NUM, columns=lambda x: x * 2))
    return env.compile("twice(o.o_totalprice) > 500000").filter(df).select("o_orderkey")


@query("SELECT p_partkey, reverse(p_brand) AS value FROM part")
def q26_host_python(spark, sf_dir):
    ship_package(spark)
    df = table(spark, sf_dir, "part")
    env = Environment.from_df(df, root="p").register("rev", Host((STR,), STR, member=True, python=lambda s: s[::-1]))
    return df.select("p_partkey", env.compile("p.p_brand.rev()", "string").column().alias("value"))


RULES = {"cheap": "r.o_totalprice < 20000", "urgent": 'r.o_orderpriority.startsWith("1-")', "open_big": 'r.o_orderstatus == "O" && r.o_totalprice > 200000'}


@query("SELECT count(*) FILTER (WHERE o_totalprice < 20000) AS cheap, count(*) FILTER (WHERE starts_with(o_orderpriority, '1-')) AS urgent, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 200000) AS open_big FROM orders")
def q27_many_rules(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    env = Environment.from_df(df, root="r")
    decided = decide_all(df, {k: env.compile(v) for k, v in RULES.items()})
    return decided.agg(*[F.count(F.when(F.col(k), 1)).alias(k) for k in RULES])


def numbered(spark, sf_dir, text: str, **columns):
    df = table(spark, sf_dir, "orders")
    for k, c in columns.items():
        df = df.withColumn(k, c)
    return df, Environment.from_df(df, root="o").compile(text)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def q28_error_absorbed(spark, sf_dir):
    df, p = numbered(spark, sf_dir, 'o.few[9] == 1 || o.o_orderstatus == "F"', few=F.array(F.lit(1)))
    return p.filter(df).select("o_orderkey")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'false' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
def q29_error_denies(spark, sf_dir):
    df, p = numbered(spark, sf_dir, 'o.few[9] == 1 && o.o_orderstatus == "F"', few=F.array(F.lit(1)))
    return df.select(p.verdict().alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey = 0")
def q30_exact_integers(spark, sf_dir):
    big = F.col("o_orderkey") + F.lit(2**53)
    rounded = F.when(F.col("o_orderkey") % 2 == 1, big - 1).otherwise(F.when(F.col("o_orderkey") == 0, big + 2).otherwise(big)).cast("double")
    df, p = numbered(spark, sf_dir, "o.big != o.rounded", big=big, rounded=rounded)
    return p.filter(df.where("o_orderkey < 9007199254740992")).select("o_orderkey")


computed(
    "q31_tags", "events", "event_id", 'r.event_type == "error" ? "alert" : (r.value > 50 ? "high" : "low")', "string", "CASE WHEN event_type = 'error' THEN 'alert' WHEN value > 50 THEN 'high' ELSE 'low' END"
)


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q32_semi_join(spark, sf_dir):
    """Membership in a list that is a table: an expression picks the list, a semi-join looks the rows up."""
    nations = table(spark, sf_dir, "nation")
    wanted = Environment.from_df(nations, root="n").compile("n.n_regionkey == 1").filter(nations)
    df = table(spark, sf_dir, "customer")
    return df.join(wanted, df["c_nationkey"] == wanted["n_nationkey"], "left_semi").select("c_custkey")


def tokens(df: DataFrame) -> DataFrame:
    """The events of props as JSON documents: {"k": number}."""
    k = F.regexp_extract("props", r'"k":\s*(-?\d+)', 1)
    steps = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in (("begin_object", F.lit(None).cast("string")), ("key", F.lit("k")), ("number", k), ("end_object", F.lit(None).cast("string")), ("end", F.lit(None).cast("string")))])
    return df.select(F.col("event_id").alias("doc_id"), F.posexplode(steps).alias("seq", "e")).select("doc_id", "seq", "e.kind", "e.text")


@query(f"SELECT event_id AS doc_id, CASE WHEN {K} > 50 THEN 'true' ELSE 'false' END AS verdict FROM events")
def q33_documents(spark, sf_dir):
    p = Environment().declare("doc", PROPS).compile("has(doc.k) && doc.k > 50")
    return decide_documents(tokens(table(spark, sf_dir, "events")), p, "doc")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def q34_stream_filter(spark, sf_dir):
    """The same program over a stream of files; all that is there is processed, then the stream stops."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    program = Environment.from_df(events, root="e").compile('e.event_type == "click" && e.value > 50')
    out = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    stream = program.filter(events).select("event_id").writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    stream.awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{out}/rows")


@query("SELECT conv_id, bool_or(role = 'user') AND NOT bool_or(contains(text, '###')) AS value FROM conversations GROUP BY conv_id")
def q35_nested_folds(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    p = Environment.from_df(df, root="c").compile('["user"].exists(who, c.turns.exists(t, t.role == who)) && !c.turns.exists(t, t.text.contains("###"))')
    return df.select("conv_id", p.column().alias("value"))


@query("SELECT event_id, CAST(floor(event_id * 1.5) AS DOUBLE) AS value FROM events")
def q36_total_seconds(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("gap", F.col("event_id") * F.expr("INTERVAL '1.5' SECOND"))
    p = Environment().declare("gap", DURATION, F.col("gap")).compile("(gap + 0s).getSeconds()", "double")
    return df.select("event_id", p.double().alias("value"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23)")
def q37_known_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    env = Environment.from_df(df, root="s").declare("odd", ListOf(NUM))
    return env.compile("s.s_nationkey in odd", known={"odd": list(range(1, 25, 2))}).filter(df).select("s_suppkey")


@query("SELECT p_partkey, [p_size, p_size + 1] = [10, 11] AS value FROM part")
def q38_list_equality(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    p = Environment.from_df(df, root="p").compile("[p.p_size, p.p_size + 1] == [10.0, 11]")
    return df.select("p_partkey", p.column().alias("value"))


@query("SELECT n_nationkey, r_name, n_name <> r_name AND r_name <> 'ASIA' AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def q39_record_rules(spark, sf_dir):
    """Two records at once: a rule over joined rows."""
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = Environment.from_df(df, root="x").compile("x.n_name != x.r_name && x.r_name != 'ASIA'")
    return df.select("n_nationkey", "r_name", p.column().alias("value"))


admitted("q40_labels", "labels", "doc_id", "r.quality == 1 && !(r.toxic == 1)", "quality = 1 AND NOT toxic = 1")
admitted("q41_text", "documents", "doc_id", 'r.text.contains("the") && r.lang in ["en"] && r.n_chars > 1000', "contains(text, 'the') AND lang IN ('en') AND n_chars > 1000")
admitted("q42_benchmark", "benchmark", "item_id", 'r.text.matches("(?i)^[a-m]")', "regexp_matches(text, '(?i)^[a-m]')")
computed("q43_map_literal", "orders", "o_orderkey", '(r.o_orderstatus in {"F": 1, "O": 2}) ? {"F": "done", "O": "open"}["F"] : "other"', "string", "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' ELSE 'other' END")
computed("q44_region", "region", "r_regionkey", 'r.r_name >= "ASIA" ? r.r_name : ""', "string", "CASE WHEN r_name >= 'ASIA' THEN r_name ELSE '' END")



# literals, reads, functions


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def q45_bytes(spark, sf_dir):
    df, p = numbered(spark, sf_dir, 'o.raw == b"F"', raw=F.encode("o_orderstatus", "UTF-8"))
    return p.filter(df).select("o_orderkey")


computed("q46_null_is_decided", "part", "p_partkey", "r.p_name != null && !(r.p_size == null) // always", "bool", "TRUE")
admitted("q47_record_index", "orders", "o_orderkey", 'r["o_orderstatus"] == "F" && r["o_totalprice"] > 0x64', "o_orderstatus = 'F' AND o_totalprice > 100")


def over_props(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, env = props(spark, sf_dir, {"k"})
        return env.compile(text).filter(df).select("event_id")

    QUERIES[name], SQL[name] = run, f"SELECT event_id FROM events WHERE {where}"


over_props("q48_has_value", "e.?k.hasValue() && e.k > 50 && !has(e.?missing)", f"{K} > 50")
over_props("q49_key_in_record", '"k" in e && e.k > 50', f"{K} > 50")


@query("SELECT event_id, CAST((event_id % 100) * 1500 AS DOUBLE) AS value FROM events WHERE event_id % 100 > 10")
def q50_duration_text(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("t", F.concat(F.col("event_id") % 100, F.lit("s"), (F.col("event_id") % 100) * 500, F.lit("ms")))
    env = Environment.from_df(df.select("t"), root="x")
    ms = env.compile("duration(x.t).getMilliseconds()", "double").double().alias("value")
    return env.compile('duration(x.t) > duration("15s")').filter(df).select("event_id", ms)


computed("q51_list_concat", "part", "p_partkey", "([r.p_size] + [7, 8.5])[0] + size([1] + [r.p_size])", "double", "CAST(p_size + 2 AS DOUBLE)")


@query(f"SELECT event_id FROM events WHERE {K} > 50")
def q52_fold_over_map(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    env = Environment().declare("m", MapOf(STR, NUM), F.col("m"), T.MapType(T.StringType(), T.LongType()))
    return env.compile("m.exists(k, m[k] > 50) && m.all(k, m[k] > 0)").filter(df).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def q53_map_keys_in_order(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("m", F.create_map(F.lit("G"), F.lit(1.0), F.col("o_orderstatus"), F.lit(2.0)))
    env = Environment().declare("m", MapOf(STR, NUM), F.col("m"))
    return env.compile('m.map(k, k)[0] == "F"').filter(df).select("o_orderkey")


admitted("q54_empty_fold", "part", "p_partkey", "[].exists(x, x == 1) || [].all(x, x == 1) && r.p_size > 10", "p_size > 10")
admitted("q55_unicode_classes", "documents", "doc_id", r"""r.text.matches("\\p{Lu}\\pL+") && r.text.matches("[[:alpha:]]\\d")""", r"regexp_matches(text, '\p{Lu}\pL+') AND regexp_matches(text, '[[:alpha:]]\p{Nd}')")
admitted("q56_named_groups", "documents", "doc_id", r"""r.text.matches("(?P<first>t)(?<second>he)\\x{20}")""", "contains(text, 'the ')")
admitted("q57_bad_pattern_absorbed", "documents", "doc_id", 'r.text.matches("a{,3}") || ["(", "(?=a)", "the"].exists(p, r.text.matches(p))', "contains(text, 'the')")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE -1 END AS value FROM events")
def q58_tag(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", Environment.from_df(df, root="e").compile("e.event_type", "string").tag(["click", "view"]).alias("value"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def q68_computed_facts(spark, sf_dir):
    """Facts that are computed when they are read; one that is not read would make the job fail."""
    df = table(spark, sf_dir, "orders")
    env = Environment().declare_facts("f", price=(NUM, F.col("o_totalprice") * 1), broken=(NUM, F.raise_error(F.lit("read"))), maybe=(Field(NUM, True), F.lit(None).cast("double")))
    return env.compile("f.price > 100000 && !has(f.maybe)").filter(df).select("o_orderkey")


# functions of the caller


@query("SELECT p_partkey FROM part WHERE p_size > 10 OR p_size % 2 = 0")
def q59_host_error_absorbed(spark, sf_dir):
    def halved(x):
        if x % 2:
            raise ValueError(x)
        return x // 2

    ship_package(spark)
    df = table(spark, sf_dir, "part")
    env = Environment.from_df(df, root="r").register("halved", Host((NUM,), NUM, python=halved))
    return env.compile("halved(r.p_size) >= 0 || r.p_size > 10").filter(df).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size * 2 > 50")
def q60_call_host(spark, sf_dir):
    """A function that is declared, and gets its implementation for each run."""
    ship_package(spark)
    df = table(spark, sf_dir, "part")
    p = Environment.from_df(df, root="r").register("risk", Host((NUM,), NUM)).compile("risk(r.p_size) > 50")
    return p.with_hosts(risk=lambda x: x * 2).filter(df).select("p_partkey")


@query("SELECT o_orderkey FROM orders")
def q61_exact_hosts(spark, sf_dir):
    """Integers above 2**53 go through functions as they are."""
    ship_package(spark)
    df = table(spark, sf_dir, "orders").withColumn("big", F.col("o_orderkey") + F.lit(2**53 + 1))
    env = Environment.from_df(df, root="o").register("same", Host((NUM,), NUM, columns=lambda x: x)).register("alike", Host((NUM,), NUM, python=lambda x: x))
    return env.compile("same(o.big) == o.big && alike(o.big) == o.big && same(o.big) != same(o.big) - 1").filter(df).select("o_orderkey")


# numbers of JSON, documents beside bound values


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 3 THEN 'error' WHEN 1 THEN 'true' ELSE 'false' END AS verdict FROM events")
def q62_json_numbers(spark, sf_dir):
    """2**64 and a text are errors; 2**64 - 1 is exact."""
    kind = Record((("a", Field(NUM)),), None, "n")
    texts = F.array(F.lit('{"a": 18446744073709551616}'), F.lit('{"a": 18446744073709551615}'), F.lit('{"a": 1.5}'), F.lit('{"a": "5"}'))
    df = json_text.bind(table(spark, sf_dir, "events"), "parsed", F.get(texts, (F.col("event_id") % 4).cast("int")), kind)
    env = Environment().declare("n", kind, F.col("parsed"), json_text.bound_type(kind))
    return df.select("event_id", env.compile("n.a > 18446744073709551614").verdict().alias("verdict"))


POLICY = Record.of("policy", limit=NUM)


@query(f"SELECT event_id AS doc_id, CASE WHEN {K} > 50 THEN 'true' ELSE 'false' END AS verdict FROM events")
def q63_document_beside_bound(spark, sf_dir):
    p = Environment().declare("doc", PROPS).declare("policy", POLICY).compile("has(doc.k) && doc.k > policy.limit")
    return decide_documents(tokens(table(spark, sf_dir, "events")), p, "doc", bound={"policy": {"limit": 50}})


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'true' END AS verdict FROM events")
def q64_documents_with_odd_values(spark, sf_dir):
    """Events that are not demanded are passed over; the first of two equal keys counts; a number out of range is an error."""
    even = F.col("event_id") % 2 == 0
    step = lambda kind, text=None: F.struct(F.lit(kind).alias("kind"), (F.lit(text).cast("string") if text is None or isinstance(text, str) else text).alias("text"))
    number = F.when(even, F.lit(str(2**64))).otherwise(F.lit(str(2**64 - 1)))
    steps = [step("begin_object"), step("key", "other"), step("begin_array"), step("number", "1"), step("begin_object"), step("end_object"), step("end_array"), step("key", "k"), step("number", number), step("key", "k"), step("number", "1"), step("end_object"), step("end")]
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.posexplode(F.array(*steps)).alias("seq", "e")).select("doc_id", "seq", "e.kind", "e.text")
    return decide_documents(df, Environment().declare("doc", PROPS).compile("has(doc.k) && doc.k > 1"), "doc")


# policies that are tables, and what is known of programs without rows


@query("SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM (SELECT regexp_replace(url, '/[^/]*$', '') AS root FROM pages WHERE page_id % 7 = 0) WHERE url = root OR starts_with(url, root || '/'))")
def q65_roots_of_a_table(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    roots = df.where("page_id % 7 = 0").select(F.regexp_replace("url", "/[^/]*$", "").alias("root"))
    return below_roots(df, F.col("url"), roots, F.col("root")).select("page_id")


#: Expressions, and whether they are refused when they are compiled.
COMPILED = {
    "1u == 1": True,
    "r.p_size % 2 == 0": True,
    "T{a: 1} == 1": True,
    "[?1] == [1]": True,
    "[1][?0].orValue(2) == 1": True,
    "[1, 2].exists(i, v, i == v)": True,
    "r[r.p_name] == 1": True,
    "m[r.p_name] == 1": True,
    "r.p_name in r": True,
    "r.nosuch == 1": True,
    '1 == "a"': True,
    "size(r.p_name) == 1": True,
    'm["a"] == 1': True,
    "twice(1) == 2": True,
    'r.p_name.matches("\\\\p{scx=Greek}")': True,
    "has(r.p_size)": False,
    '"a" in m && m["a"] == 1': False,
    'm["a"] == 1 && has(m.a)': False,
    "m.all(k, m[k] > 0)": False,
    "r.p_name in m": False,
    "[1, 2.5] == [1.0, 2] // a comment": False,
    "30s < 1h30m": False,
    "null == r.p_name": False,
    " && ".join(["(true || " * 30 + "r.p_size > 1" + ")" * 30]): False,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(refused).upper()})" for i, refused in enumerate(COMPILED.values())) + ") AS t(id, refused)")
def q66_refusals(spark, sf_dir):
    env = Environment.from_df(table(spark, sf_dir, "part"), root="r").declare("m", MapOf(STR, NUM))

    def refused(text: str) -> bool:
        try:
            env.compile(text)
        except ExpressionError:
            return True
        return False

    return spark.createDataFrame([(i, refused(text)) for i, text in enumerate(COMPILED)], "id int, refused boolean")


ANALYSIS = {
    "demand": "[('o', 'few'), ('o', 'o_orderstatus'), ('o', 'o_totalprice')]",
    "conjuncts": "[(('o', 'o_orderstatus'), '==', 'F'), (('o', 'o_totalprice'), '>', 100)]",
    "result_kind": "string",
    "residual": 'o.o_orderstatus == "F"',
    "text": '(o.o_totalprice > 1) && (o.o_orderstatus == "F")',
    "index": "['b']",
    "functions": "True",
    "presence": "m[\"a\"]",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in ANALYSIS.items()) + ") AS t(aspect, value)")
def q67_analysis(spark, sf_dir):
    from predspark.functions import signatures
    from predspark.operators.environment import reverse_index
    from predspark.plans import unparse

    df = table(spark, sf_dir, "orders").withColumn("few", F.array(F.lit(1)))
    env = Environment.from_df(df, root="o").declare("policy", Record.of("policy", wanted=STR))
    both = env.compile('o.o_orderstatus == "F" && 100 < o.o_totalprice')
    found = {
        "demand": str(env.compile('o.few[0] == 1 || o.o_orderstatus == "F" && o.o_totalprice > 100').demand.pruned()),
        "conjuncts": str([(c.path, c.operator, c.literal) for c in both.conjuncts()]),
        "result_kind": env.compile("o.o_orderstatus", "string").result_kind,
        "residual": env.compile("o.o_orderstatus == policy.wanted", known={"policy": {"wanted": "F"}}).source,
        "text": unparse.unparse(env.parse("(o.o_totalprice>1)&&(o.o_orderstatus=='F')")),
        "index": str(reverse_index({"a": env.compile("o.o_totalprice > 1"), "b": both})[("o", "o_orderstatus")]),
        "functions": str({"startsWith", "getSeconds", "&&"} <= {name for name, _ in signatures.table()}),
    }
    try:
        Environment().declare("m", MapOf(STR, NUM)).compile('m["a"] == 1')
    except ExpressionError as e:
        found["presence"] = e.source[e.first.start : e.first.end]
    return spark.createDataFrame(list(found.items()), "aspect string, value string")
