"""Quality rules at the level of documents and of hosts.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matched, materialize, words

SPAN = 8


def text_statistics(df: DataFrame, text: Column) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, all row by row, without a shuffle.

    n_repeat_words: words inside 8-word windows that occur twice or more in the text.  Windows are compared by 64-bit
    hashes; a hash set tells texts without repeats apart, and only the others sort their windows."""
    text = F.coalesce(text, F.lit(""))
    df = df.withColumn("_text", text).withColumn("_w", words(F.col("_text")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    window = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(SPAN)])
    hashes = F.when(F.col("n_words") >= SPAN, F.transform(F.sequence(F.lit(0), (F.col("n_words") - SPAN).cast("int")), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_h", hashes).withColumn("_lines", lines)
    df = df.withColumn("_repeats", F.size("_h") > F.size(F.array_distinct("_h")))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get(F.col("_sorted"), k)["h"] == e["h"], F.lit(False))
    twice = F.filter("_sorted", lambda e, k: F.when(k > 0, same(e, k - 1)).otherwise(False) | same(e, k + 1))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    reach = F.transform("_at", lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(SPAN))))
    return df.select(
        "*",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("_text", "_w", "_h", "_lines", "_repeats", "_sorted", "_at")


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame, max_strength: float = 10_000.0) -> DataFrame:
    """Failure rates of hosts, shrunk towards all hosts: judged has host (null: no host) and base_failed.

    The prior is beta(mean * strength, (1 - mean) * strength); mean and strength come from the moments of the hosts'
    raw rates: strength = mean (1 - mean) / variance - 1, from 1 to max_strength.  Returns host, host_docs,
    host_failed, host_rate."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("host_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        mean, variance = 0.0, 0.0
    spread = mean * (1 - mean)
    strength = max_strength if variance * (max_strength + 1) <= spread else max(1.0, spread / variance - 1)
    return hosts.select("host", "host_docs", "host_failed", ((F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))).alias("host_rate"))


#: Hosts are broadcast whole up to so many rows and bytes of names.
MOST_HOSTS, MOST_HOST_BYTES = 500_000, 32_000_000


def small_enough(hosts: DataFrame) -> bool:
    rows, size = hosts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    return rows <= MOST_HOSTS and size <= MOST_HOST_BYTES


def apply_quality_rules(docs: DataFrame, max_host_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Judge every document by its own counts and by its host: rejected if it fails the base rules, or if its host's
    shrunk failure rate is above max_host_rate.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rate.
    The counts are written once, so texts are read once and never shuffled; hosts are aggregated before the shuffle
    and joined back to narrow rows: broadcast while they are few, else those with many documents are, and no other is
    a hot key.  Defined cases: a null or empty text has no words and fails; a document with null host has no host
    verdict (rate null) and is judged by its own counts; repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[host_col].cast("string").alias("host"), docs[text_col].cast("string").alias("_in"))
    judged = text_statistics(narrow, F.col("_in")).drop("_in").withColumn("base_failed", base_failed())
    judged = materialize(judged, "quality-rules")
    hosts = materialize(host_rates(judged).select("host", F.col("host_docs").alias("n"), "host_rate"), "quality-hosts")
    if small_enough(hosts):
        joined = judged.join(F.broadcast(hosts.drop("n")), "host", "left")
    else:
        named = matched(judged.where("host is not null"), "host", hosts, judged.count() / 10_000)
        joined = named.unionByName(judged.where("host is null").withColumn("host_rate", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & ~(F.coalesce("host_rate", F.lit(0.0)) > max_host_rate)
    return joined.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate")


def keep_good(docs: DataFrame, max_host_rate: float = 0.5, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns of docs, whatever these are called.

    Documents that fail by themselves are dropped while the judged rows are written, but counted in their host's rate.
    Rejected hosts are broadcast while they are few, and texts are not shuffled; beyond that those with many documents
    are, and the rest is joined, without a hot key.  Defined cases: a null or empty text fails; a document with null
    host is judged by its own counts; repeated rows are judged each and all kept or none; an empty table gives an empty
    one."""
    packed = docs.select(F.struct("*").alias("_row"), docs[host_col].cast("string").alias("host"), docs[text_col].cast("string").alias("_in"))
    judged = text_statistics(packed, F.col("_in")).drop("_in").withColumn("base_failed", base_failed())
    judged = materialize(judged.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "host", "base_failed"), "quality-keep")
    bad = materialize(host_rates(judged).where(F.col("host_rate") > max_host_rate).select("host", F.col("host_docs").alias("n")), "quality-hosts")
    passed = judged.where("not base_failed")
    if small_enough(bad):
        passed = passed.join(F.broadcast(bad.select("host")), "host", "left_anti")
    else:
        hot = judged.count() / 10_000
        passed = passed.join(F.broadcast(bad.where(F.col("n") >= hot).select("host")), "host", "left_anti")
        # a document without a host is in no host's verdict: it need not be dealt with the others
        named = passed.where("host is not null").join(bad.where(F.col("n") < hot).select("host").hint("shuffle_hash"), "host", "left_anti")
        passed = named.unionByName(passed.where("host is null"))
    return passed.select("_row.*")


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, hash(list_slice(ws, i, i + 7)) AS h FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
s AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(len(array_to_string(ws, '')), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS v FROM h),
p AS (SELECT mean, coalesce(CASE WHEN v * 10001 <= mean * (1 - mean) THEN 10000 ELSE greatest(1, mean * (1 - mean) / nullif(v, 0) - 1) END, 10000) AS k FROM m),
x AS (SELECT h.source, (f + mean * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate, 0) > 0.5 AS kept
FROM b LEFT JOIN x USING (source)
"""
