"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and an end.  A context is the one to `depth` symbols before a position, a start
mark among them.  The tree keeps a context if it occurs least_context times or more and if what follows it diverges
from what follows its own suffix; a position is scored in the longest kept suffix of what precedes it.  A next symbol
of a context is stored if it follows least_symbol times or more.  Both are counts, so the tree grows with the corpus.

The tree is a table.  In a kept context c with back-off weight b(c) the probability of a symbol s is

    p(s | c) = stored share + b(c) * p(s | longest kept proper suffix of c)

so log p is a sum over n-grams that end at the position: the root's log p(s), log b(c) for each kept context, and for
each stored next symbol what it adds to plain back-off.  An n-gram is also the context that comes before the next
symbol, hence rows (key, n, value) for each n-gram, and a text's score is the sum of the values of its n-grams.

Only bounded things are collected and broadcast: n-grams that hold a share p_root of all positions (at most 1/p_root of
each order, for joins), the most frequent rows of the tree (a fixed number, for scoring), and bitmaps of a fixed size
that tell which n-grams cannot be in a table; a bitmap that fills up lets more rows through, which are then dropped.
Everything else is a join of which no key is hot, or meets in buckets of n-grams.  Words and n-grams are told apart by
63-bit hashes: n of them have about n**2 / 2**64 colliding pairs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import BUCKET_ENTRIES, GATHERED, bucket_of, by_bucket, deal, grouped, ordered, runs, small, summed
from .blobs import SCHEMA as BLOBS
from .common import matched, materialize, small_batches, tidy
from .quality_classifier import fold
from .word_hash import WordHasher, mixed

#: Keys of the end of a text and of the mark before its first word: odd, as keys of words are.
END, START = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Entries of a task's counter at which it is summed, and half of those at which it is sent on.
FLUSH = 1_000_000
#: Bits of a bitmap.
BITS = 27
DISCOUNT = 0.5
#: What is on disk at a time: counts of n-grams are shuffled in passes, one for each PASSES-th of all positions whose
#: context is common, and what is asked for in SHARES of the texts; fewer for less than PASS_TOKENS positions each.
PASS_TOKENS, PASSES, SHARES = 1_000_000, 3, 6


def symbols_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the keys of the symbols of their texts (the last column), end to end, and how many each
    text has: a start mark, its words and an end."""
    hasher = WordHasher(lower=True)
    for batch in batches:
        for rows, words, counts in hasher.slices(batch.column(batch.num_columns - 1)):
            sizes = counts + 2
            first = np.cumsum(sizes) - sizes
            keys = np.empty(int(sizes.sum()), np.uint64)
            is_word = np.ones(len(keys), bool)
            is_word[first] = is_word[first + sizes - 1] = False
            keys[first], keys[first + sizes - 1] = START, END
            keys[is_word] = words | np.uint64(1)
            yield batch.slice(rows.start, rows.stop - rows.start), keys, sizes


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def gram_key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of an n-gram from those of its first and its last n - 1 symbols."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + suffix * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) & np.uint64(0xFFFFFFFFFFFFFFFE)


def grams(keys: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1 on: key, prefix and suffix of the n-grams that end at a position, and the position, of all
    positions whose text goes back that far; positions count start marks."""
    place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= 1)
    yield keys[at], keys[at], keys[at], at
    for n in range(1, order):
        at = at[place[at] >= n]
        prefix, suffix = keys[at - 1], keys[at]
        keys = np.zeros(len(keys), np.uint64)
        keys[at] = gram_key(prefix, suffix)
        yield keys[at], prefix, suffix, at


def in_pass(keys: np.ndarray, number: int, passes: int) -> np.ndarray:
    """Which n-grams a pass counts: by bits that do not pick their bucket."""
    return (keys >> np.uint64(1) & np.uint64(0xFFFF)) % np.uint64(passes) == np.uint64(number)


class Counts:
    """How often keys come, with columns that go with each key; sent on when it holds too many distinct ones."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray] | None:
        if columns:
            order = ordered(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
            key, n, first = key[first], np.diff(np.append(first, len(key))), order[first]
        else:
            key, n = np.unique(key, return_counts=True)
        self.held.append([key, n.astype(np.int32), *[c[first] for c in columns]])
        self.size += len(key)
        if self.size > FLUSH:
            self.held = [self.summed()]
            self.size = len(self.held[0][0])
            if self.size > FLUSH // 2:
                return self.rest()
        return None

    def summed(self) -> list[np.ndarray]:
        parts = list(zip(*self.held, strict=True))
        self.held = []
        key, first, n = summed(np.concatenate(parts.pop(0)), np.concatenate(parts.pop(0)))
        out = [key, n]
        while parts:  # a column at a time
            out.append(np.concatenate(parts.pop(0))[first])
        return out

    def rest(self, columns: int = 0) -> list[np.ndarray]:
        """All that is held, which is then forgotten; nothing: as many columns without rows."""
        out = self.summed() if self.held else [np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * columns]
        self.held, self.size = [], 0
        return out


def bitmap(table: DataFrame, key: str) -> np.ndarray:
    """A fixed number of bits, set where a key of the table falls; they come to the driver as 256 rows."""
    chunk = 1 << (BITS - 13)  # words of 32 bits in one of 256 chunks

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(1)) & np.uint64((1 << BITS) - 1)
            yield deal((bit // np.uint64(32 * chunk)).astype(np.int32), 0, [(bit % np.uint64(32 * chunk)).astype(np.uint32)])

    def chunks(bucket: int, entries: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(chunk, np.uint32)
        for _, (bit,) in entries:
            np.bitwise_or.at(out, (bit >> np.uint32(5)).astype(np.int64), np.uint32(1) << (bit & np.uint32(31)))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "bits"])

    got = by_bucket(table.select(key).mapInArrow(words, BLOBS), chunks, "chunk int, bits binary").toArrow()
    out = np.zeros((256, chunk), np.uint32)
    for i, bits in zip(got.column("chunk").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[i] = np.frombuffer(bits, np.uint32)
    return out.ravel()


def packed_bits(bits: np.ndarray) -> bytes:
    """Broadcasts lie on the disk of every executor."""
    return zlib.compress(bits.tobytes(), 1)


def unpacked_bits(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32)


def within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is certainly not in the table of the bitmap."""
    bit = (keys >> np.uint64(1)) & np.uint64((1 << BITS) - 1)
    return (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


class Lookup:
    """Places of keys in a sorted array of keys that are hashes: their upper bits pick a bucket of one or two."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.zeros(1, keys.dtype))
        self.shift = np.uint64(64 - max(4, len(keys).bit_length()))
        ends = np.arange(1 << int(64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.append(np.searchsorted(keys, ends), len(keys)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the place of each of these."""
        bucket = wanted >> self.shift
        at, end = self.starts[bucket], self.starts[bucket + np.uint64(1)]
        place = np.full(len(wanted), -1, np.int32)
        todo = np.flatnonzero(at < end)
        at, end, wanted = at[todo], end[todo], wanted[todo]
        while len(todo):
            hit = self.keys[at] == wanted
            place[todo[hit]] = at[hit]
            at = at + 1
            left = ~hit & (at < end)
            todo, at, end, wanted = todo[left], at[left], end[left], wanted[left]
        here = place >= 0
        return here, place[here]


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query made and run in here are deleted when it ends, as nothing reads them again."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that is not read again."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@dataclass
class SuffixTree:
    tokens: int  # N, ends included
    distinct: int  # V
    table: DataFrame  # key, n, count, value (log10): one row or two for an n-gram, whose values add up; count: of words
    hot: float  # n from which a row is broadcast
    files: list[DataFrame]  # what the table is read from
    start: float = 0.0  # value of the start mark

    def root(self, count: Column) -> Column:
        """Probability of a word without context: a discount of each known word's count goes to the unknown word."""
        if not self.tokens:
            return F.lit(1.0)
        return F.when(count > 0, count - DISCOUNT).otherwise(DISCOUNT * self.distinct) / F.lit(float(self.tokens))


def train(docs: DataFrame, depth: int = 3, least_context: int = 10, least_symbol: int = 3, p_root: float = 1e-4, min_divergence: float = 0.01) -> SuffixTree:
    """docs: held, text.  Learns from rows that are not held.  One pass counts words; one pass for each depth counts
    what follows the contexts of that depth, summed in each task before the shuffle."""
    learned = docs.where(~F.col("held")).select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def packed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for _, keys, sizes in symbols_in(batches):
            (at,) = (x[3] for x in grams(keys, sizes, 1))
            if full := counts.add(keys[at]):
                yield packed(*full)
        yield packed(*counts.rest())

    vocabulary = materialize(learned.mapInArrow(tidy(count_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pst-words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = SuffixTree(tokens, distinct, vocabulary, max(2, math.ceil(p_root * tokens)), [vocabulary])
    words = vocabulary.select("key", "n", tree.root(F.col("n")).alias("q"))
    none = F.lit(None).cast("long").alias("count")
    tree.table = words.select("key", "n", F.col("n").alias("count"), F.log10("q").alias("value"))
    ends = vocabulary.where(F.col("key") == signed(END)).first()
    if not tokens or ends is None:
        return tree
    spark = docs.sparkSession
    least_context, least_symbol = max(2, least_context), max(2, least_symbol)
    start = spark.range(1).select(F.lit(signed(START)).alias("key"), F.lit(ends["n"]).alias("n"))  # once a text
    stored = words
    contexts = words.select("key", "n").union(start).where(F.col("n") >= least_context)
    for order in range(2, depth + 2):
        followed = contexts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        passes = max(1, min(PASSES, tokens // PASS_TOKENS, math.ceil(PASSES * followed / tokens)))
        buckets = bucket_count(spark, followed // passes)
        shared = spark.sparkContext.broadcast((packed_bits(bitmap(contexts, "key")), packed_bits(bitmap(stored.where(F.col("n") >= least_symbol), "key"))))

        def count_next(batches: Iterator[pa.RecordBatch], number: int, shared=shared, order=order, passes=passes, buckets=buckets) -> Iterator[pa.RecordBatch]:
            before, after = map(unpacked_bits, shared.value)
            counts = Counts()

            def packed(counted: list[np.ndarray]) -> pa.RecordBatch:
                key, n, prefix, suffix = counted
                counted.clear()
                bucket = bucket_of(key, buckets)
                del key
                order = grouped(bucket, buckets, prefix)
                bucket, n = bucket[order], n[order]
                prefix = prefix[order]
                suffix = suffix[order]
                del order
                return deal(bucket, 0, [prefix, suffix, n], lambda x: [*runs(x[0]), x[1], small(x[2])])

            for _, keys, sizes in symbols_in(batches):
                *_, (key, prefix, suffix, _) = grams(keys, sizes, order)
                # a stored n-gram's prefix is a context, and its suffix is stored
                may = np.flatnonzero(in_pass(key, number, passes))
                may = may[within(before, prefix[may])]
                may = may[within(after, suffix[may])]
                if full := counts.add(key[may], prefix[may], suffix[may]):
                    yield packed(full)
            yield packed(counts.rest(2))

        def sum_up(_, entries: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            parts = [(np.repeat(prefix, times), suffix, n) for _, (prefix, times, suffix, n) in entries]
            prefix, suffix, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            key, first, n = summed(gram_key(prefix, suffix), n)
            often = n >= least_symbol
            first = first[often]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key[often], prefix[first], suffix[first], n[often])], names=["key", "prefix", "suffix", "n"])

        parts = [materialize(by_bucket(learned.mapInArrow(tidy(partial(count_next, number=k)), BLOBS), sum_up, "key long, prefix long, suffix long, n long"), "pst-counted") for k in range(passes)]
        shared.destroy()
        counted = reduce(DataFrame.union, parts)
        totals = matched(counted, "prefix", contexts.select(F.col("key").alias("prefix"), "n", F.col("n").alias("total")), tree.hot)
        totals = materialize(totals, "pst-totals")
        discard(counted)
        pairs = materialize(matched(totals, "suffix", stored.select(F.col("key").alias("suffix"), "n", F.col("q").alias("shorter")), tree.hot).drop("suffix"), "pst-pairs")
        discard(totals)

        # a context is kept if the Kullback-Leibler divergence (nats) of its stored next symbols, and of the rest as one
        # event, from what the longest kept suffix gives is min_divergence or more; the divergence is weighed against
        # chance: stored symbols / (2 * count) nats are expected without any
        share = F.col("n") / F.col("total")
        sums = pairs.groupBy("prefix").agg(
            F.max("total").alias("n"),
            F.sum((F.col("n") - DISCOUNT) / F.col("total")).alias("taken"),
            F.sum(share).alias("inside"),
            F.sum("n").alias("seen"),
            F.sum("shorter").alias("outside"),
            F.sum(share * F.ln(share / F.col("shorter"))).alias("gain"),
            F.count("*").alias("symbols"),
        )
        rest = F.greatest(1 - F.col("inside"), F.lit(0.0))
        others = F.when((F.col("seen") < F.col("n")) & (rest > 0), rest * F.ln(rest / F.greatest(1 - F.col("outside"), F.lit(1e-12)))).otherwise(0.0)
        divergence = F.col("gain") + others - F.col("symbols") / (2 * F.col("n"))
        tested = materialize(sums.select("prefix", "n", (1 - F.col("taken")).alias("back_off"), (divergence >= min_divergence).alias("kept")), "pst-contexts")

        judged = matched(pairs, "prefix", tested, tree.hot)
        own = (F.col("n") - DISCOUNT) / F.col("total") + F.col("back_off") * F.col("shorter")
        judged = judged.select("key", "n", F.when(F.col("kept"), own).otherwise(F.col("shorter")).alias("q"), F.when(F.col("kept"), F.log10(own / (F.col("back_off") * F.col("shorter")))).alias("value"))
        stored = materialize(judged, "pst-stored")
        tree.files += [tested, stored]
        discard(pairs)
        tree.table = tree.table.union(stored.where("value is not null").select("key", "n", none, "value"))
        tree.table = tree.table.union(tested.where("kept").select("prefix", "n", none, F.log10("back_off")))
        contexts = stored.select("key", "n").where(F.col("n") >= least_context)
    first = tree.table.where(F.col("key") == signed(START)).first()
    tree.start = first["value"] if first else 0.0
    return tree


def bucket_count(spark: SparkSession, entries: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))


def frequent(table: DataFrame, most: int) -> tuple[int, int]:
    """The least n such that at most `most` rows of the table have n or more, and how many rows have less."""
    left = table.select(F.floor(F.log2("n")).alias("e")).groupBy("e").count().collect()  # 64 rows at most
    rows = sum(row["count"] for row in left)
    n, above = 1, 0
    for e, here in sorted(map(tuple, left), reverse=True):
        if above + here > most or e == 0:
            n = 2 << int(e)
            break
        above += here
    return n, rows - above


def score_documents(docs: DataFrame, folds: int = 10, most_hot: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """Learn from the documents outside fold 0 and score them all: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigrams) and score (the tree), both as log10 of the text's probability.

    A task adds up what the broadcast rows of the tree give, those of the most frequent n-grams (most_hot at most), and
    asks for each other n-gram of a text that may be in the tree, once a text.  The rest of the tree and what is asked
    for meet in buckets of n-grams; there the tree's rows are held, and the requests pass by.  Texts are gathered some
    hundred at a time; what a bucket answers to them is one row, and the answers meet at a home of theirs.  This is done
    for a share of the texts after the other, so what is asked for lies on disk for one share at a time; the share
    follows from a row's id and text.  Defined cases: a null or empty text is just an end; a null doc_id counts as held
    out; repeated ids and rows are scored each; with nothing to learn from every symbol is unknown, with probability 1;
    other columns are ignored."""
    held = fold(docs[id_col], folds) == 0
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held.alias("held"), docs[text_col].cast("string").alias("text"))
    spark = docs.sparkSession
    with cleaning(spark), small_batches(spark):
        tree = train(rows.select("held", "text"), **training)
        often, rare_rows = frequent(tree.table, most_hot)
        hot = tree.table.where(F.col("n") >= often).groupBy("key").agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"), F.sum("value").alias("value")).toArrow()  # at most most_hot rows
        rare = tree.table.where(F.col("n") < often).select("key", F.coalesce("count", F.lit(0)).alias("count"), "value")
        maybe = bitmap(rare, "key")
    order = training.get("depth", 3) + 1
    hot = hot.append_column("at", pa.array(hot.column("key").to_numpy().view(np.uint64))).sort_by("at")
    weight = tree.tokens + 0.1 * (tree.distinct + 1)
    shared = spark.sparkContext.broadcast((*(hot.column(c).to_numpy() for c in ("at", "count", "value")), packed_bits(maybe), tree.start))
    nothing_known, unknown = math.log10(0.1 / weight), math.log10(DISCOUNT * tree.distinct / tree.tokens) if tree.tokens else 0.0

    buckets = bucket_count(spark, rare_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, counts, values, bits, start), task, done = shared.value, TaskContext.get().partitionId(), 0
        known, bits = Lookup(keys), unpacked_bits(bits)
        asked: list[list[np.ndarray]] = []
        own: list[list[np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*own, strict=True)]
            own.clear()
            first = columns[0][:1]  # the number of the first text stands for all that are gathered here
            home = bucket_of(mixed(first.astype(np.uint64)), buckets)
            yield deal(np.repeat(home, len(columns[0])), 1, columns)
            rid, key, times = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            yield deal(bucket_of(key, buckets), 2, [(rid - first).astype(np.uint32), key, times], lambda x: [home, first, *map(small, runs(x[0])), x[1], small(x[2])])

        for batch, symbols, sizes in symbols_in(batches):
            n = len(sizes)
            of = np.repeat(np.arange(n), sizes)
            log, base, sure = np.full(n, start), np.zeros(n), np.zeros(n, np.int64)
            sent_of, sent_keys = [], []
            for k, (key, _, _, at) in enumerate(grams(symbols, sizes, order)):
                text = of[at]
                here, place = known.find(key)
                log += np.bincount(text[here], values[place], n)
                away = ~here & within(bits, key)
                if k == 0:
                    base += np.bincount(text[here], np.log10((counts[place] + 0.1) / weight), n)
                    sure += np.bincount(text[here], minlength=n)
                    never = np.bincount(text[~(here | away)], minlength=n)
                    base += never * nothing_known
                    log += never * unknown
                sent_of.append(text[away])
                sent_keys.append(key[away])
            whose, key = np.concatenate(sent_of), np.concatenate(sent_keys)
            sent_of = sent_keys = None
            near = grouped(whose, n, key)
            whose, key = whose[near], key[near]
            new = np.flatnonzero(np.append(True, (whose[1:] != whose[:-1]) | (key[1:] != key[:-1])))[: len(whose)]
            rid = (task << 40) + done + np.arange(n)
            done += n
            ids = batch.column(0)
            own.append([rid, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), sizes - 1, sure, base, log])
            asked.append([rid[whose[new]], key[new], np.diff(np.append(new, len(whose)))])
            if sum(len(x[0]) for x in asked) > GATHERED:
                yield from packed()
        if own:
            yield from packed()

    def of_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            key, count, value = (np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in (0, 1, 2))
            held.clear()
            return deal(bucket_of(key.view(np.uint64), buckets), 0, [key.view(np.uint64), count, value])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > GATHERED:
                yield packed()
        if held:
            yield packed()

    def answer(bucket: int, entries: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        """What the rows of the tree in a bucket (kind 0) add to the texts that asked for them (kind 2), and the rows of
        the texts themselves (kind 1), which are at home here."""
        parts, tree_of = [], None
        for kind, arrays in entries:
            if kind == 0:
                parts.append(arrays)
                continue
            if kind == 1:
                yield deal(np.full(len(arrays[0]), bucket, np.int32), 1, arrays)
                continue
            if tree_of is None:
                key, count, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, np.int64, np.float64))
                parts.clear()
                order = ordered(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
                key, count, value = key[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (count, value))
                tree_of, base_of = Lookup(key), np.log10((count + 0.1) / weight)
            home, first, text, many, key, times = arrays
            of, times = np.repeat(np.arange(len(text)), many), times.astype(np.float64)
            here, place = tree_of.find(key)
            word, n = (key & np.uint64(1)) == 1, len(text)
            never = word & ~here
            found = word[here]
            sure = np.bincount(of[here][found], times[here][found], n).astype(np.int64)
            base = np.bincount(of[here][found], (times[here] * base_of[place])[found], n) + np.bincount(of[never], times[never], n) * nothing_known
            log = np.bincount(of[here], times[here] * value[place], n) + np.bincount(of[never], times[never], n) * unknown
            yield deal(np.repeat(home, n), 2, [text, sure, base, log], lambda x, first=first: [first, small(x[0]), small(x[1]), *x[2:]])

    def add_up(_, entries: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        """The texts that are at home in a bucket (kind 1), with all that was answered (kind 2)."""
        texts: dict[int, list[np.ndarray]] = {}
        for kind, arrays in entries:
            if kind == 1:
                texts[int(arrays[0][0])] = [x.copy() for x in arrays[1:]]
                continue
            first, text, *more = arrays
            for column, x in zip(texts[int(first[0])][4:], more, strict=True):
                column[text] += x  # a text comes once in an answer
        for ids, missing, *columns in texts.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "known", "base", "log"])

    shares = max(1, min(SHARES, tree.tokens // PASS_TOKENS))
    scored = []
    with cleaning(spark), small_batches(spark):
        tree_blobs = materialize(rare.mapInArrow(of_tree, BLOBS), "pst-tree")
        for made in tree.files:
            discard(made)
        for k in range(shares):
            some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shares)) == k) if shares > 1 else rows
            answers = by_bucket(some.mapInArrow(tidy(score), BLOBS).union(tree_blobs), answer, BLOBS)
            scored.append(materialize(by_bucket(answers, add_up, "doc_id long, held_out boolean, n_tokens long, known long, base double, log double"), "pst-scored"))
        discard(tree_blobs)
    shared.destroy()
    out = reduce(DataFrame.union, scored)
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(tree.tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("log").alias("score"))
