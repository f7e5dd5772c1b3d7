"""A quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

BITS = 18
BUCKETS = 1 << BITS
#: Words that a worker remembers.
REMEMBERED = 400_000
_classes = re.compile(r"([^\W\d_a-zß-öø-ÿ]+)|([^\W\d_]+)|(\d+)|((.)\5*)", re.S)


def shape(word: str) -> str:
    """How a word is written: runs of capitals X, other letters x, digits 0, and other characters as they are."""
    return "".join("X" if m[1] else "x" if m[2] else "0" if m[3] else m[4][:2] for m in _classes.finditer(word))


def h64(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{text}".encode("utf-8", "surrogatepass"))


class Features:
    """Word n-grams of a text as bucket numbers.  Two streams: lower-cased words (1-grams and 2-grams), and shapes,
    marked when a word repeats one of the two before it (1-grams, 2-grams and 3-grams).  A feature's value is its
    number of occurrences over the number of words."""

    GRAMS = 5

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 2), np.uint64)

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(GRAMS, words) buckets of all texts end to end, -1 where an n-gram would begin in the text before, and
        the number of words of each text."""
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.__init__()
        if new := list({w for own in cut for w in own if w not in self.known}):
            strings = [w.decode("utf-8", "surrogatepass") for w in new]
            rows = np.array([(h64("w", s.lower()), h64("s", shape(s))) for s in strings], np.uint64)
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        known, counts = self.known, np.array([len(own) for own in cut], np.int64)
        ids = np.fromiter((known[w] for own in cut for w in own), np.int64, int(counts.sum()))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        word, form = self.table[ids, 0], self.table[ids, 1]
        again = np.zeros(len(ids), bool)
        for k in (1, 2):
            again[k:] |= (ids[k:] == ids[:-k]) & (place[k:] >= k)
        form = form ^ np.where(again, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        out = np.full((self.GRAMS, len(ids)), -1, np.int64)
        for row, (stream, n) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3))):
            mixed = stream.copy()
            for k in range(1, n):
                mixed[k:] = mixed[k:] * np.uint64(0x9FB21C651E98DF25) + stream[:-k] * np.uint64(2 * k + 1)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93 + 2 * row)
            out[row] = np.where(place >= n - 1, (mixed >> np.uint64(64 - BITS)).astype(np.int64), -1)
        return out, counts

    def sparse(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct buckets and values of each text."""
        buckets, counts = self.buckets(texts)
        out, at = [], 0
        for n in counts.tolist():
            own = buckets[:, at : at + n].ravel()
            which, times = np.unique(own[own >= 0], return_counts=True)
            out.append((which.astype(np.int32), (times / max(1, n)).astype(np.float32)))
            at += n
        return out

    def dot(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """The sparse dot product of each text with the weights."""
        buckets, counts = self.buckets(texts)
        each = np.append(weights, 0.0)[buckets].sum(0)  # bucket -1 is the appended 0
        ends = np.cumsum(counts)
        total = np.append(0.0, np.cumsum(each))
        return (total[ends] - total[ends - counts]) / np.maximum(1, counts)


class FTRL:
    """Follow the regularised leader, per coordinate, for logistic loss; coordinate BUCKETS is the bias."""

    def __init__(self, alpha: float = 1.5, beta: float = 0.5, l1: float = 0.02, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, which: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(which, BUCKETS), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fold(id_column, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, passes: int = 3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (BUCKETS of them, then the bias) learned from at most max_rows labelled texts outside fold 0, those with
    the least hash of the id and then the least digest of the text.

    max_rows bounds the rows that one task learns from, at any size of the tables.  The ids and digests of the sample
    are found first, and broadcast, so that only its texts are turned into vectors and shuffled.  Ids with both labels,
    null ids and null labels are left out; a text that comes twice under one id is learned from once, each of several
    texts under one id by itself; a null text is an empty one.  Without any labelled row all weights are 0."""
    known = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(fold(F.col("_id"), folds) != 0).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
    labelled = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("_id"), text.alias("text")).join(F.broadcast(labelled), "_id").withColumn("_h", F.md5(F.col("text").cast("binary")))
    sample = rows.select("_id", "_h").distinct().orderBy(F.xxhash64("_id"), "_id", "_h").limit(max_rows)
    rows = rows.join(F.broadcast(sample), ["_id", "_h"]).select("_id", "_y", "_h", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(), set()  # of the sample: at most max_rows
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = pa.array([i for i, k in enumerate(key) if not (k in seen or seen.add(k))], pa.int64())
            batch = batch.take(new)
            texts = batch.column(3).to_pylist()
            made = [v for part in slices(texts) for v in features.sparse(texts[part])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([w.tobytes() for w, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["id", "y", "h", "which", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, data, last = FTRL(), [], None
        for batch in batches:
            for i, h, y, w, x in zip(*[batch.column(c).to_pylist() for c in ("id", "h", "y", "which", "x")], strict=True):
                if (i, h) != last:
                    data.append((y, np.frombuffer(w, np.int32), np.frombuffer(x, np.float32)))
                last = (i, h)
        for _ in range(passes):
            for y, which, x in data:
                model.learn(which, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["w"])

    made = rows.mapInArrow(vectors, "id long, y int, h string, which binary, x binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "h")
    got = made.mapInArrow(train, "w binary").first()
    return np.frombuffer(got[0], np.float32).astype(np.float64) if got else np.zeros(BUCKETS + 1)


def with_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a column for the probability of label 1.  No shuffle; weights (a fixed 2**18) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value.astype(np.float64)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            made = [sigmoid(features.dot(texts[part], w[:-1]) + w[-1]) for part in slices(texts)]
            values = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """Fit on labels and score every text: doc_id, held_out (fold 0), score, predicted (1 from the threshold on).

    Defined cases: a null or empty text has the score of the bias alone; null and repeated doc_ids and repeated rows
    are scored each (a null id counts as held out); an empty table gives an empty result; other columns are ignored."""
    weights = fit(docs, labels, folds=folds, id_col=id_col, text_col=text_col, **fitting)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (fold(docs[id_col], folds) == 0).alias("held_out"), docs[text_col].cast("string").alias("text"))
    scored = with_scores(rows, weights)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The documents predicted good, with the columns of docs, whatever these are called.

    Defined cases: a null or empty text has the score of the bias alone; rows with null or repeated doc_ids and repeated
    rows are judged each, by their text; without labels every score is 0.5 and all stay; an empty table gives an empty
    one."""
    weights = fit(docs, labels, **fitting)
    score = "_quality_score"
    while score.lower() in {c.lower() for c in docs.columns}:
        score += "_"
    kept = with_scores(docs, weights, score=score).where(F.col(score) >= threshold)
    return kept.drop(score)
