"""Near-duplicate documents: BagMinHash signatures, bands, and exact weighted-Jaccard verification.

    texts -> signatures, one for each different text -> bands -> buckets with two or more texts
    buckets: pairs whose signatures agree enough span a forest of edges -> clusters (connected components)
    clusters: bags of shingles of the texts, fetched once; pairs that share a band and agree enough are verified
              exactly unless they are connected already -> links that span the classes -> classes (components)

Nodes are different texts (by their digest), so exact copies cost nothing beyond the first step.  A bucket or cluster
of more than BLOCK texts is dealt in blocks of about BLOCK, each with a few common pivots; what hangs together with
the same pivots needs no more pairs, and only the texts that do not are compared with all others of the group, block
by block.  So a group of copies costs rows in proportion to its size, a task holds two blocks at most, no pair that
could link two components is skipped, and only forests are sent on."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bag_minhash import SIZE, Shingler, bands, signatures, weighted_jaccard
from .bpe import slices
from .common import WORD, matched, materialize, small_batches, tidy

BLOCK = 512
PIVOTS = 8
#: Characters of texts whose shingles a worker holds at once.
SLICE = 1_000_000
#: Keys of documents (a digest and an id) up to which they are broadcast, so that other texts are not shuffled.
MOST_KEYS = 400_000
#: The share of pairs at the similarity asked for that a step may fail: about one in five million.
MISSED = 2e-7


def least_agreement(similarity: float, size: int = SIZE) -> int:
    """Components that must agree before a pair is looked at more closely: fewer do once in 1 / MISSED pairs of that
    similarity.  Components are compared by a byte, so different ones agree once in 256."""
    p, below = min(1.0, similarity + (1 - similarity) / 256), 0.0
    for t in range(size + 1):
        below += math.comb(size, t) * p**t * (1 - p) ** (size - t)
        if below > MISSED:
            return t
    return size


def rows_of_bands(similarity: float, size: int = SIZE) -> int:
    """The most components in a band at which a pair of that similarity shares none of size // rows bands once in
    1 / MISSED pairs at most; 1 if there is no such number."""
    return max((r for r in range(1, 9) if (1 - similarity**r) ** (size // r) <= MISSED), default=1)


class Forest:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): node, label (the least node).

    Each round maps a node to its least neighbour's least neighbour (itself counts) and the edges to what their ends
    became, so at least half of the nodes that are left go each round, and the edges with them.  Edges and labels are
    written to the shared folder; a count comes to the driver."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = None
    while True:
        ways = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        up = ways.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        up = materialize(up, f"{name}-up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialize(up.join(over, "up").select("node", F.col("top").alias("label")), f"{name}-step")
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = materialize(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), f"{name}-labels")
        a, b = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(left, f"{name}-edges")
        if edges.isEmpty():
            return labels


Row = tuple[bytes, bytes | None, int]


class Agreement:
    """Links by signatures: two texts are linked if `least` components or more agree."""

    columns = ("marks",)

    def __init__(self, least: int) -> None:
        self.least = least

    def load(self, cols: list[list]) -> np.ndarray:
        return np.frombuffer(b"".join(cols[0]), np.uint8).reshape(len(cols[0]), -1)

    def candidates(self, marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of left and a row of right that may be linked."""
        if len(left) * len(right) <= 4096:
            same = (marks[left][:, None, :] == marks[right][None, :, :]).sum(2)
        else:
            same = np.zeros((len(left), len(right)), np.uint8)
            for c in range(marks.shape[1]):
                same += marks[left, c][:, None] == marks[right, c][None, :]
        x, y = np.nonzero(same >= self.least)
        return left[x], right[y]

    def holds(self, data, a: int, b: int) -> bool:
        return True


class Similarity(Agreement):
    """Links by exact weighted Jaccard similarity of pairs that share a band and agree enough."""

    columns = ("marks", "bands", "shingles", "weights")

    def __init__(self, least: int, similarity: float) -> None:
        super().__init__(least)
        self.num, self.den = Fraction(str(similarity)).as_integer_ratio()

    def load(self, cols: list[list]):
        marks = super().load(cols)
        keys = np.frombuffer(b"".join(cols[1]), np.int64).reshape(len(marks), -1)
        bags = [(np.frombuffer(s, np.uint64), np.frombuffer(w, np.int32)) for s, w in zip(cols[2], cols[3], strict=True)]
        return marks, keys, bags, np.array([int(w.sum()) for _, w in bags])

    def candidates(self, data, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks, keys, _, total = data
        x, y = super().candidates(marks, left, right)
        near = np.minimum(total[x], total[y]) * self.den >= np.maximum(total[x], total[y]) * self.num
        x, y = x[near], y[near]
        shares = np.concatenate([(keys[x[s : s + 65536]] == keys[y[s : s + 65536]]).any(1) for s in range(0, len(x), 65536)] or [np.zeros(0, bool)])
        return x[shares], y[shares]

    def holds(self, data, a: int, b: int) -> bool:
        least, most = weighted_jaccard(data[2][a], data[2][b])
        return least * self.den >= most * self.num


def in_block(linker: Agreement, h: list[bytes], role: np.ndarray, cols: list[list]) -> Iterator[Row]:
    """The links that span a block (a, b, 0) and, if it has pivots (their number is the role, -1 is none), for each
    other text (h, null, bits of the pivots that it is connected with)."""
    data, forest, every = linker.load(cols), Forest(len(h)), np.arange(len(h))
    x, y = linker.candidates(data, every, every)
    for a, b in zip(x[x < y].tolist(), y[x < y].tolist(), strict=True):
        if forest.root(a) != forest.root(b) and linker.holds(data, a, b):
            forest.join(a, b)
            yield h[a], h[b], 0
    if (pivots := np.flatnonzero(role >= 0)).size:
        bits: dict[int, int] = {}
        for i in pivots.tolist():
            bits[forest.root(i)] = bits.get(forest.root(i), 0) | 1 << int(role[i])
        yield from ((h[i], None, bits.get(forest.root(i), 0)) for i in np.flatnonzero(role < 0).tolist())


def between_blocks(linker: Agreement, h: list[bytes], role: np.ndarray, cols: list[list]) -> Iterator[Row]:
    """The links between texts of role 0 and of role 1 that span them."""
    data, forest = linker.load(cols), Forest(len(h))
    for a, b in zip(*(x.tolist() for x in linker.candidates(data, np.flatnonzero(role == 0), np.flatnonzero(role == 1))), strict=True):
        if h[a] != h[b] and forest.root(a) != forest.root(b) and linker.holds(data, a, b):
            forest.join(a, b)
            yield h[a], h[b], 0


def by_group(df: DataFrame, keys: list[str], work: Callable[..., Iterator[Row]], linker: Agreement) -> DataFrame:
    """Deal rows by keys and hand each group of two or more to work: the digests, the roles and the linker's columns.
    A group is bounded by its caller; a task holds one group and one batch.  Returns the first key and what work gives."""
    columns = ["h", "role", *linker.columns]
    schema = df.select(keys[0]).schema.add("a", "binary").add("b", "binary").add("bits", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found = None, None, []

        def settle() -> None:
            if held is not None and len(held[0]) > 1:
                found.extend((last[0], *x) for x in work(linker, held[0], np.array(held[1]), held[2:]))

        def packed(types) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=[keys[0], "a", "b", "bits"])
            found.clear()
            return out

        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            if not len(batch):
                continue
            types[0] = batch.column(0).type
            rows = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True))
            cols = [batch.column(c).to_pylist() for c in columns]
            cuts = [0, *[r for r in range(1, len(rows)) if rows[r] != rows[r - 1]], len(rows)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                own = [c[s:e] for c in cols]
                if rows[s] == last:
                    for h, o in zip(held, own, strict=True):
                        h.extend(o)
                    continue
                settle()
                last, held = rows[s], own
            if found:
                yield packed(types)
        settle()
        if found:
            yield packed(types)

    # a number of partitions: by bytes alone Spark would leave this work to a few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys, *columns).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def connected_with_most(masks: DataFrame, key: str) -> DataFrame:
    """masks: key, masks (list of (bits, count), 2**PIVOTS at most).  Adds most, the pivots of the component with the
    most texts, and rest, the number of texts outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, rest = [], []
            for own in batch.column(1).to_pylist():
                groups: dict[int, int] = {}
                for m in own:
                    bits, count = m["bits"], m["count"]
                    for g in [g for g in groups if g & bits]:
                        bits, count = bits | g, count + groups.pop(g)
                    if bits:
                        groups[bits] = count
                best = max(groups, key=lambda g: (groups[g], g), default=0)
                most.append(best)
                rest.append(sum(m["count"] for m in own) - groups.get(best, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.int32()), pa.array(rest, pa.int64())], names=[key, "most", "rest"])

    return masks.mapInArrow(run, masks.select(key).schema.add("most", "integer").add("rest", "long"))


def links(members: DataFrame, key: str, linker: Agreement, block: int, hot: float, name: str) -> DataFrame:
    """Links (a, b) that connect the texts of each group as all links between two of them would.

    members: key, h, n (the group's texts) and the linker's columns.  Groups of up to block texts are one task's each.
    Others are dealt in blocks with PIVOTS pivots; then the texts outside the component with the most texts meet all."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    extra = list(linker.columns)
    small = members.where(F.col("n") <= block).select(key, F.lit(0).alias("block"), "h", F.lit(-1).alias("role"), *extra)
    large = members.where(F.col("n") > block)
    if large.select(key).isEmpty():
        return by_group(small, [key, "block"], lambda *x: in_block(*x), linker).select("a", "b")
    large = materialize(large, f"{name}-large")
    pivots = large.groupBy(key, "n", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(PIVOTS)).cast("int").alias("role")).agg(F.min(F.struct("h", *extra)).alias("one"))
    pivots = pivots.select(key, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "one.h", "role", *[f"one.{c}" for c in extra])
    dealt = large.select(key, F.pmod(F.xxhash64("h"), blocks).cast("int").alias("block"), "h", F.lit(-1).alias("role"), *extra)
    found = materialize(by_group(small.unionByName(dealt).unionByName(pivots), [key, "block"], lambda *x: in_block(*x), linker), f"{name}-found")
    edges, told = found.where("b is not null").select("a", "b"), found.where("b is null").select(key, F.col("a").alias("h"), "bits")
    masks = told.groupBy(key, "bits").agg(F.count("*").alias("count")).groupBy(key).agg(F.collect_list(F.struct("bits", "count")).alias("masks"))
    open_ = connected_with_most(masks, key).where("rest > 0").join(large.select(key, "n").distinct(), key)
    open_ = materialize(open_.withColumn("size", F.col("n")), f"{name}-open")
    if open_.isEmpty():
        return edges
    outside = matched(told, key, open_, hot).where("(bits & most) = 0").select(key, "h")
    right = matched(large.drop("n"), key, open_, hot)
    first, second = (F.ceil(F.col(c) / block).cast("int") for c in ("rest", "size"))
    left = outside.join(right, [key, "h"]).withColumn("i", F.pmod(F.xxhash64("h"), first).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), second - 1)))
    right = right.withColumn("j", F.pmod(F.xxhash64("h", F.lit(2)), second).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), first - 1)))
    both = left.withColumn("role", F.lit(0)).unionByName(right.withColumn("role", F.lit(1)), allowMissingColumns=True)
    return edges.union(by_group(both, [key, "i", "j"], lambda *x: between_blocks(*x), linker).select("a", "b"))


def labelled_documents(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, h (the digest of its text) and label (the same in a class); h and label are
    null for a document without words."""
    with small_batches(docs.sparkSession):
        return _labelled(docs, similarity, block, id_col, text_col)


def _labelled(docs: DataFrame, similarity: float, block: int, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("text"))
    agree, band_rows = least_agreement(similarity), rows_of_bands(similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts, digests = batch.column("text").to_pylist(), batch.column("h").to_pylist()
            seen: set[bytes] = set()
            none: set[bytes] = set()  # digests of texts without words, of the whole batch like seen
            for part in slices([t or "" for t in texts], SLICE):
                first = [i for i in range(*part.indices(len(texts))) if texts[i] is not None and not (digests[i] in seen or seen.add(digests[i]))]
                bags = shingler.bags([texts[i] for i in first])
                signed = signatures(bags)
                keys, marks = bands(signed, band_rows), (signed.view(np.uint64) >> np.uint64(3)).astype(np.uint8)
                key_of = {i: (keys[k].tolist(), marks[k].tobytes()) for k, i in enumerate(first) if len(bags[k][0])}
                none.update(digests[i] for k, i in enumerate(first) if not len(bags[k][0]))
                own = range(*part.indices(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part],
                        pa.array([None if digests[i] in none else digests[i] for i in own], pa.binary()),
                        pa.array([key_of.get(i, (None, None))[0] for i in own], pa.list_(pa.int64())),
                        pa.array([key_of.get(i, (None, None))[1] for i in own], pa.binary()),
                    ],
                    names=["doc_id", "h", "bands", "marks"],
                )

    signed = materialize(rows.mapInArrow(tidy(sign), "doc_id long, h binary, bands array<long>, marks binary"), "near-signed")

    # 1. buckets of different texts; several tasks may have signed one text
    texts = materialize(signed.where("bands is not null").select("h", "bands", "marks").dropDuplicates(["h"]), "near-texts")
    hot = max(2.0, texts.count() / 1000)  # of 32 bands a text, at most 32,000 have so many texts
    spread = texts.select("h", F.explode("bands").alias("band"))
    buckets = materialize(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("texts", F.col("n")), "near-buckets")
    members = matched(spread, "band", buckets, hot).withColumnRenamed("texts", "n")
    edges = links(members.join(texts.select("h", "marks"), "h"), "band", Agreement(agree), block, hot, "near-buckets")
    clusters = components(edges, "near-clusters")

    # 2. bags of the texts in clusters, each made once
    sizes = clusters.groupBy("label").agg(F.count("*").alias("n")).withColumn("texts", F.col("n"))
    nodes = matched(clusters, "label", sizes, hot).select(F.col("node").alias("h"), F.col("label").alias("cluster"), F.col("texts").alias("n"))
    first_id = signed.groupBy("h").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("one")).select("h", "one.*")
    chosen = materialize(first_id.join(nodes, "h"), "near-chosen")
    keyed = rows.select("h", F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text")
    if chosen.count() <= MOST_KEYS:
        keyed = keyed.join(F.broadcast(chosen.select("h", "no_id", "id")), ["h", "no_id", "id"], "left_semi")
    once = keyed.groupBy("h", "no_id", "id").agg(F.first("text").alias("text"))  # a group has one text
    wanted = once.join(chosen.hint("merge"), ["h", "no_id", "id"]).select("h", "cluster", "n", "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts, SLICE):
                bags = shingler.bags(texts[part])
                signed = signatures(bags)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c)[part] for c in ("h", "cluster", "n")],
                        pa.array([k.tobytes() for k in bands(signed, band_rows)], pa.binary()),
                        pa.array([m.tobytes() for m in (signed.view(np.uint64) >> np.uint64(3)).astype(np.uint8)], pa.binary()),
                        pa.array([s.tobytes() for s, _ in bags], pa.binary()),
                        pa.array([w.astype(np.int32).tobytes() for _, w in bags], pa.binary()),
                    ],
                    names=["h", "cluster", "n", "bands", "marks", "shingles", "weights"],
                )

    bagged = wanted.mapInArrow(tidy(bag), "h binary, cluster binary, n long, bands binary, marks binary, shingles binary, weights binary")
    if not sizes.where(F.col("n") > block).isEmpty():
        bagged = materialize(bagged, "near-bags")
    classes = components(links(bagged, "cluster", Similarity(agree, similarity), block, hot, "near-clusters"), "near-classes")

    return signed.select("doc_id", "h").join(classes.withColumnRenamed("node", "h"), "h", "left").select("doc_id", "h", F.coalesce("label", "h").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of its class) and class_size (documents).

    A class is a connected component of documents by links: equal texts, or bags of 5-word shingles (words as they
    are, a shorter text is one shingle) with a weighted Jaccard similarity of `similarity` or more.  A link is lost
    only where signatures fail a pair, about one in five million at that similarity and far fewer above; the rows of
    a band and the agreement asked for follow from it.  Defined cases: a document without words (null, empty) is in no
    class: its class_id is its own doc_id and class_size 1; null doc_ids take part and count, but are never a class_id
    unless the class has no other; repeated rows are copies of each other; an empty table gives an empty result; other
    columns are ignored."""
    labelled = labelled_documents(docs, similarity, block, id_col, text_col)
    named = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    grouped = labelled.where("label is not null").join(named.hint("merge"), "label").select("doc_id", "class_id", "class_size")
    return grouped.union(labelled.where("label is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of docs without the near copies of others, with the columns of docs, whatever these are called.

    Of each class one row stays, with the least doc_id (null after all others) and of those the least digest of the
    text.  Rows are told apart by doc_id, null too, and text: of several with both the same one stays, which one is
    decided by a hash of all columns.  Rows without words are in no class, so of these all with different ids stay.  An
    empty table gives an empty one.  Only rows that may be repeated are shuffled if the keys of those and of the rows
    that go are few enough to broadcast, else all once, after equal rows of a task have become one."""
    labelled = labelled_documents(docs, id_col=id_col, text_col=text_col, **options)
    key = ["no_id", "id", "h"]
    known = labelled.where("label is not null").select("label", F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    copies = materialize(known.groupBy("label", *key).agg(F.count("*").alias("n")), "near-copies")
    stays = materialize(copies.groupBy("label").agg(F.min(F.struct(*key, "n")).alias("one")).select("one.*"), "near-kept")
    text, doc_id = docs[text_col].cast("string"), docs[id_col].cast("long")
    hashed = [docs[f.name] for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("h"),
        F.coalesce(text.rlike(WORD), F.lit(False)).alias("words"),
        F.xxhash64(*hashed).alias("order"),
    )
    one = lambda df: df.groupBy(*key, "words").agg(F.min_by("row", "order").alias("row"))
    gone = copies.select(*key).join(stays.select(*key), key, "left_anti")
    repeated = stays.where("n > 1").select(*key)
    if gone.count() + repeated.count() > MOST_KEYS:
        joined = one(rows).join(stays.select(*key, F.lit(True).alias("stays")).hint("merge"), key, "left")
        return joined.where("not words or stays").select("row.*")
    worded = rows.where("words")
    single = worded.join(F.broadcast(gone.union(repeated)), key, "left_anti")
    several = worded.join(F.broadcast(repeated), key, "left_semi").unionByName(rows.where("not words"))
    return single.select("row.*").union(one(several).select("row.*"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
b AS (SELECT r, g, count(*) AS n FROM s GROUP BY r, g),
t AS (SELECT r, sum(n) AS total FROM b GROUP BY r),
p AS (SELECT a.r AS x, c.r AS y, sum(least(a.n, c.n)) AS shared FROM b a JOIN b c ON a.g = c.g AND a.r < c.r GROUP BY a.r, c.r),
e AS (SELECT x, y FROM p JOIN t tx ON tx.r = x JOIN t ty ON ty.r = y WHERE 5 * shared >= 4 * (tx.total + ty.total - shared)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT r, r AS o FROM t UNION SELECT c.r, u.y FROM c JOIN u ON c.o = u.x),
l AS (SELECT r, min(o) AS root FROM c GROUP BY r),
k AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_size FROM l JOIN d USING (r) GROUP BY root)
SELECT doc_id, CASE WHEN root IS NULL THEN doc_id ELSE class_id END AS class_id, CAST(coalesce(class_size, 1) AS BIGINT) AS class_size FROM d LEFT JOIN l USING (r) LEFT JOIN k USING (root)
"""
