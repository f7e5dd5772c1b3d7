"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, matched, materialize


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, remove, and the tightest bin that holds a size, in O(log bins)."""

    __slots__ = ("root", "state")

    def __init__(self) -> None:
        self.root = None
        self.state = 0x9E3779B97F4A7C15

    def _priority(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        return self.state >> 20

    def _split(self, node, key):
        """Nodes below key, and the others; a node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._priority(), None, None]), high)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key whose capacity is at least size (ties: the lowest bin)."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Bins of a fixed capacity: items by falling size, each into the bin with the least room that still holds it (ties:
    the lowest bin), a new bin where none does.  sizes: (size, items of that size).  Returns runs (size, items, bin) in
    the order in which they are placed, or None once more than `most` bins are needed.

    After an item the tightest bin is tighter still, so of equal items it takes all that it has room for: a run is what
    placing them one by one gives.  An item above the capacity gets a bin of its own."""
    tree, bins, runs = CapacityTree(), 0, []
    for size, n in sorted(sizes, reverse=True):
        while n:
            found = tree.pop_tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            room, name = found
            k = min(n, room // size)
            runs.append((size, k, name))
            tree.insert((room - k * size, name))
            n -= k
    return runs


def pack_into(sizes: list[tuple[int, int]], shards: int, steps: int = 14) -> list[tuple[int, int, int]]:
    """Runs (size, items, bin) in `shards` bins.  Items above an even share of what is left, largest first, get a bin
    each; the others get the least capacity, to a ten-thousandth, at which best-fit-decreasing needs no more than the
    bins that are left."""
    sizes, left, alone = sorted(sizes, reverse=True), sum(s * n for s, n in sizes), []
    while sizes and sizes[0][0] * (shards - len(alone)) > left:
        size, n = sizes[0]
        alone.append((size, 1, len(alone)))
        left -= size
        sizes = [(size, n - 1), *sizes[1:]] if n > 1 else sizes[1:]
    shards -= len(alone)
    if not sizes:
        return alone
    low = max(-(-left // shards), sizes[0][0])
    best, high = best_fit_decreasing(sizes, low, shards), low
    step = max(1, low // 2000)
    while best is None:
        high = low + step
        best, step = best_fit_decreasing(sizes, high, shards), step * 4
    for _ in range(steps):
        if high - low <= max(1, high // 10_000):
            break
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, shards)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return alone + [(size, n, len(alone) + b) for size, n, b in best]


def shard_documents(docs: DataFrame, shards: int = 16, cell: int = 50_000, most_broadcast: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of docs into a shard so that shards hold near equal bytes and equal texts stay together.

    Size: UTF-8 bytes plus 1.  Groups of equal texts are packed by best-fit-decreasing, every one of them.  The packer
    on the driver sees how many groups there are of each size: different sizes add up to at most all bytes, so there
    are at most the square root of twice that many of them (14 million at 100 TB if every length up to there occurs).
    Of the groups of one size each shard gets a run, in the order of the texts' digests.  The plan, a row for each size,
    is broadcast only if it has at most most_broadcast rows.  Ranks and slots are counted within cells of about `cell`
    rows and shifted by counts of the cells before, so that no task numbers a whole shard, a size or a hot group.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).  Defined cases: a null text has
    no bytes (size 1, crc32 0) and groups with other null texts, not with empty ones; null and repeated doc_ids and
    wholly repeated rows each keep their own slot; an empty table gives an empty result; other columns are ignored.
    """
    spark, text = docs.sparkSession, docs[text_col]
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("g"),  # null before all others
    )
    # equal rows become one with a count: a repeated row is no hot key below
    rows = materialize(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("m")), "shard-rows")
    groups = materialize(rows.groupBy("g").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"), F.sum("m").alias("n")), "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups")).toArrow()
    runs = pack_into(list(zip(sizes.column("bytes").to_pylist(), sizes.column("groups").to_pylist(), strict=True)), shards)
    total = groups.agg(F.sum("n")).first()[0] or 0

    plan: dict[int, tuple[list[int], list[int]]] = {}
    for size, n, shard in runs:
        ends, names = plan.setdefault(size, ([], []))
        ends.append((ends[-1] if ends else 0) + n)
        names.append(shard)
    made = pa.table(
        {"bytes": pa.array(plan, pa.int64()), "ends": pa.array([e for e, _ in plan.values()], pa.list_(pa.int64())), "names": pa.array([n for _, n in plan.values()], pa.list_(pa.int32()))}
    )
    of_size = spark.createDataFrame(made).withColumn("cells", F.ceil(F.element_at("ends", -1) / cell))
    placed = groups.join(F.broadcast(of_size) if len(plan) <= most_broadcast else of_size, "bytes")
    leading = F.coalesce(F.conv(F.hex(F.substring("g", 1, 4)), 16, 10).cast("long"), F.lit(0))
    placed = placed.withColumn("cell", F.floor(leading * F.col("cells") / F.lit(1 << 32)))  # rises with g
    in_cells = placed.where("cells > 1").groupBy("bytes", "cell").agg(F.count("*").alias("groups"))
    earlier = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = in_cells.select("bytes", "cell", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("g")) - 1
    ranked = placed.withColumn("rank", rank).join(bases, ["bytes", "cell"], "left").withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0)))
    run = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    of_group = materialize(ranked.select("g", "n", F.get("names", run).alias("shard")), "shard-placed")

    # groups of a ten-thousandth of all rows or more are broadcast; no other key is hot
    slots_cells = max(1, -(-total // cell))
    put = matched(rows, "g", of_group, max(2, total / 10_000)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "g"), F.lit(slots_cells)))
    counts = put.groupBy("shard", "cell").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "g").rowsBetween(Window.unboundedPreceding, -1)
    numbered = put.withColumn("done", F.coalesce(F.sum("m").over(within), F.lit(0))).join(starts, ["shard", "cell"])
    return expand(numbered, F.col("m"), "k").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("done") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
