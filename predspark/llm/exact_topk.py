"""Exact top-k search by integer inner product: a KD-tree per shard, best first, with a kth score that is passed on."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard, for which one tree is built; queries that are searched together.
TREE_ROWS, QUERY_BLOCK, LEAF = 16_384, 16_384, 256
LONG = (1 << 63) - 1


class KDTree:
    """Rows split at the median of the widest side until a node has `leaf` rows; every node has its tight box."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int]] = [(0, len(x), 0)]  # start, end, first child (the other follows it); 0: a leaf
        low, high = [], []
        at = 0
        while at < len(self.nodes):
            s, e, _ = self.nodes[at]
            rows = x[order[s:e]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            side = int(np.argmax(high[-1] - low[-1])) if x.shape[1] else 0
            if e - s > leaf and x.shape[1] and high[-1][side] > low[-1][side]:
                m = (e - s) // 2
                order[s:e] = order[s:e][np.argpartition(rows[:, side], m)]
                self.nodes[at] = (s, e, len(self.nodes))
                self.nodes += [(s, s + m, 0), (s + m, e, 0)]
            at += 1
        self.order, self.x = order, x[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, the most that an inner product with a point of the box can be."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


class TopK:
    """The k best (score, id) of one query so far: higher scores first, then smaller ids."""

    __slots__ = ("bound", "ids", "k", "scores")

    def __init__(self, k: int, bound: float) -> None:
        self.k, self.bound = k, bound  # no score below the bound can be among the k best
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bound
        if not good.any():
            return
        s, i = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        best = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[best], i[best]
        if len(best) == self.k:
            self.bound = max(self.bound, self.scores[-1])


def search(tree: KDTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: list[TopK]) -> None:
    """Offer the rows of a tree to each query, nodes with the highest bound first, until none can reach the kth score."""
    for s in range(0, len(queries), 512):
        bounds = tree.bounds(queries[s : s + 512])
        for k, q in enumerate(queries[s : s + 512]):
            own, bound, top = query_ids[s + k], bounds[k], best[s + k]
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= top.bound:
                start, end, child = tree.nodes[heapq.heappop(heap)[1]]
                if child:
                    for c in (child, child + 1):
                        if bound[c] >= top.bound:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                found, at = tree.x[start:end] @ q, ids[tree.order[start:end]]
                other = at != own
                top.offer(found[other], at[other])


class ExactTopK:
    """As TopK, for scores beyond what doubles hold: whole numbers, which stop at the limits of long."""

    __slots__ = ("best", "bound", "k")

    def __init__(self, k: int) -> None:
        self.k, self.best, self.bound = k, [], -math.inf

    def offer(self, scores: list[int], ids: list[int]) -> None:
        self.best = heapq.nsmallest(self.k, [*self.best, *((-max(-LONG - 1, min(LONG, s)), i) for s, i in zip(scores, ids, strict=True))])

    def kth(self) -> int | None:
        return -self.best[-1][0] if len(self.best) == self.k else None


def exact_search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: list[ExactTopK]) -> None:
    """search() for components whose products doubles do not hold.  Rows and queries are scaled by powers of two to at
    most 1, the tree's bounds and the scores of a leaf are then off by less than `slack`, and what comes within it of
    the kth score is computed anew in whole numbers."""
    if not len(x):
        return
    up, up_q = (math.frexp(float(np.abs(v).max()) or 1.0)[1] for v in (x, queries))
    scaled, q_scaled = np.ldexp(x, -up), np.ldexp(queries, -up_q)
    tree, slack = KDTree(scaled), 4.0 * (x.shape[1] + 1) ** 2 * 2.0**-52
    for k, q in enumerate(q_scaled):
        own, top, whole = query_ids[k], best[k], [int(c) for c in queries[k].tolist()]
        bound, kth = tree.bounds(q[None])[0], -math.inf
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] + slack >= kth:
            start, end, child = tree.nodes[heapq.heappop(heap)[1]]
            if child:
                for c in (child, child + 1):
                    if bound[c] + slack >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            rows = tree.order[start:end]
            rows = rows[(ids[rows] != own) & (tree.x[start:end] @ q + slack >= kth)]
            top.offer([sum(a * int(b) for a, b in zip(whole, r, strict=True)) for r in x[rows].tolist()], ids[rows].tolist())
            if (least := top.kth()) is not None:
                kth = math.ldexp(float(least), -up - up_q) - slack


def usable(vector: Column) -> Column:
    """Not null, and all components finite, 1024 times as large too."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x * 1024) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))


def vectors(batch_ids, batch_vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(1024 * x)) for each length that vectors of a batch have."""
    ids = batch_ids.to_numpy(zero_copy_only=False)
    flat = np.floor(1024 * batch_vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.append(0, np.cumsum(batch_vectors.value_lengths().to_numpy(zero_copy_only=False)))
    lengths = np.diff(ends)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], flat[ends[rows][:, None] + np.arange(d)]


def exact_in_double(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all sums of products stay below 2**53, where doubles hold every integer."""
    return not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row of the table, the k rows (but itself) with the highest inner product of floor(1024 * x).

    Queries go in blocks of about query_block rows, so what is broadcast is bounded at any size; a block starts with
    the kth score among its own queries as a bound.  Each task reads its part of the table once a block, a tree for
    every tree_rows rows, and passes the kth scores on from tree to tree.  At most k rows a query and task are
    shuffled, and merged by a window over the query.  With more than one block, each block's result is written to the
    shared folder before the next starts.

    Returns query_id, rank (from 1), vec_id, score.  Ties go to the smaller vec_id.  Defined cases: rows with a null
    id or a null vector, or with null or non-finite components (times 1024 too), take no part; vectors meet only vectors of their own
    length; rows with the query's vec_id are its own; of several query rows with one id the least vector is the query;
    repeated other rows are listed each; scores stop at the limits of long; other columns are ignored."""
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    queries = materialize(rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    everything = rows.select("vec_id", "v")
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    done = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        found = search_block(everything, part, k, tree_rows)
        done.append(materialize(found, "topk-block") if blocks > 1 else found)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def search_block(everything: DataFrame, part: pa.Table, k: int, tree_rows: int) -> DataFrame:
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if len(part):
        part = part.combine_chunks()
        for ids, q in vectors(part.column("vec_id").chunk(0), part.column("v").chunk(0)):
            bound = np.full(len(ids), -np.inf)
            if len(ids) > k and exact_in_double(q, q):
                for s in range(0, len(ids), 1024):
                    scores = q[s : s + 1024] @ q.T
                    scores[np.arange(len(scores)), s + np.arange(len(scores))] = -np.inf
                    bound[s : s + 1024] = np.partition(scores, -k, axis=1)[:, -k]
            by_length[q.shape[1]] = (ids, q, bound)
    shared = everything.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[TopK]] = {}
        held: dict[int, list] = {}
        exact: dict[int, list[ExactTopK]] = {}

        def settle(d: int) -> None:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(d), strict=True))
            query_ids, q, bound = shared.value[d]
            if not exact_in_double(q, x):
                exact_search(x, ids, q, query_ids, exact.setdefault(d, [ExactTopK(k) for _ in query_ids]))
                return
            tops = best.setdefault(d, [TopK(k, b) for b in bound])
            search(KDTree(x), ids, q, query_ids, tops)

        for batch in batches:
            for ids, x in vectors(batch.column(0), batch.column(1)):
                if (d := x.shape[1]) in shared.value:
                    held.setdefault(d, []).append((ids, x))
                    if sum(len(i) for i, _ in held[d]) >= tree_rows:
                        settle(d)
        for d in list(held):
            settle(d)
        for d, tops in best.items():
            query_ids = np.repeat(shared.value[d][0], [len(t.ids) for t in tops])
            yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(np.concatenate([t.ids for t in tops])), pa.array(np.concatenate([t.scores for t in tops]).astype(np.int64))], names=["query_id", "vec_id", "score"])
        for d, tops in exact.items():
            found = [(own, i, -s) for own, t in zip(shared.value[d][0].tolist(), tops, strict=True) for s, i in t.best]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = everything.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
