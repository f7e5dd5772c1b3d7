"""Arrays dealt to buckets: a row of a shuffle is a bucket's share of a task's arrays, not one entry.

The JVM then moves and sorts a few rows, and the tasks on both sides work on whole arrays.  A bucket's share of all
tasks has to fit a worker, so the number of buckets follows the entries; tasks see one bucket at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: Entries of a bucket, about; entries that a task gathers before it deals them.
BUCKET_ENTRIES, GATHERED = 1_000_000, 400_000

SCHEMA = "bucket int, kind int, payload binary"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each with its type and length before it."""
    out = []
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        dtype, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, dtype, n, at + 12))
        at += 12 + n * dtype.itemsize
    return out


def small(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


def ordered(key: np.ndarray) -> np.ndarray:
    """The stable order of keys that are hashes: numpy sorts values faster than places, so a place takes the lower bits
    of its key, and where that leaves keys out of order they are sorted as they are."""
    low = np.uint64((1 << len(key).bit_length()) - 1)
    order = (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)
    now = key[order]
    return order if (now[1:] >= now[:-1]).all() else np.argsort(key, kind="stable")


def grouped(group: np.ndarray, groups: int, key: np.ndarray) -> np.ndarray:
    """An order by group (below groups), within which equal keys are mostly neighbours: by as many upper bits of the key
    as there is room for."""
    top, low = groups.bit_length(), len(key).bit_length()
    x = group.astype(np.uint64) << np.uint64(64 - top) | np.arange(len(key), dtype=np.uint64)
    if (room := 64 - top - low) > 0:
        x |= key >> np.uint64(64 - room) << np.uint64(low)
    return (np.sort(x) & np.uint64((1 << low) - 1)).astype(np.int64)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sums of n."""
    order = ordered(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key[first], order[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def runs(x: np.ndarray) -> list[np.ndarray]:
    """Values of a column with equal neighbours, and how often each comes."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))[: len(x)]
    return [x[first], small(np.diff(np.append(first, len(x))))]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def deal(bucket: np.ndarray, kind: int, columns: list[np.ndarray], encode: Callable[[list[np.ndarray]], list[np.ndarray]] = list) -> pa.RecordBatch:
    """A row for each bucket that has entries; entries keep their order within it."""
    names, first = np.unique(bucket, return_index=True) if (np.diff(bucket) >= 0).all() else (None, None)
    if names is None:
        order = np.sort(bucket.astype(np.int64) << 32 | np.arange(len(bucket))) & 0xFFFFFFFF
        columns = [c[order] for c in columns]
        names, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(bucket))
    payload = [pack(encode([c[s:e] for c in columns])) for s, e in zip(ends, ends[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), kind, np.int32)), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])


def by_bucket(dealt: DataFrame, work: Callable[[int, Iterator[tuple[int, list[np.ndarray]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hand each bucket, with its (kind, arrays) by rising kind, to work."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for k in range(len(batch)):
                    yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()

        stream = entries()
        ahead = [next(stream, None)]

        def own(bucket: int) -> Iterator[tuple[int, list[np.ndarray]]]:
            while ahead[0] is not None and ahead[0][0] == bucket:
                _, kind, payload = ahead[0]
                yield kind, unpack(payload)
                ahead[0] = next(stream, None)

        while ahead[0] is not None:
            bucket = ahead[0][0]
            mine = own(bucket)
            yield from work(bucket, mine)
            for _ in mine:
                pass

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidy(run), schema)
