"""Helpers shared by the corpus operators: shared folders, materialisation, words, global prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predspark.folders import shared_root
from predspark.shipping import ship_package

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_cleaned: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one of this application's own that goes when the driver ends."""
    own = f"{shared_root(spark)}/predspark/{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_remove, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(uri: str) -> None:
    with contextlib.suppress(Exception):  # another user may clean the shared folder too
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch for Python workers, of which the JVM and the worker hold several copies in several forms.
BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here hand batches of about BATCH_BYTES to Python, whole rows of any size."""
    before = spark.conf.get(BATCHES, "64m")
    spark.conf.set(BATCHES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """What run makes of a task's batches; what it held goes back to the system when it ends, as workers are kept."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return whole


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str, name: str) -> DataFrame:
    """Add an exclusive running sum per entry of sums (new column: summed column) and a row number from 0, over the
    order of the whole table, without one task that sees all rows: ranges, then sums within and before each range."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    # one row per range: at most spark.sql.shuffle.partitions rows
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in ["n", *sums]])
    within = Window.partitionBy("_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", (F.row_number().over(within) - 1).cast("long").alias("_i"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_s_{k}") for k, c in sums.items()])
    out = out.join(F.broadcast(bases), "_range")
    keep = [c for c in df.columns]
    return out.select(*keep, (F.col("_b_n") + F.col("_i")).alias(rank), *[(F.col(f"_b_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])


def expand(df: DataFrame, count: Column, index: str, chunk: int = 65536) -> DataFrame:
    """One row for each index 0 .. count-1 of a row, made in chunks so that no task or array holds a hot row's all."""
    pieces = df.withColumn("_count", count).where("_count > 0").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(chunk).cast("long"))))
    return pieces.withColumn(index, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_count")) - 1))).drop("_count", "_from")


def matched(rows: DataFrame, key: str, table: DataFrame, hot: float) -> DataFrame:
    """Inner join with table (key, n, ...), of which rows with n >= hot, of a bounded number, are broadcast: n bounds
    the rows that share a key."""
    large = table.where(F.col("n") >= hot).drop("n")
    small = table.where(F.col("n") < hot).drop("n")
    near = rows.join(F.broadcast(large), key)
    far = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small.hint("shuffle_hash"), key)
    return near.unionByName(far)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["GAP", "WORD", "expand", "global_prefix", "matched", "materialize", "shared_path", "shared_root", "ship_package", "small_batches", "table", "tidy"]
