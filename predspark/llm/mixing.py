"""Mixing sources to target weights: blocks of words, slots per output shard, index permutations.  DataFrame only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, expand, global_prefix, materialize

ROUNDS = 10


def permuted(x: Column, n: Column, seed: int, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 keyed by seed and key, for any n: swap-or-not rounds, each an involution."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit(seed + 1), r, *key, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> tuple[DataFrame, dict]:
    """sources: source (null allowed), source_size.  Adds sid (rank by code point, null last), weight and target.

    Targets share the sum of sizes by weight; one above `most` times its source's size stops there and the excess is
    shared again by weight until none is above.  That is one level, target = least(level * weight, most * size), found
    in a few passes that each bring three numbers to the driver."""
    ranked = global_prefix(sources, [F.col("source").asc_nulls_last()], {}, "sid", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(most)
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, stopped = float(total or 0), (float(total or 0) / weight_sum if weight_sum else 0.0), 0
    while weight_sum:
        over = F.lit(level) * F.col("weight") > cap
        n, held, rest = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not rest:
            break
        stopped, level = n, (total - (held or 0.0)) / rest
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap)), {"total": total, "level": level}


def what_mix_sees(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """doc_id, source and size of each row."""
    size = F.coalesce(F.size(F.array_remove(F.split(docs[text_col], GAP), "")), F.lit(0)).cast("long")
    return [docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size")]


def draw_counts(planned: DataFrame, all_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """How many slots of each output shard a source gets: planned has sid, blocks, slots and first_slot.

    The labels of all slots are permuted and cut into shards of shard_slots; a shard's counts are thereby a multinomial
    draw without replacement, so those of a source add up to its slots.  Returns sid, blocks, shard, count and first:
    the source's slots in all shards before.  Summed in two levels, so that no task sees all shards of a source."""
    # a number of partitions: by their estimated size, which an explode does not raise, Spark would run all in one task
    chunk = 16384
    starts = planned.where("slots > 0").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long"))))
    starts = starts.select("sid", "blocks", "slots", "first_slot", "from").repartition(int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "from")
    labels = starts.withColumn("label", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + chunk, F.col("slots")) - 1)))
    place = permuted(F.col("first_slot") + F.col("label"), F.lit(all_slots).cast("long"), seed)
    counts = labels.select("sid", "blocks", F.floor(place / shard_slots).alias("shard")).groupBy("sid", "blocks", "shard").agg(F.count("*").alias("count"))
    counts = materialize(counts.withColumn("run", F.floor(F.col("shard") / 1024)), "mix-draws")
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("sid", "run").agg(F.sum("count").alias("count")).select("sid", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("count").over(within), F.lit(0)))
    return counts.join(runs, ["sid", "run"]).select("sid", "blocks", "shard", "count", (F.col("base") + F.col("inner")).alias("first"))


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 4096, seed: int = 20, most: int = 3, weights: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Mix all documents to target weights.  Returns (documents, slots).

    The words of a source, its documents laid end to end, are packed into blocks of `block` words.  The output is a
    row of shards with `shard_slots` slots each.  For each shard the slots of each source are drawn: multinomial counts
    under the condition that a source's counts add up to its target (so that each target is met to half a block and no
    document can pass `most` times its size).  A shard's slots of a source are the source's slots first, first + 1, ...;
    slot j of a source takes block p(j mod K) of its K blocks, p a permutation that is drawn anew for each pass over the
    source, so the passes differ in order and none repeats a block.  Documents get their words from the shards' slots
    by a join on (source, block).

    documents: doc_id, size, source, source_size, target, taken.  slots: sid, shard, j, block.
    Running sums are taken in two levels (hash buckets of about sqrt(rows) rows, then bucket totals), so a source with
    a third of all rows is spread over many tasks.  Defined cases: null text has size 0 and takes 0; null source is a
    source, last; null doc_ids are kept; a repeated row is a document of its own; an empty table gives empty tables;
    other columns are ignored.
    """
    raw = docs.select(*what_mix_sees(docs, id_col, text_col, source_col))
    rows = materialize(raw.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"))
    targets, _ = source_targets(sums, weights, float(most))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    slots_of = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.lit(most) * F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    planned = targets.withColumn("blocks", blocks).withColumn("slots", slots_of)
    planned = materialize(global_prefix(planned, [F.col("sid")], {"first_slot": "slots"}, "_rank", "mix-plan").drop("_rank"), "mix-planned")
    all_slots = planned.agg(F.sum("slots")).first()[0] or 0

    draws = draw_counts(planned, all_slots, shard_slots, seed)
    shard_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = draws.repartition(shard_parts, "shard", "sid").withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    passed = F.floor(F.col("j") / F.col("blocks"))
    slots = slots.select("sid", "shard", "j", permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), seed + 2, F.col("sid"), passed).alias("block"))
    drawn = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))

    # where each document lies among the words of its source
    buckets = max(1, round((rows.count()) ** 0.5))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    ids = planned.select(key.alias("key"), "sid", "source_size", "target")
    cells = rows.withColumn("key", key).join(ids, "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    words = F.col("size") * F.col("m")
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.groupBy("sid", "bucket").agg(F.sum(words).alias("words")).select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    laid = cells.withColumn("inner", F.coalesce(F.sum(words).over(within), F.lit(0))).join(bases, ["sid", "bucket"])
    single = expand(laid, F.col("m"), "copy").withColumn("start", F.col("base") + F.col("inner") + F.col("copy") * F.col("size"))
    single = single.select("doc_id", "source", "sid", "size", "copy", "source_size", "target", "start")
    reach = single.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    got = reach.withColumn("words", overlap).join(drawn.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # a document that has words is alone at its start
    have = single.withColumn("_at", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))))
    out = have.join(got.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken").hint("merge"), (F.col("sid") == F.col("_sid")) & (F.col("_at") == F.col("_start")), "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), slots


def mixed_documents(docs: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents, with the columns of docs: a document of which the mix takes t words of n comes
    t / n times, a fraction being rounded by a draw from its id, so sources keep near their targets and no document
    comes more than three times.  Rows that mix() cannot tell apart (equal doc_id, null too, source and size) share
    what it takes of them evenly, with a draw for each row."""
    taken, _ = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    shares = taken.where("size > 0").groupBy("doc_id", "source", "size").agg((F.sum("taken") / (F.count("*") * F.col("size"))).alias("share"), F.count("*").alias("m")).where("share > 0")
    shares = shares.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "share", "m")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *what_mix_sees(docs, id_col, text_col, source_col), F.monotonically_increasing_id().alias("_n"))
    joined = rows.join(shares, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    at = F.when(F.col("m") == 1, F.xxhash64(F.lit(seed), F.col("doc_id"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_n")))
    draw = F.pmod(at, F.lit(1_000_003)) / F.lit(1_000_003.0)
    copies = joined.select("_row", F.floor(F.col("share") + draw).alias("_copies")).where("_copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
