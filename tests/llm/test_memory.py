"""What a worker holds at once: numpy tells tracemalloc of its arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa

from predspark.llm import bag_minhash, common, near_duplicates, suffix_tree

from .conftest import prose


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def drawn(n):
    return np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_symbols_are_read_in_small_pieces():
    texts = [" ".join(f"word{i * j % 977}" for j in range(2000)) for i in range(1, 301)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = []
    assert peak_mb(lambda: rows.extend(part.num_rows for part, _, _ in suffix_tree.symbols_in([batch]))) < 30  # 65 before
    assert sum(rows) == 300


def test_counts_are_summed_a_column_at_a_time():
    counts, key, got = suffix_tree.Counts(), drawn(450_000), []

    def work():
        for _ in range(2):
            for s in range(0, len(key), 90_000):
                assert counts.add(key[s : s + 90_000], key[s : s + 90_000] + np.uint64(1), key[s : s + 90_000] + np.uint64(2)) is None
        got.extend(counts.rest(2))

    assert peak_mb(work) < 85
    assert (got[0] == np.sort(key)).all() and (got[1] == 2).all() and (got[2] == got[0] + np.uint64(1)).all() and (got[3] == got[0] + np.uint64(2)).all()
    assert [len(x) for x in counts.rest(2)] == [0, 0, 0, 0]


def test_signatures_are_drawn_in_small_groups():
    key = drawn(1_200_000)
    bags = [(np.sort(key[s : s + 20_000]), np.ones(20_000, np.int64)) for s in range(0, len(key), 20_000)]
    out = []
    assert peak_mb(lambda: out.append(bag_minhash.signatures(bags))) < 30  # 86 before
    assert (out[0][7] == bag_minhash.signatures(bags[7:8])[0]).all()


def test_workers_get_small_batches(spark, monkeypatch):
    seen = []

    def noted(df, name, _f=near_duplicates.materialize):
        seen.append(spark.conf.get(common.BATCHES))
        return _f(df, name)

    monkeypatch.setattr(near_duplicates, "materialize", noted)
    monkeypatch.setattr(suffix_tree, "materialize", noted)
    before = spark.conf.get(common.BATCHES, "64m")
    df = spark.createDataFrame([(k, prose(k % 5)) for k in range(40)], "doc_id long, text string")
    assert near_duplicates.near_duplicates(df).where("class_size = 8").count() == 40
    assert suffix_tree.score_documents(df).count() == 40
    assert seen and set(seen) == {str(common.BATCH_BYTES)}
    assert spark.conf.get(common.BATCHES) == before
