import hashlib
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from predspark.llm import bag_minhash, bpe, mixing, near_duplicates, queries, sharding, token_counts, token_index

from .conftest import prose

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


# op5


def test_perfect_hash_is_perfect():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 20_000, np.uint64))
    mph = token_index.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    part = token_index.IndexPart(token_index.pack_index(keys, np.zeros(len(keys)), np.arange(len(keys)), keys.astype(np.int64) % 97))
    found, _, first, n = part.find(keys[::7])
    assert found.all() and (first == np.arange(len(keys))[::7]).all() and (n == keys[::7].astype(np.int64) % 97).all()
    assert not part.find(keys[:2000] + np.uint64(1))[0].any()
    assert not token_index.IndexPart(token_index.pack_index(keys[:0], keys[:0], keys[:0], keys[:0])).find(keys[:3])[0].any()


def test_ids_come_back_from_files(spark, odd, docs):
    tokenizer = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        folder = token_index.write_corpus(df, WORD, end_id=1, part_keys=40)
        got = token_index.read_documents(spark, folder, token_index.stored_keys(spark, folder)).collect()
        want = defaultdict(list)
        for r in df.collect():
            want[r["doc_id"]].append(tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]))
        have, at = defaultdict(list), 0
        for r in sorted(got, key=lambda r: (*key(r), r["ordinal"])):
            ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
            assert r["start"] == at
            at += len(ids)
            have[r["doc_id"]].append(ids)
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
        absent = spark.createDataFrame([(999_999, 0)], "doc_id long, ordinal long")
        assert token_index.read_documents(spark, folder, absent).count() == 0
        manifest = json.loads(token_index.read_file(f"{folder}/manifest.json"))
        assert manifest["dtype"] == "<u2" and manifest["ids"] == at


def test_an_id_that_many_rows_share_spreads_over_shards(spark):
    """Null and one doc_id with 300 rows each: several shards, and ordinals that count on from shard to shard."""
    rows = [(None, f"null {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = token_index.write_corpus(df, WORD, end_id=1, part_keys=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = token_index.stored_keys(spark, folder)
    assert {(r["doc_id"], r["ordinal"]) for r in keys.collect()} == {(None, i) for i in range(300)} | {(7, i) for i in range(301)} | {(i, 0) for i in range(20)}
    assert len(json.loads(token_index.read_file(f"{folder}/manifest.json"))["starts"]) >= 3
    got, at = token_index.read_documents(spark, folder, keys).collect(), 0
    for r in sorted(got, key=lambda r: (*key(r), r["ordinal"])):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert len(got) == 620


def test_no_documents_make_no_shards(spark, none):
    folder = token_index.write_corpus(none, WORD)
    assert token_index.read_documents(spark, folder, token_index.stored_keys(spark, folder)).count() == 0


# op6


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def bag(text):
    w = (text or "").encode().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def test_signatures_estimate_weighted_jaccard():
    a = "a b c d e " * 30 + prose(1, 80)
    b = "a b c d e " * 12 + prose(1, 80) + " " + prose(2, 20)
    bags = bag_minhash.Shingler().bags([a, b])
    sig = bag_minhash.signatures(bags, 4096)
    want = weighted(bag(a), bag(b))
    assert np.isfinite(sig).all() and (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)
    least, most = bag_minhash.weighted_jaccard(*bags)
    assert least / most == pytest.approx(want)
    assert (bag_minhash.signatures([bags[1]], 4096) == sig[1]).all()  # alone or among others


def brute_classes(rows):
    up = {i: i for i in range(len(rows))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
                up[max(root(i), root(j))] = min(root(i), root(j))
    classes = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[root(i)].append(d)
    return sorted((d, min((x for x in c if x is not None), default=None), len(c)) for c in classes.values() for d in c if d is not None)


@pytest.mark.parametrize("block", [512, 4])
def test_classes_match_brute_force(spark, block):
    r = random.Random(1)
    rows = []
    for base in range(6):
        words = prose(base, 100).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, prose(100 + i)) for i in range(10)] + [(500, rows[0][1]), (501, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_duplicates.near_duplicates(df, block=block).collect()))
    assert got == brute_classes(rows)


def test_one_text_in_many_batches_is_one_text(spark, monkeypatch):
    """400 copies of a text, dealt over batches of 20 rows, and a near copy: a bucket holds two texts."""
    near = prose(1, 200)
    rows = [(i, near) for i in range(400)] + [(1000, near + " more")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    seen = []
    monkeypatch.setattr(near_duplicates, "links", lambda members, *a, _f=near_duplicates.links: seen.append(members.count()) or _f(members, *a))
    try:
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, 401)} and len(got) == 401
    assert seen[0] <= 2 * 32 and seen[1] == 2


def test_a_cluster_of_thousands_is_one_class(spark, monkeypatch):
    """Near copies of one text, and a chain that hangs on it by one link: rows stay in proportion to the texts."""
    r = random.Random(5)
    words = prose(7, 300).split()
    rows = []
    for i in range(1500):
        w = list(words)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"w{r.random()}"
        rows.append((i, " ".join(w)))
    chain = list(words)
    for k in range(1, 20):  # each link changes a part of the text that is still near the one before
        chain[k * 15 - 8 : k * 15 - 5] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append((2000 + k, " ".join(chain)))
    rows.append((5000, prose(8, 300)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=64).collect()
    assert {(r["class_id"], r["class_size"]) for r in got if r["doc_id"] < 5000} == {(0, 1519)}
    assert {(r["class_id"], r["class_size"]) for r in got if r["doc_id"] == 5000} == {(5000, 1)}


def test_every_pair_of_a_sample_table_is_found(docs):
    """All pairs of 0.8 or more of sf0.001 by brute force are in one class, and classes are no larger than that."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).collect())) == brute_classes(rows)


def test_classes_of_odd_documents(odd, none):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute_classes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert near_duplicates.near_duplicates(none).count() == 0
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, c, _ in want if c is not None})


def test_wordless_documents_of_later_slices_are_single(spark, monkeypatch):
    """A batch is looked at in slices; a text without words that was in an earlier slice is still in no class."""
    monkeypatch.setattr(near_duplicates, "slices", lambda texts, most: bpe.slices(texts, 100))
    texts = ["", prose(1), "", " \t", prose(2), " \t", prose(1), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in near_duplicates.near_duplicates(df).collect())
    assert got == [(0, 0, 1), (1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 1, 2), (7, 7, 1)]


@pytest.mark.parametrize("most_keys", [400_000, 0])
def test_keep_one_tells_rows_of_one_id_apart(spark, monkeypatch, most_keys):
    monkeypatch.setattr(near_duplicates, "MOST_KEYS", most_keys)
    near = prose(4, 200)
    rows = [(1, prose(1)), (1, prose(2)), (2, prose(3)), (2, prose(3)), (3, near), (5, near + " more"), (5, prose(6)), (7, ""), (7, None), (7, ""), (None, prose(1)), (8, prose(8)), (8, prose(8) + "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(tuple(r) for r in near_duplicates.keep_one(df).collect())
    either = kept.pop((8, prose(8)), 0) + kept.pop((8, prose(8) + "  "), 0)
    assert either == 1
    assert kept == Counter([(1, prose(1)), (1, prose(2)), (2, prose(3)), (3, near), (5, prose(6)), (7, ""), (7, None)])


# op7


def test_counts_match_the_unigram_model(odd, docs):
    model = token_counts.UnigramCounter(PIECE)
    m = model.model
    exact = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())], unk_id=0, byte_fallback=True))
    for df in (odd, docs):
        texts = df.select("doc_id", "text").collect()
        got = token_counts.count_tokens(df, PIECE)
        want = sorted((r["doc_id"] or 0, len(exact.encode(m.normalize(r["text"])).ids) if r["text"] else 0) for r in texts)
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want
    for text in texts[:20]:
        whole = model.viterbi(m.normalize(text["text"]))
        assert model.count(text["text"]) == pytest.approx(whole)


# op8


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 3, F.lit(5)).alias("p"))
        got = [r["p"] for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(stopped.values())
        free = sum(w[s] for s in names if s not in stopped)
        target = {s: stopped[s] if s in stopped else rest * w[s] / free for s in names}
        over = [s for s in names if s not in stopped and target[s] > most * sizes[s]]
        if not over:
            return target
        stopped.update((s, most * sizes[s]) for s in over)


def test_mix_meets_targets(spark, odd, docs):
    for df in (docs, odd):
        out, slots = mixing.mix(df, block=16, shard_slots=64)
        got = out.collect()
        assert len(got) == df.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix(df, block=16, shard_slots=64)[0].collect()))
        sizes, taken = Counter(), Counter()
        for r in df.collect():
            sizes[r["source"]] += len((r["text"] or "").encode().split())
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
            taken[r["source"]] += r["taken"]
        target = plain_targets(dict(sizes))
        for r in got:
            assert r["target"] == pytest.approx(target[r["source"]])
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 3 * 16 + 0.01 * target[s], s
        # a block is taken at most three times, each time once a pass, and shards are full
        per = Counter((r["sid"], r["block"]) for r in slots.collect())
        assert max(per.values()) <= 3
        shards = Counter(r["shard"] for r in slots.collect())
        assert all(shards[k] == 64 for k in range(len(shards) - 1)) and 0 < shards[len(shards) - 1] <= 64


def spark_hash(*values):
    """Spark's xxhash64 of ints of 4 bytes, given as ('i', x), and of 8 bytes."""
    h = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_permuted(x, n, seed, *key):
    for r in range(1, 11):
        other = (spark_hash(("i", seed), ("i", r), *key) % n - x) % n
        if spark_hash(("i", seed + 1), ("i", r), *key, max(x, other)) & 1:
            x = other
    return x


def plain_mix(rows, block, shard_slots, seed=20):
    """The mix, shard by shard: rows of (doc_id, source, size) to how many words of each are taken, as a multiset."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    target = plain_targets(dict(sizes))
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    blocks = {s: -(-sizes[s] // block) for s in names}
    slots = {s: min(round(target[s] * blocks[s] / sizes[s]), 3 * blocks[s]) if sizes[s] else 0 for s in names}
    labels = [s for s in names for _ in range(slots[s])]
    shard_of = [plain_permuted(x, len(labels), seed) // shard_slots for x in range(len(labels))]
    drawn, at, times = Counter(zip(shard_of, labels, strict=True)), Counter(), Counter()
    for shard in sorted(set(shard_of)):
        for sid, s in enumerate(names):
            for j in range(at[s], at[s] + drawn[shard, s]):
                times[s, plain_permuted(j % blocks[s], blocks[s], seed + 2, sid, j // blocks[s])] += 1
            at[s] += drawn[shard, s]
    buckets = max(1, round(len(set(rows)) ** 0.5))
    out = Counter()
    for s in names:
        start = 0
        own = [(spark_hash(d, n) % buckets, d is not None, d or 0, n, d) for d, x, n in rows if x == s]
        for *_, n, d in sorted(own, key=lambda x: x[:4]):
            out[d, s, n, sum(times[s, w // block] for w in range(start, start + n))] += 1
            start += n
    return out


def test_mix_equals_plain_version(odd, docs):
    for df in (docs, odd):
        got = mixing.mix(df, block=16, shard_slots=64)[0].collect()
        rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in df.collect()]
        assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == plain_mix(rows, 16, 64)


def test_draws_decide_the_mix(docs):
    """The optimizer leaves the draw for each shard in the plan of the query's result."""
    plan = mixing.mix(docs)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "first" in plan and "shard" in plan and "mix-draws" in str(mixing.mix(docs)[0].inputFiles())


def test_mix_of_nothing(none, odd):
    out, slots = mixing.mix(none)
    assert out.count() == 0 and slots.count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_documents_keep_rows_without_or_with_repeated_ids(spark):
    """Rows without a doc_id come as often as the mix takes them, and rows that share one each by their own share."""
    schema = "doc_id long, text string, source string, note int"
    rows = [(i, prose(i, 40 + i % 7), "a", i) for i in range(60)]
    none = [(None, prose(1000 + i, 40 + i % 7), "b", 1000 + i) for i in range(60)]
    same = [(5000, prose(2000 + i, 40 + i), "c", 2000 + i) for i in range(60)]
    df = spark.createDataFrame(rows + none + same, schema).repartition(3).cache()
    taken = Counter()
    for r in mixing.mix(df)[0].collect():
        taken[r["source"]] += r["taken"]
    assert taken["b"] > 0 and taken["c"] > 0
    got = mixing.mixed_documents(df).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += len(r["text"].split())
    assert {tuple(r) for r in got} <= {*rows, *none, *same}
    # rounding alone moves the words of 60 documents by a fifth or so
    assert all(0.5 * taken[s] < words[s] < 2 * taken[s] for s in "abc"), (words, taken)
    assert max(Counter(r["note"] for r in got).values()) <= 3


# op9


def test_bpe_matches_the_library(spark, odd, docs):
    tokenizer = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        want = []
        for r in df.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            text = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"] or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted((r[0] or 0, *r[1:]) for r in queries.bpe_digests(spark, df).collect()) == sorted(want)


def test_bpe_of_nothing(spark, none):
    assert queries.bpe_digests(spark, none).count() == 0


def test_long_pieces_merge_alike():
    model, library, r = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE), random.Random(4)
    pieces = ["".join(r.choice("aabcdet") for _ in range(n)).encode() for n in (1, 2, 3, 399, 400, 401, 3000)] + [b"a" * 500, b"=" * 1001]
    ids, counts = model.merge_rounds(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        alone = model._merge_long(model.byte_ids[np.frombuffer(piece, np.uint8)]).tolist()
        assert own.tolist() == alone == [t.id for t in library.model.tokenize(piece.decode())]


# op10


def plain_best_fit(items, capacity):
    room, out = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(c, b) for b, c in enumerate(room) if c >= size]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(max(capacity, size))
        room[b] -= size
        out[name] = b
    return out


def in_runs(items, runs):
    """Runs of equal sizes dealt to items: name -> bin."""
    queue = defaultdict(list)
    for size, n, b in runs:
        queue[size] += [b] * n
    return {name: queue[size].pop(0) for name, size in sorted(items, key=lambda x: (-x[1], x[0]))}


def plain_shards(items, shards):
    """Groups above an even share alone; the others at the least capacity that best-fit-decreasing can do with."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    alone, left = {}, sum(s for _, s in items)
    while items and items[0][1] * (shards - len(alone)) > left:
        left -= items[0][1]
        alone[items[0][0]] = len(alone)
        items = items[1:]
    shards -= len(alone)
    if not items:
        return alone
    fits = lambda c: max(plain_best_fit(items, c).values()) < shards
    low = high = max(-(-left // shards), items[0][1])
    step = max(1, low // 2000)
    while not fits(high):
        high, step = low + step, step * 4
    for _ in range(14):
        if high - low <= max(1, high // 10_000):
            break
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return alone | {k: len(alone) + b for k, b in plain_best_fit(items, high).items()}


def test_best_fit_matches_plain_version():
    r = random.Random(2)
    for n in (0, 1, 50, 400):
        items = [(f"g{i:03d}", r.choice([1, 5, 9, 30, 64, 99, 101])) for i in range(n)]
        runs = sharding.best_fit_decreasing(list(Counter(s for _, s in items).items()), 100)
        assert in_runs(items, runs) == plain_best_fit(items, 100)


@pytest.mark.parametrize("cell,most_broadcast", [(50_000, 400_000), (3, 0)])
def test_shards(odd, docs, cell, most_broadcast):
    for df in (docs, odd):
        rows = sharding.shard_documents(df, 16, cell=cell, most_broadcast=most_broadcast).collect()
        assert len(rows) == df.count()
        slots, load = defaultdict(list), Counter()
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        for own in slots.values():
            assert sorted(own) == list(range(len(own)))
        groups = Counter()
        for r in df.collect():
            raw = None if r["text"] is None else r["text"].encode()
            groups[b"" if raw is None else hashlib.md5(raw).digest()] += len(raw or b"") + 1
        want = plain_shards(list(groups.items()), 16)
        expect = Counter()
        for r in df.collect():
            raw = None if r["text"] is None else r["text"].encode()
            expect[r["doc_id"], len(raw or b"") + 1, zlib.crc32(raw or b""), want[b"" if raw is None else hashlib.md5(raw).digest()]] += 1
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows) == expect
        if df is docs:
            assert max(load.values()) <= 1.02 * sum(load.values()) / 16


@pytest.mark.parametrize("hot", [(0.1,), (0.34,), (0.3, 0.2, 0.07)])
def test_shards_beside_a_hot_group_are_near_equal(hot):
    r = random.Random(7)
    small = [r.randint(900, 1100) for i in range(4096)]
    rest = sum(small)
    large = [int(rest / (1 - sum(hot)) * x) for x in hot]
    load = [0] * 16
    runs = sharding.pack_into(list(Counter(large + small).items()), 16)
    assert sum(n for _, n, _ in runs) == len(large) + len(small)
    for size, n, b in runs:
        load[b] += size * n
    others = sorted(load)[: 16 - len(hot)]
    assert max(others) <= 1.01 * rest / len(others) and min(others) >= 0.9 * rest / len(others)


def test_no_documents_no_shards(none):
    assert sharding.shard_documents(none).count() == 0
