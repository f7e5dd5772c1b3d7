import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from predspark.llm import blobs, exact_topk, quality_classifier, quality_rules, suffix_tree


def words(t):
    return (t or "").encode().split()


# op1


def brute_top(rows, k, every=3):
    good = {i: np.floor(1024 * np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % every == 0:
            found = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tree_rows,query_block", [(10_000, 4_096), (40, 30)])
def test_top_k_is_exact(spark, tree_rows, query_block):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4) / 8]) for i in range(300)]  # many ties
    rows += [(301, None), (302, [None, 1.0, 2.0, 3.0]), (303, [math.nan] * 4), (306, [math.inf] * 4), (None, [1.0] * 4), (309, [1.0, 2.0]), (312, []), (315, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    got = exact_topk.top_k(df, F.col("vec_id") % 3 == 0, k=7, tree_rows=tree_rows, query_block=query_block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)


def test_top_k_of_huge_components_and_nothing(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (3, [3e12, 2.0]), (4, [-1e12, 7.0])], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") == 0, k=2).collect()
    big = 1 << 10
    assert [r["vec_id"] for r in got] == [3, 4]
    assert got[0]["score"] == min(2**63 - 1, int(1e12 * big) * int(3e12 * big) + big * 2 * big)
    assert exact_topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_tree_boxes_are_tight():
    x = np.random.default_rng(1).normal(size=(1000, 5))
    tree = exact_topk.KDTree(x, leaf=32)
    for n, (s, e, child) in enumerate(tree.nodes):
        assert (tree.low[n] == tree.x[s:e].min(0)).all() and (tree.high[n] == tree.x[s:e].max(0)).all()
        assert child or e - s <= 32
    q = np.random.default_rng(2).normal(size=(3, 5))
    assert (tree.bounds(q)[:, 0] >= (q @ x.T).max(1)).all()


# op2


def statistics(t):
    w = words(t)
    n = len(w)
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {i + k for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(odd, docs):
    for df in (odd, docs):
        got = quality_rules.text_statistics(df.select("doc_id", "text"), F.col("text")).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(r["text"])


def test_host_verdicts(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(50)] + [(100 + i, good if i % 10 == 0 else bad, "rotten") for i in range(50)] + [(200, good, "tiny"), (201, bad, None), (202, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(df).collect()}
    n, f = np.array([50, 50, 1]), np.array([5, 45, 0])
    mean, var = (f / n).mean(), (f / n).var()
    k = max(1.0, mean * (1 - mean) / var - 1)
    assert got[100]["host_rate"] == pytest.approx((45 + mean * k) / (50 + k))
    assert got[1]["kept"] and not got[0]["kept"] and not got[100]["kept"] and got[200]["kept"] and got[202]["kept"] and not got[201]["kept"]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_many_hosts_are_joined_without_a_broadcast_of_all(spark, docs, monkeypatch):
    """Beyond the bound, hosts with many documents are broadcast and the others joined: the same rows."""
    few = docs.union(docs.withColumn("source", F.lit(None).cast("string"))).union(docs.withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 50))).cache()
    want = sorted(map(str, quality_rules.apply_quality_rules(few).collect())), sorted(map(str, quality_rules.keep_good(few, 0.2).collect()))
    monkeypatch.setattr(quality_rules, "MOST_HOSTS", 0)
    assert (sorted(map(str, quality_rules.apply_quality_rules(few).collect())), sorted(map(str, quality_rules.keep_good(few, 0.2).collect()))) == want


def test_rules_on_odd_and_empty(odd, none):
    assert quality_rules.apply_quality_rules(odd).count() == odd.count()
    assert quality_rules.apply_quality_rules(none).count() == 0
    assert quality_rules.keep_good(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


# op3


def brute_tree(texts, depth, least_context, least_symbol, least):
    """A suffix tree in plain dictionaries: probability(context, symbol)."""
    counts = Counter(w for t in texts for w in t)
    n, v = sum(counts.values()), len(counts)
    symbols = {w for w, c in counts.items() if c >= least_symbol}
    total, pair = Counter(), Counter()
    for t in texts:
        for i, w in enumerate(t):
            for d in range(1, depth + 1):
                if d > i + 1:
                    break
                c = tuple(["^", *t][i + 1 - d : i + 1])
                total[c] += 1
                pair[c, w] += 1
    stored = {k: x for k, x in pair.items() if k[1] in symbols and x >= least_symbol}
    kept, seen = {}, set()

    def root(w):
        return (counts[w] - 0.5 if counts[w] else 0.5 * v) / n

    def prob(c, w):
        while c and c not in kept:
            c = c[1:]
        if not c:
            return root(w)
        own, back = kept[c]
        return max(own.get(w, 0.5) - 0.5, 0) / total[c] + back * prob(c[1:], w)

    level = [c for c in {k[0] for k in pair} if len(c) == 1 and (c[0] == "^" and len(texts) >= least_context or counts[c[0]] >= least_context)]
    for _ in range(depth):
        made = {}
        for c in level:
            own = {w: x for (a, w), x in stored.items() if a == c}
            gain = sum(x / total[c] * math.log(x / total[c] / prob(c[1:], w)) for w, x in own.items())
            rest, outside = max(1 - sum(own.values()) / total[c], 0), max(1 - sum(prob(c[1:], w) for w in own), 1e-12)
            gain += rest * math.log(rest / outside) if rest else 0
            if gain - len(own) / (2 * total[c]) >= least:
                made[c] = (own, 1 - sum(x - 0.5 for x in own.values()) / total[c])
        kept.update(made)
        level = [(*c, w) for (c, w), x in stored.items() if c in level and w != b"" and x >= least_context]
    return prob, counts, n, v, kept, seen


def test_suffix_tree_matches_plain_version(spark):
    import random

    r = random.Random(3)
    texts = []
    for i in range(120):
        w = ["the", "cat"] if i % 3 else ["a", "dog"]
        for _ in range(r.randint(5, 40)):
            w.append({"the": r.choice(["cat", "dog", "sun"]), "cat": "sat", "dog": r.choice(["ran", "sat"]), "sat": "on", "on": "the"}.get(w[-1], r.choice(["the", "a", "zig", f"rare{r.randint(0, 300)}"])))
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    options = dict(depth=3, p_root=0.002, least_context=12, least_symbol=3, min_divergence=0.01)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    tokens = {i: [*t.lower().encode().split(), b""] for i, t in enumerate(texts)}
    prob, counts, n, v, kept, _ = brute_tree([t for i, t in tokens.items() if not held[i]], 3, 12, 3, 0.01)
    assert {len(c) for c in kept} >= {1, 2}
    for row in suffix_tree.score_documents(df, **options).collect():
        t = tokens[row["doc_id"]]
        assert row["held_out"] == held[row["doc_id"]] and row["n_tokens"] == len(t) and row["train_tokens"] == n
        assert row["n_known"] == sum(counts[w] > 0 for w in t)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert row["score"] == pytest.approx(sum(math.log10(prob(tuple(["^", *t][max(0, i - 2) : i + 1]), w)) for i, w in enumerate(t)))
    for c in [(), *kept]:
        assert sum(prob(c, w) for w in counts) + prob(c, b"never seen") == pytest.approx(1)


def test_suffix_tree_keeps_what_recurs_in_a_larger_corpus(spark):
    """Contexts that recur a dozen times stay, whatever share of all positions that is; all of it against plain counts."""
    import random

    r = random.Random(9)
    rows = [" ".join(f"w{r.randint(0, 1999)}" for _ in range(300)) for _ in range(600)]
    for i in range(0, 600, 40):
        rows[i] += " kind of blue note"
    rows.append("kind of blue note")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    tokens = {i: [*t.encode().split(), b""] for i, t in enumerate(rows)}
    learned = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    n = sum(map(len, learned))
    often = sum(b"kind" in t for t in learned)
    assert 10 <= often < 1e-4 * n
    prob, _, _, _, kept, _ = brute_tree(learned, 3, 10, 3, 0.01)
    assert {(b"kind",), (b"kind", b"of"), (b"kind", b"of", b"blue")} & set(kept)
    for row in suffix_tree.score_documents(df).collect():
        t = tokens[row["doc_id"]]
        assert row["score"] == pytest.approx(sum(math.log10(prob(tuple(["^", *t][max(0, i - 2) : i + 1]), w)) for i, w in enumerate(t)))


def test_suffix_tree_on_odd_and_empty(odd, none):
    got = suffix_tree.score_documents(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert suffix_tree.score_documents(none).count() == 0


def test_suffix_tree_beats_unigrams_on_held_out(docs):
    got = [r for r in suffix_tree.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def recurring(texts, words):
    r = np.random.default_rng(8)
    return [(i % 97 or None, " ".join(f"w{k}" for k in r.integers(0, 150, words))) for i in range(texts)] + [(5, "w1 w2"), (5, "w1 w2"), (None, None), (7, "")]


def test_answers_of_buckets_are_not_a_row_for_each_text(spark, monkeypatch):
    """What buckets of n-grams give back grew with texts times buckets."""
    rows, made = recurring(300, 60), {}

    def counted(dealt, work, schema, _f=suffix_tree.by_bucket):
        out = _f(dealt, work, schema)
        if work.__name__ not in ("chunks", "sum_up"):
            made[work.__name__] = out.count()
        return out

    monkeypatch.setattr(suffix_tree, "by_bucket", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert suffix_tree.score_documents(df, most_hot=1).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made and max(made.values()) <= len(rows)


def test_passes_and_shares_change_nothing(spark, monkeypatch):
    rows, made = recurring(200, 40), []
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def scores():
        out = suffix_tree.score_documents(df, most_hot=1, least_context=4, least_symbol=2)
        return sorted(([x is None, x or 0, *y] for x, *y in out.collect()), key=str)

    def noted(part, name, _f=suffix_tree.materialize):
        made.append(name)
        return _f(part, name)

    once = scores()
    monkeypatch.setattr(suffix_tree, "materialize", noted)
    monkeypatch.setattr(suffix_tree, "PASS_TOKENS", 100)
    got = scores()
    assert made.count("pst-scored") == suffix_tree.SHARES and made.count("pst-counted") > suffix_tree.PASSES
    assert len(got) == len(once) == len(rows)
    key = lambda x: (*x[:-2], round(x[-2], 6), round(x[-1], 6))
    assert sorted(map(key, got)) == sorted(map(key, once))


def test_orders_by_values():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 3000):
        for most in (3, 1 << 20, (1 << 64) - 1):  # small keys have equal upper bits
            key, group = r.integers(0, most, n, np.uint64), r.integers(0, 7, n)
            assert (blobs.ordered(key) == np.argsort(key, kind="stable")).all()
            order = blobs.grouped(group, 7, key)
            assert (np.diff(group[order]) >= 0).all() and (np.sort(order) == np.arange(n)).all()


# op4


def test_classifier_on_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = quality_classifier.classify(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def plain_ftrl(rows, passes=3, alpha=1.5, beta=0.5, l1=0.02, l2=0.02):
    """Follow the regularised leader in dictionaries: rows of (label, {feature: value})."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for y, x in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_weights_match_plain_ftrl(spark):
    """The whole fit: sample by hash, one row for each id and text, order, updates."""
    import random

    r = random.Random(6)
    rows = [(i % 90, " ".join(r.choice(["good", "fine", "text"] if i % 2 else ["spam", "!!!", "buy", "text"]) for _ in range(r.randint(1, 12)))) for i in range(120)]
    rows += [rows[0]] * 40 + [(None, "no id"), (3, None)]
    labels = [(i, i % 2) for i in range(90)] + [(5, 0), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_classifier.fit(df, known, max_rows=60)
    both = {i for i, _ in labels if len({y for j, y in labels if j == i and y is not None}) > 1}
    y = {i: q for i, q in labels if q is not None and i not in both and zlib.crc32(str(i).encode()) % 5}
    order = {r["id"]: r["h"] for r in spark.range(100).select("id", F.xxhash64("id").alias("h")).collect()}
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    ids = sorted(y, key=lambda i: (order[i], i))[:60]
    sample = sorted({(order[i], i, digest(t), t or "") for i, t in rows if i in ids})[:60]
    features = quality_classifier.Features()
    plain = plain_ftrl([(y[i], dict(zip(*(a.tolist() for a in features.sparse([t])[0]), strict=True))) for _, i, _, t in sample])
    want = np.zeros(quality_classifier.BUCKETS + 1)
    for i, w in plain.items():
        want[quality_classifier.BUCKETS if i == "bias" else i] = w
    assert np.abs(want).max() > 0.1 and got == pytest.approx(want, abs=1e-5)


def test_classifier_on_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (5, 0), (None, 1), (8, None), (10, 1), (10, 1), (16, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(none, labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(odd, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns


def test_shapes_cover_whole_words():
    assert quality_classifier.shape("x" * 64 + "7") != quality_classifier.shape("x" * 64)
    assert quality_classifier.shape("a1" * 4 + "B") != quality_classifier.shape("a1" * 4 + "-")
    assert quality_classifier.shape("Cat7!!!") == "Xx0!!"


def test_scores_are_sparse_dot_products():
    features, w = quality_classifier.Features(), np.random.default_rng(0).normal(size=quality_classifier.BUCKETS)
    texts = ["", "one", "The cat THE cat!! the***", "a b " * 50]
    for text, dot, (which, x) in zip(texts, features.dot(texts, w), quality_classifier.Features().sparse(texts), strict=True):
        assert dot == pytest.approx(float(w[which] @ x), abs=1e-5), text
