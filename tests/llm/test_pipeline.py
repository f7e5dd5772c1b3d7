from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from predspark.llm import queries

from .test_search_and_rules import statistics
from .test_tokens_and_shards import brute_classes, plain_targets


def test_stages_one_by_one(spark, sf):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        seen.append((name, docs, out))
        docs = out
    assert len(seen) in (4, 5)
    for _, _, out in seen[:-1]:
        assert out.columns == columns
    (_, docs, ruled), (_, _, good), (_, _, single), (_, _, mixed), (_, _, ids) = seen
    fails = lambda s: s[0] < 20 or 100 * s[4] > 30 * s[0]
    assert {r["doc_id"] for r in ruled.collect()} == {r["doc_id"] for r in docs.collect() if not fails(statistics(r["text"]))}
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    judged = [(labels[r["doc_id"]] == 1) == (r["doc_id"] in kept) for r in ruled.collect() if r["doc_id"] in labels]
    assert sum(judged) >= 0.9 * len(judged)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c, _ in classes})
    sizes, got = Counter(), Counter()
    n = lambda r: len((r["text"] or "").encode().split())
    for r in single.collect():
        sizes[r["source"]] += n(r)
    for r in mixed.collect():
        got[r["source"]] += n(r)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3
    target = plain_targets(dict(sizes))
    assert abs(sum(got.values()) - sum(target.values())) < 0.15 * sum(target.values())
    assert Counter(r["doc_id"] for r in ids.collect()) == times


CLASHING = ["_id", "_rows", "_mix_id", "_copies", "_copy", "_quality_score", "row", "order", "stays", "label", "taken", "share", "m", "_n", "_doc", "_digest", "id", "no_id", "words", "target", "_row_", "_in", "_text", "bucket"]


def test_stages_on_odd_rows_and_clashing_columns(spark, sf, odd):
    """Null and shared ids, repeated rows, null and empty texts, extra columns: each stage against a plain version."""
    good = " ".join(f"word{i}" for i in range(40))
    more = [(None, good, "en", "s0", 0), (None, good + " tail", "en", "s0", 0), (4, good + " other end of it all here", "en", "s1", 0), (4, "fully different words " + " ".join(f"q{i}" for i in range(30)), "en", "s1", 0)]
    extra = spark.createDataFrame([(*r, 1, "x", b"x", 2, "w", 3, "k", 4, "q") for r in more], odd.schema)
    df = odd.union(extra).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)], F.create_map(F.lit("a"), F.lit(1)).alias("tags")).cache()
    rows = Counter((r["doc_id"], r["text"]) for r in df.collect())
    content = lambda out: Counter((r["doc_id"], r["text"]) for r in out.collect())

    ruled = corpus_pipeline.apply_rules(spark, df, sf)
    fails = lambda s: s[0] < 20 or 100 * s[4] > 30 * s[0]
    hosts = Counter()
    for r in df.collect():
        hosts[r["source"], fails(statistics(r["text"]))] += 1
    assert ruled.columns == df.columns
    by_source = Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect() if not fails(statistics(r["text"])))
    kept = Counter((r["doc_id"], r["text"], r["source"]) for r in ruled.collect())
    gone = {s for _, _, s in by_source - kept}
    assert not kept - by_source and None not in gone and all(hosts[s, True] > hosts[s, False] for s in gone)
    assert all(s in gone for _, _, s in by_source - kept) and not any(s in gone for _, _, s in kept)

    judged = corpus_pipeline.apply_classifier(spark, df, sf)
    assert judged.columns == df.columns and not content(judged) - rows
    by_text = Counter(t for _, t in rows.elements())
    assert all(n == by_text[t] for t, n in Counter(t for _, t in content(judged).elements()).items())  # equal texts alike

    single = corpus_pipeline.drop_near_duplicates(spark, df, sf)
    every = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    classes = {}
    for i, c, _ in brute_classes([(k, t) for k, (_, t) in enumerate(every)]):
        classes.setdefault(c, []).append(every[i])
    assert single.columns == df.columns
    left = content(single)
    assert set(left.values()) == {1} and sum(left.values()) == len(classes)
    for own in classes.values():  # one of each class, with the least id, null last
        stays = [x for x in own if x in left]
        assert len(stays) == 1 and stays[0][0] == min((x[0] for x in own if x[0] is not None), default=None)

    mixed = corpus_pipeline.mix_sources(spark, df, sf)
    assert mixed.columns == df.columns
    times = content(mixed)
    assert set(times) <= set(rows) and all(n <= 3 * rows[x] for x, n in times.items()) and all((t or "").split() for _, t in times)
    ids = corpus_pipeline.encode(spark, df, sf)
    assert Counter(r["doc_id"] for r in ids.collect()) == Counter(d for d, _ in rows.elements())


def test_stages_on_an_empty_table(spark, sf, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() > 0
