import math
import zlib

import numpy as np
import pytest

from lodestone.llm import quality, top_k


def brute(rows, k, every):
    vectors = []
    for place, (i, v) in enumerate(rows):
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((place, i, [math.floor(1024 * x) for x in v]))
    out = []
    for place, i, v in vectors:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for p, j, w in vectors if p != place and len(w) == len(v))
            out += [(i, r + 1, j, max(-(1 << 63) + 1, min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(df, **options).collect())


def test_top_k_with_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-3, 4, 4) / 8).tolist()) for i in range(260)]
    rows += [(500, [0.1, 0.2, 0.3, 0.4])] * 3 + [(600, None), (700, [1.0, None, 0.0, 0.0]), (800, [1.0, float("nan"), 0.0, 0.0]), (900, [float("inf")] * 4), (None, [0.1] * 4), (1000, []), (1100, [0.5, 0.5]), (1101, [0.25, 0.5]), (-100, [0.0, 0.0, 0.0, 0.0])]
    want = brute(rows, 7, 100)
    assert run(spark, rows, k=7, shard_rows=16, block_rows=2) == want
    assert run(spark, rows, k=7, shard_rows=1000, block_rows=2, broadcast_bytes=0) == want


def test_queries_of_all_partitions_spread_over_the_blocks(spark):
    rows = spark.range(640).selectExpr("id vec_id", "array(cast(id as float)) embedding").repartition(64, "vec_id")
    shards = top_k.whole_numbers(rows, rows=16)
    sizes = [r["n"] for r in top_k._blocks(shards, 1, 8).select("n").collect()]
    assert sum(sizes) == 640 and len(sizes) == 8 and max(sizes) < 240


def test_top_k_of_large_components(spark):
    rows = [(i, [1e13 * (i % 7 - 3), 3.7e12 * i, -2.5e13]) for i in range(30)] + [(100, [1e6, 1e6, 1.0])]
    assert run(spark, rows, k=5, every=10) == brute(rows, 5, 10)


def test_top_k_of_few_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 1024 * 512)]
    assert run(spark, []) == []


def test_top_k_ignores_other_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2), (1, [0.5], 3, 4)], "vec_id long, embedding array<double>, shard int, n int")
    assert top_k.top_k(df).count() == 1


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.train(docs, labels)


def test_held_out_accuracy(model):
    docs, labels, fitted = model
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.scores(docs, fitted).collect() if r["doc_id"] in truth and r["held_out"]]
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows]
    assert len(rows) > 80 and sum(right) >= 0.95 * len(right)
    bad = [r["score"] for r in rows if truth[r["doc_id"]] == 0]
    good = [r["score"] for r in rows if truth[r["doc_id"]] == 1]
    assert np.mean([b < g for b in bad for g in good]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_scores_do_not_depend_on_labels_or_neighbours(model, awkward, empty):
    docs, _, fitted = model
    found = quality.scores(awkward, fitted).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert quality.scores(empty, fitted).count() == 0
    some = docs.limit(20)
    alone = {r["doc_id"]: r["score"] for r in quality.scores(some.repartition(20), fitted).collect()}
    together = {r["doc_id"]: r["score"] for r in quality.scores(some.coalesce(1), fitted).collect()}
    assert alone == pytest.approx(together, abs=1e-9)
    other = some.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang", "'yy' as source", "n_chars")
    assert sorted(r["score"] for r in quality.scores(other, fitted).collect()) == pytest.approx(sorted(alone.values()), abs=1e-9)


def test_keep_is_the_prediction(model, awkward):
    docs, _, fitted = model
    kept = quality.scores(docs, fitted, keep=True)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.scores(docs, fitted).collect() if r["predicted"]}
    assert quality.scores(awkward, fitted, keep=True).columns == awkward.columns


def test_pairs_by_sums_of_squares():
    rng = np.random.default_rng(0)
    size = quality.WORD_BUCKETS + 2 * quality.BINS
    m = quality.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros((2, quality.BINS - 1)))
    feature, value = rng.choice(size, 9, replace=False), rng.normal(size=9)
    want = 0.3 + sum(m.weights[f] * x for f, x in zip(feature, value, strict=True)) + sum(m.factors[feature[i]] @ m.factors[feature[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    assert m.raw(np.array([0, 9]), feature, value)[0][0] == pytest.approx(want)


def test_odd_labels(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (4, 0), (4, 1), (5, 7), (99, 1)], "doc_id long, quality int")
    fitted = quality.train(awkward, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.scores(awkward, fitted).collect())
    assert quality.train(awkward.filter("false"), labels.filter("false")).bias == pytest.approx(0.0)
