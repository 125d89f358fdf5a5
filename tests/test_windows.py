import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.functions import vectors as V
from lodestone.operators import rerank, similarity, windows


def made(spark, n, size, overlap=None):
    row = spark.range(1).select(F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>")).alias("t"))
    return row.select(windows.windows(F.col("t"), size, overlap).alias("w")).first()["w"]


def test_windows(spark):
    found = made(spark, 1000, 254, 32)
    assert found[1]["start"] == 222 and found[-1]["end"] == 1000
    assert all(w["tokens"] == list(range(w["start"] + 1, w["end"] + 1)) for w in found)
    assert made(spark, 0, 10) == [] and len(made(spark, 10, 10)) == 1 and len(made(spark, 11, 10)) == 2
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            windows.windows(F.col("t"), size, overlap)


@pytest.mark.parametrize(("q", "b", "s", "most"), [(600, 3000, 2, 1024), (2, 7990, 0, 7999), (0, 0, 0, 256), (300, 0, 70, 256), (3, 500, 70, 256)])
def test_pairs_cover_everything(spark, q, b, s, most):
    numbers = lambda first, n: F.sequence(F.lit(first), F.lit(first + n - 1)) if n else F.array().cast("array<int>")
    row = spark.range(1).select(numbers(1, q).alias("q"), numbers(10_000, b).alias("b"), numbers(90_000, s).alias("s"))
    found = row.select(windows.pair_windows(F.col("q"), F.col("b"), F.col("s"), most).alias("x")).first()["x"]
    assert found and all(len(x) <= most for x in found)
    seen = {t for x in found for t in x}
    assert {*range(1, q + 1)} <= seen and {*range(10_000, 10_000 + b)} <= seen
    if (q, b) == (2, 7990):
        assert len(found) == 1 and len(found[0]) == 7995


def test_limits():
    for most in (255, 8000, 1.5):
        with pytest.raises(ValueError):
            windows.pair_windows(F.lit(1), F.lit(1), F.lit(1), most)
        with pytest.raises(ValueError):
            SearchConfig(pair_tokens=most)
    with pytest.raises(ValueError):
        SearchConfig(backend="tpu")


def test_pair_scores_take_the_best_window(spark):
    rows = [(1, 1, "a", [1], [5] * 500, []), (1, 1, "b", [1], [], [])]
    df = spark.createDataFrame(rows, "query_id long, snapshot_id long, passage_id string, query_tokens array<int>, body_tokens array<int>, section_tokens array<int>")
    found = {r["passage_id"]: r["rerank_score"] for r in rerank.pair_scores(df, lambda batch: [float(len(x)) for x in batch], most=256).collect()}
    assert found == {"a": 256.0, "b": 4.0}
    with pytest.raises(Exception, match="finite"):
        rerank.pair_scores(df, lambda batch: [float("nan")] * len(batch), most=256).collect()


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    found = row.select(V.normalize(F.col("a")).alias("n"), V.dot(F.col("a"), F.col("b")).alias("d")).first()
    assert found["n"] == pytest.approx([0.6, 0.8]) and found["d"] == 1.0
    with pytest.raises(Exception, match="direction"):
        spark.createDataFrame([([0.0],)], "a array<double>").select(V.normalize(F.col("a"))).collect()
    with pytest.raises(Exception, match="lengths"):
        row.select(V.dot(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_pooling(spark):
    rows = [(1, 0, "p", 0, 0.2, 0, 5), (1, 0, "p", 1, 0.2, 5, 9), (1, 1, "p", 0, 0.1, 0, 5), (1, 1, "p", 1, 0.2, 5, 9)]
    df = spark.createDataFrame(rows, "query_id long, q_no int, key string, w_no int, score double, start int, end int")
    best, mean = (similarity.pooled(df, ["key"], whole).first() for whole in (False, True))
    assert best["score"] == pytest.approx(0.2) and (best["start"], best["end"]) == (0, 5)
    assert mean["score"] == pytest.approx((0.2 + 0.15) / 2)


def test_blocks_agree_with_pairs(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: [x / np.linalg.norm(x) for x in rng.normal(size=(n, 8))]
    q = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(unit(5))], "query_id long, q_no int, q_vector array<double>")
    t = spark.createDataFrame([(f"k{i}", 0, x.tolist()) for i, x in enumerate(unit(40))], "key string, w_no int, vector array<double>")
    a = {(r["query_id"], r["key"]): r["score"] for r in similarity.scores_in_blocks(q, t, ["key"], rows=7).collect()}
    b = {(r["query_id"], r["key"]): r["score"] for r in similarity.window_scores(q.withColumn("page", F.lit(1)), t.withColumn("page", F.lit(1)), ["page"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    some = {(r["query_id"], r["key"]): r["score"] for r in similarity.scores_in_blocks(q, t, ["key"], rows=7, best=3, margin=1e-9).collect()}
    assert len(some) < len(a) and all(some[k] == pytest.approx(b[k]) for k in some)
    for i in range(5):
        assert set(sorted((k for k in b if k[0] == i), key=lambda k: -b[k])[:3]) <= set(some)


def test_best_of_blocks_keeps_ties(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id long, q_no int, q_vector array<double>")
    t = spark.createDataFrame([(f"k{i}", 0, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)], "key string, w_no int, vector array<double>").coalesce(1)
    found = similarity.scores_in_blocks(q, t, ["key"], rows=20, best=3).collect()
    assert {r["key"] for r in found} == {f"k{i}" for i in range(1, 20, 2)}
    assert similarity.scores_in_blocks(q, t.limit(0), ["key"], best=3).count() == 0


def test_classifier_head():
    import math

    rng = np.random.default_rng(2)
    dense, w, b, o, x = rng.normal(size=(256, 256)) / 16, rng.normal(size=256), rng.normal(size=256), rng.normal(size=256), rng.normal(size=256)
    hidden = [0.5 * h * (1 + math.erf(h / math.sqrt(2))) for h in dense @ x]
    mean = sum(hidden) / 256
    spread = sum((h - mean) ** 2 for h in hidden) / 256
    expected = 0.5 + sum(((h - mean) / math.sqrt(spread + 1e-5) * w[i] + b[i]) * o[i] for i, h in enumerate(hidden))
    assert rerank.ClassifierHead(dense, w, b, o, 0.5).score(x)[0] == pytest.approx(expected, abs=1e-5)
    with pytest.raises(ValueError):
        rerank.ClassifierHead(dense, w, b, o[:5], 0.5)
    with pytest.raises(ValueError):
        rerank.ClassifierHead(dense, w, b, o, 0.5).score(x[:5])
