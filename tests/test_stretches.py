"""Neighbours from stretches: the same rows as from whole pages, and few rows on the way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as own
from lodestone.operators import paged, stretches
from lodestone.plans import surrogate as S

DIR = "/root/testdata/sf0.001"
SAID = "snapshot_id long, passage_id string, ord int, text string, kind string, role string, block_id string, section_heading_ids array<string>, context_group string, vector array<double>"


def tables(spark, near, seed):
    """Pages with blocks in pieces, headings anywhere, groups and roles that are null, and texts that are numbers; near: how
    much the vectors of a page have in common."""
    r = random.Random(seed)

    def vector(common):
        v = [r.gauss(0, 1) + near * c for c in common]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    rows, asked, common = [], [], [r.gauss(0, 1) for _ in range(8)]
    for page, size in enumerate([1, 2, 40, 60]):
        heads = [str(i) for i in range(size) if r.random() < 0.1]
        group = 0
        for i in range(size):
            group += r.random() < 0.1
            kind = "heading" if str(i) in heads else "sentence"
            named = r.sample([*heads, "none"], r.randint(0, min(2, len(heads))))
            role = r.choice(["body"] * 6 + ["fragment", "navigation", "control", None])
            text = r.choice(["red fox", "how many", "12", "7", "red fox runs", "- 12 7", ""])
            rows.append((page, str(i), i, text, kind, role, str((i + r.choice([0, 0, 0, 3])) // 4), named, r.choice([None, "g"]) if group % 5 == 4 else str(group), vector(common)))
    for k, text in enumerate(["red fox", "how many 12", "", "runs 7", "red", "12", "fox", "how"]):
        asked.append((k, text, vector(common)))
    return spark.createDataFrame(asked, "query_id long, query string, vector array<double>"), spark.createDataFrame(rows, SAID)


def found(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize(("near", "seed"), [(0.0, 1), (0.5, 2), (1.0, 3)])
def test_same_as_from_whole_pages(spark, monkeypatch, near, seed):
    monkeypatch.setattr(paged, "BLOCK", 3)
    queries, said = tables(spark, near, seed)
    want = found(stretches.neighbours(paged.in_blocks(paged.with_percents(paged.meet(queries, said, S._score)), around=True)))
    assert len(want) > 20
    assert found(stretches.neighbours(stretches.stretches(queries, said, S._score, S._plain))) == want


def test_nothing_relevant(spark):
    said = spark.createDataFrame([(1, str(i), i, "red", "sentence", "body", "0", [], "a", [1.0, 0.0]) for i in range(3)], SAID)
    queries = spark.createDataFrame([(1, "red", [0.0, 1.0]), (2, "red", [-1.0, 0.0])], "query_id long, query string, vector array<double>")
    assert found(stretches.neighbours(stretches.stretches(queries, said, S._score, S._plain))) == []


def test_vectors_of_different_lengths_are_an_error(spark):
    said = spark.createDataFrame([(1, str(i), i, "red", "sentence", "body", "0", [], "a", [1.0, 0.0][: i + 1]) for i in range(2)], SAID)
    queries = spark.createDataFrame([(1, "red", [0.0, 1.0])], "query_id long, query string, vector array<double>")
    with pytest.raises(Exception, match="vectors of different lengths"):
        stretches.stretches(queries, said, S._score, S._plain).collect()


def test_query_same_as_from_whole_pages(spark):
    want = stretches.neighbours(paged.in_blocks(paged.with_percents(S.met(spark, DIR)), around=True))
    assert found(own.context_runs(spark, DIR)) == found(want)


def test_a_page_takes_many_passages_a_stretch_few():
    """Places of a boost by paragraph, of one by section, alone, beside a heading and in another run."""
    scores = np.array([[0.25, 0.4, 0.1, 0.31, 0.31, 0.9, 0.31, 0.31, 0.2, 0.31]]) / 2
    high = np.full((1, 10), -np.inf)
    high[0, 8] = 0.3
    block, first = np.array([0, 0, 1, 1, 2, 3, 4, 4, 5, 5]), np.array([0, 0, 0, 0, 4, 5, 6, 6, 6, 6])
    free, body = np.arange(10) != 5, np.ones(10, bool)
    q, lo, hi = stretches._search(scores, high, S._plain, block, first, free, body)
    assert list(zip(q, lo, hi, strict=True)) == [(0, 0, 1), (0, 6, 9)]
    assert [list(x) for x in stretches._search(scores, high, S._plain, block, first, free, ~body)[1:]] == [[6], [7]]


def made(plan):
    """The rows of each Generate of a plan that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return made(plan.executedPlan())
    inner = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    here = [plan.metrics().get("numOutputRows").get().value()] if name == "GenerateExec" else []
    return here + [n for p in inner for n in made(p)]


def test_few_rows_of_queries_and_passages_are_made(spark):
    df = own.context_runs(spark, DIR)
    n = len(df.collect())
    rows = made(df._jdf.queryExecution().executedPlan())
    pairs = S.queries(spark, DIR).count() * S.passages(spark, DIR).count()
    assert n > 0 and len(rows) >= 3 and max(rows) < pairs / 10, rows
    assert S.stretches(spark, DIR).filter(~F.exists("members", lambda m: F.size(m["near"]) > 0)).count() == 0
