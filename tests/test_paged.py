"""Ranking over whole pages: the same rows as from separate tables, and nothing but packed scores is dealt out or written."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone import queries as own
from lodestone.functions.text import substantive
from lodestone.operators import context, hybrid, paged, ranking
from lodestone.plans import surrogate as S

DIR = "/root/testdata/sf0.001"
ROUNDED = {"score": 6, "evidence_score": 6, "value": 9, "question_score": 9}


def rows(df, *columns):
    return sorted(df.select(*(F.round(c, ROUNDED[c]) if c in ROUNDED else F.col(c) for c in (*ranking.GROUP, *columns))).collect(), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    return S.ranked(spark, DIR)


@pytest.fixture(scope="module")
def blocks(spark):
    return paged.in_blocks(paged.with_percents(S.met(spark, DIR)), around=True)


def test_same_rows_as_from_tables(spark, tables, blocks):
    ranked, q, b, par = tables
    one = ["passage_id", "ord", "text", "role", "score", "evidence_score", "tier", "value", "exact_match", "reason", "excluded_reason"]
    assert rows(paged.ranked(blocks), *one) == rows(ranked, *one)
    full = ["passage_id", "block_id", "is_paragraph", "score", "evidence_score", "tier", "value", "exact_match", "excluded_reason", "focus.passage_id"]
    found = ranking.adaptive(ranked, q, b, par)
    assert rows(paged.adaptive(blocks), *full) == rows(found, *full)
    sentences, paragraphs = (t.select(*ranking.GROUP, k, (F.col("score") * w).alias("question_score")) for t, k, w in ((ranked, "passage_id", 0.9), (par, "block_id", 1.1)))
    asked = paged.question_rows(paged.results_before_lexical(blocks), 0.9, 1.1)
    want = hybrid.question_rows(found.filter(F.col("is_paragraph") | substantive(F.col("role"))), ranked, sentences, paragraphs)
    assert rows(asked, "passage_id", "is_paragraph", "question_score", "value") == rows(want, "passage_id", "is_paragraph", "question_score", "value")
    last = ["passage_id", "is_paragraph", "lexical", "value", "rank"]
    final, known = paged.finalize(paged.results_before_lexical(blocks), q), hybrid.finalize(ranked, q, b, par)
    near = lambda df: rows(df.withColumn("lexical", F.round("lexical", 9)), *last)
    assert near(final) == near(known)
    chosen = known.filter(~F.col("is_paragraph")).select(*ranking.GROUP, "passage_id")
    runs = final.filter(~F.col("is_paragraph")).select(*ranking.GROUP, F.col("passage_id").alias("selected"), F.explode("near").alias("passage_id"))
    assert rows(runs, "selected", "passage_id") == rows(context.surrounding(ranked, chosen), "selected", "passage_id")


@pytest.mark.parametrize("name", ["evidence_ranking", "hybrid_final", "context_runs", "adaptive_paragraphs", "hybrid_question", "question_cutoff", "result_positions"])
def test_rows_of_queries_and_passages_stay_where_they_are(spark, name):
    plan = own.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan, "checkpointed rows"
    above = plan[: plan.index("ArrowEvalPython")]
    assert len(re.findall(r"\bExchange\b", above)) == 1 and re.search(r"Exchange hashpartitioning\(snapshot_id[^,]*, \d+\), REPARTITION_BY_NUM", above)
    assert not re.search("SortMergeJoin|ShuffledHashJoin", above)


def test_places_around_headings_and_groups(spark):
    kinds, groups = ["sentence", "sentence", "heading", "sentence", "sentence", "sentence"], "aaaaba"
    said = spark.createDataFrame([(1, str(i), i, f"text {i}", k, "body", str(i // 2), ["2", "9"] if i > 2 else [], g, [1.0, float(i)]) for i, (k, g) in enumerate(zip(kinds, groups, strict=True))], "snapshot_id long, passage_id string, ord int, text string, kind string, role string, block_id string, section_heading_ids array<string>, context_group string, vector array<double>")
    row = paged._pages(said, 2).first()
    members = [m for b in row["_blocks"] for m in b["members"]]
    assert [m["i"] for m in members] == list(range(6)) and [v[1] for v in row["_vectors"]] == list(range(6))
    assert [(m["first"], m["last"]) for m in members if m["kind"] != "heading"] == [(0, 1), (0, 1), (3, 3), (4, 4), (5, 5)]
    assert [m["heads"] for m in members] == [[], [], [], [2, None], [2, None], [2, None]]


def test_ranks_are_whole_over_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(paged, "BLOCK", 3)
    found = own.evidence_ranking(spark, DIR)
    each = found.groupBy("query_id", "snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"))
    assert found.count() == 5000 and each.count() == 50 and each.filter("n <> 100 or m <> 100").count() == 0
