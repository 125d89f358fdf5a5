"""Neighbours of a selected passage, and moving among results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions.vectors import is_relevant_result, match_percent, relevance_score
from lodestone.operators.ranking import GROUP


def surrounding(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The passages next to a selected one that are relevant too, without a gap, in order.

    rows: one for each query and passage, with ord, kind, context_group, score, evidence_score, excluded_reason; score is
    null where there is none. selected: query_id, snapshot_id, passage_id. A run ends before a heading, another context
    group, a passage without a score, one that isn't relevant, and one that is far less similar than the selected one.
    """
    good = is_relevant_result(F.col("score"), F.col("evidence_score"), F.col("excluded_reason"))
    percent = match_percent(relevance_score(F.col("score"), F.col("evidence_score")))
    marked = rows.withColumns({"_good": good, "_percent": percent})
    anchors = marked.join(selected, [*GROUP, "passage_id"], "left_semi").filter(F.col("_good") & (F.col("kind") != "heading"))
    anchors = anchors.select(*GROUP, F.col("passage_id").alias("selected"), F.col("ord").alias("_anchor"), F.col("context_group").alias("_group"), F.greatest(F.lit(float(C.MIN_MATCH_PERCENT)), F.col("_percent") - C.CONTEXT_MAX_PERCENT_DROP).alias("_least"))
    near = marked.join(anchors, GROUP)
    stops = (F.col("kind") == "heading") | ~F.col("context_group").eqNullSafe(F.col("_group")) | ~F.col("_good") | (F.col("_percent") < F.col("_least"))
    near = near.withColumn("_stop", F.coalesce(stops, F.lit(True)) & (F.col("ord") != F.col("_anchor")))
    run = Window.partitionBy(*GROUP, "selected")
    low = F.max(F.when(F.col("_stop") & (F.col("ord") < F.col("_anchor")), F.col("ord"))).over(run)
    high = F.min(F.when(F.col("_stop") & (F.col("ord") > F.col("_anchor")), F.col("ord"))).over(run)
    inside = (F.col("ord") > F.coalesce("_low", F.lit(-1))) & (F.col("ord") < F.coalesce("_high", F.lit(1 << 30))) & (F.col("ord") != F.col("_anchor"))
    return near.withColumns({"_low": low, "_high": high}).filter(inside).select(*GROUP, "selected", "passage_id", "ord", "score")


def positions(results: DataFrame) -> DataFrame:
    """Adds of, the number of results, and the ranks before and after, going round at the ends."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*GROUP))
    out = results.withColumn("of", n)
    return out.withColumns({"previous": F.pmod(F.col("rank") - 2, F.col("of")) + 1, "next": F.col("rank") % F.col("of") + 1})


def page(results: DataFrame, number: int, rows: int = C.PAGE_ROWS) -> DataFrame:
    """One page of results, numbered from 0."""
    return results.filter((F.col("rank") > number * rows) & (F.col("rank") <= (number + 1) * rows))


def valid_range(block_text: Column, text: Column, start: Column, end: Column) -> Column:
    """Whether the characters from start to end of a block are the passage's text, so that they may be highlighted."""
    return F.substring(block_text, start + 1, end - start) == text
