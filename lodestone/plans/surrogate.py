"""The standard tables as pages, passages, queries and vectors: what the engine's queries run on.

Vectors: each row of embeddings is a passage; five make a block, a hundred a page; every 25th is a heading, which heads the
section up to the next. Queries are the rows whose id is divisible by 50. Scores are twice the cosine, rounded, so that all
thresholds matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import hybrid, paged, ranking, segment, similarity
from lodestone.operators import stretches as around
from lodestone.plans.cut import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalize(F.col("embedding")).alias("vector"))


def query_windows(units: DataFrame) -> DataFrame:
    """Each query by itself, as one window."""
    return units.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("q_no"), F.col("vector").alias("q_vector"))


def cosines(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    """query_id, vec_id, score of each query with each vector; with best, at least of those that are among its so many best."""
    units = unit_vectors(spark, sf_dir)
    targets = units.select("vec_id", F.lit(0).alias("w_no"), "vector")
    # scores are ranked when rounded, so those that may round to the same are kept
    return similarity.scores_in_blocks(query_windows(units), targets, ["vec_id"], best=best, margin=1e-5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    heading = i % 25 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 100").alias("snapshot_id"), F.concat(F.lit("1:"), i.cast("string")).alias("passage_id"), i.alias("ord"),
        F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" item "), (i % 3).cast("string")).alias("text"),
        F.when(heading, "heading").otherwise("sentence").alias("kind"), F.when(i % 11 == 3, "fragment").when(i % 11 == 7, "navigation").otherwise("body").alias("role"),
        F.expr("vec_id div 5").cast("string").alias("block_id"), F.when(heading, F.array().cast("array<string>")).otherwise(F.array(F.expr("concat('1:', cast(vec_id div 25 * 25 as string))"))).alias("section_heading_ids"),
        F.expr("vec_id div 25").cast("string").alias("context_group"), F.when(heading, 2).cast("int").alias("heading_level"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    whole = F.concat(F.lit("topic "), F.col("label").cast("string"), F.lit(" item 0"))
    return asked.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 100 == 0, whole).otherwise("how many item 1").alias("query"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cosines(spark, sf_dir)
    return found.select("query_id", F.expr("vec_id div 100").alias("snapshot_id"), F.concat(F.lit("1:"), F.col("vec_id").cast("string")).alias("passage_id"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("score"))), 6).alias("score"), F.lit(0).alias("start"), F.lit(5).alias("end"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.blocks(passages(spark, sf_dir))


def paragraph_scores(scores_: DataFrame, passages_: DataFrame) -> DataFrame:
    """The mean score of each block's members."""
    rows = scores_.join(passages_.select("snapshot_id", "passage_id", "block_id"), ["snapshot_id", "passage_id"])
    return rows.groupBy(*ranking.GROUP, "block_id").agg(F.round(F.avg("score"), 6).alias("score"))


def ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ranked passages, queries, blocks and paragraph scores.

    For few queries: paged has the same rows without writing those of queries and passages, and the queries read those.
    Scores have three readers and ranked rows four, so both are cut off from the products that they come from.
    """
    p, q, s = passages(spark, sf_dir), queries(spark, sf_dir), cut(scores(spark, sf_dir))
    par = paragraph_scores(s, p)
    return cut(hybrid.excluded(ranking.rank_passages(q, p, s, par))), q, blocks(spark, sf_dir), par


def _met(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = unit_vectors(spark, sf_dir).select("vec_id", "vector")
    said = passages(spark, sf_dir).join(units, F.col("ord") == F.col("vec_id")).drop("vec_id")
    return queries(spark, sf_dir).join(units, F.col("query_id") == F.col("vec_id")).drop("vec_id"), said


def _score(product: Column) -> Column:
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * product)), 6)


def _plain(products: np.ndarray) -> np.ndarray:
    """_score() without rounding."""
    return np.clip(2 * products, -1, 1)


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query on each page, for paged's operators; the scores are those of scores()."""
    return paged.meet(*_met(spark, sf_dir), _score)


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of met(), what has neighbours."""
    return around.stretches(*_met(spark, sf_dir), _score, _plain)
