"""Labelled queries kept as one JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string, relevantElementIds array<string>"


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id in the order of the file, query, relevant_ids."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return rows.select(F.monotonically_increasing_id().alias("query_id"), "query", F.col("relevantElementIds").alias("relevant_ids"))
