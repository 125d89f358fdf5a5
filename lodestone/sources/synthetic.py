"""A long page made of templates, for tests of ranking over many passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("weather", "harbours", "gardens", "railways", "libraries")


def long_page(spark: SparkSession, n: int = 230, target: str = "The hidden answer stands at the end of the page.") -> DataFrame:
    """ord and text of n templated sentences and, at the end, the target."""
    topics = F.array(*(F.lit(t) for t in TOPICS))
    filler = F.format_string("Note %d describes %s and nothing else.", F.col("id") + 1, F.get(topics, (F.col("id") % len(TOPICS)).cast("int")))
    return spark.range(n + 1).select(F.col("id").alias("ord"), F.when(F.col("id") == n, target).otherwise(filler).alias("text"))
