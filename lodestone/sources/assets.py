"""Files that must have a known checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def verified(files: DataFrame) -> DataFrame:
    """Adds sha256 of content and whether it is the expected one. files: path, content, expected."""
    digest = F.sha2(F.col("content"), 256)
    return files.withColumn("sha256", digest).withColumn("verified", F.col("sha256").eqNullSafe(F.lower(F.col("expected"))))


def load(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """The files under a path whose name is listed, checked; a wrong or missing checksum is an error when they are read."""
    names = spark.createDataFrame(list(expected.items()), "name string, expected string")
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    checked = verified(files.join(names, "name"))
    return checked.withColumn("content", F.when(F.col("verified"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong checksum: "), F.col("name"))).cast("binary")))
