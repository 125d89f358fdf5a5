"""Versions of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ordinal

#: What makes two passages the same; section ids are compared without their version.
COMPARED = ("text", "kind", "context_group", "block_id", "role", "heading_level", "sentence_count")


def _comparable(passages: DataFrame) -> Column:
    fields = [F.col(c) for c in COMPARED if c in passages.columns]
    if "section_heading_ids" in passages.columns:
        fields.append(F.transform(F.coalesce("section_heading_ids", F.array().cast("array<string>")), ordinal).alias("section_heading_ids"))
    return F.struct(*fields)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """snapshot_id, unchanged, differing: whether two extractions of a page agree in every position."""
    a = old.select("snapshot_id", "ord", _comparable(old).alias("a"))
    b = new.select("snapshot_id", "ord", _comparable(new).alias("b"))
    both = a.join(b, ["snapshot_id", "ord"], "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("snapshot_id").agg(F.bool_and(same).alias("unchanged"), F.count_if(~same).alias("differing"))


def content_hash(passages: DataFrame) -> DataFrame:
    """One digest for each snapshot; equal digests mean equal content."""
    rows = F.array_sort(F.collect_list(F.struct("ord", _comparable(passages).alias("v"))))
    return passages.groupBy("snapshot_id").agg(F.sha2(F.to_json(rows), 256).alias("content_hash"))


def next_versions(versions: DataFrame, hashes: DataFrame) -> DataFrame:
    """snapshot_id, version, content_hash: the version goes up by one exactly if the content has changed."""
    old = versions.select("snapshot_id", F.col("version").alias("_v"), F.col("content_hash").alias("_h"))
    out = hashes.join(old, "snapshot_id", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_h"))
    return out.select("snapshot_id", (F.coalesce("_v", F.lit(0)) + F.when(same, 0).otherwise(1)).alias("version"), "content_hash")
