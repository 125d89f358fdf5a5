"""A corpus pipeline of five stages over documents; each stage's result is written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, jaccard_join, packing, pii, quality
from lodestone.llm.common import fresh, written
from lodestone.llm.queries import JSON, PII_KEY, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels of the table documents.

    A null or empty text is scored like others, by its statistics; equal rows are kept or dropped together; other columns,
    of whatever names, stay as they are; an empty table stays empty.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scores(docs, model, keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    A null text counts as empty, a null id as smaller than any; of rows repeated with id and text one stays. Other columns
    stay as they are; an empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays; those that have no id all stay.

    Texts that are null, empty or without words link with nothing and stay; rows repeated with their id stay or go together.
    Other columns stay as they are; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses give way to pseudonyms; n_chars, where there is one, follows the text.

    A null or empty text and a null n_chars stay; every row is taken by itself; other columns, also those named like the
    operator's counts, stay as they are; an empty table stays empty.
    """
    before = fresh(docs, "_length")
    out = pii.pseudonyms(docs.withColumn(before, F.char_length("text")), PII_KEY, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.col("n_chars") + F.coalesce(F.char_length("text") - F.col(before), F.lit(0)))
    return out.select(*(out[c] for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    A null or empty text is one token, the end; repeated rows are packed each; an empty table gives no piece; other columns
    are not read.
    """
    return packing.sequences(docs, JSON, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [("quality", quality_filter), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("pii", pseudonyms), ("packing", pack)]

#: The classifier, the pseudonyms and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
