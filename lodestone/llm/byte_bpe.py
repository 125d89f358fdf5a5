"""Operator 4: byte-level BPE encoding and decoding of whole texts (see bpe.py for the monoid tree)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import SharedBpe


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the column to, an array of the ids of each whole text; other columns stay as they are.

    ranks is the path of a vocabulary on the driver, which sends it to the executors. A null or empty text has no ids.
    Repeated rows each get theirs. An empty table gives an empty one. A column named as the result is replaced.
    """
    bpe = SharedBpe(docs.sparkSession, ranks, pattern)
    out = T.StructType([f for f in docs.schema.fields if f.name != to] + [T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.get()
        for batch in batches:
            ids = [tool.encode(x or "").astype("int32") for x in batch.column(text).to_pylist()]
            yield _with(batch, to, pa.array(ids, pa.list_(pa.int32())))

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """Adds the column to, the bytes that each array of ids stands for; null ids give no bytes."""
    bpe = SharedBpe(encoded.sparkSession, ranks, pattern)
    out = T.StructType([f for f in encoded.schema.fields if f.name != to] + [T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.get()
        for batch in batches:
            column = batch.column(ids)
            found = [tool.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in column]
            yield _with(batch, to, pa.array(found, pa.binary()))

    return encoded.mapInArrow(run, out)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id_, n_tokens, ids_sha256, decoded_sha256, and whether decoding gives back the text.

    Encodes and decodes in one pass, so that no ids leave the worker. Nulls, repeats and empty tables as in encode().
    """
    bpe = SharedBpe(docs.sparkSession, ranks, pattern)
    kind = docs.schema[id_].dataType
    out = T.StructType(
        [T.StructField(id_, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.get()
        shown = [str(i) for i in range(len(tool.token))]
        for batch in batches:
            counts, hashes, decoded, same = [], [], [], []
            for x in batch.column("_text").to_pylist():
                ids = tool.encode(x)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join([shown[i] for i in ids.tolist()]).encode()).hexdigest())
                back = tool.decode(ids)
                decoded.append(hashlib.sha256(back).hexdigest())
                same.append(back == x.encode())
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=out.names)

    return docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, out)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column], names=[*(batch.schema.names[i] for i in kept), name])
