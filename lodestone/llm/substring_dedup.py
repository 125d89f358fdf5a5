"""Operator 9: removal of passages that occur again, in the same document or in another.

A window is a number of consecutive words of one document. Sketches of all chunks are merged and overestimate how often each
window occurs; a second pass groups exactly, by 96 bits of two hashes, only the windows estimated to be repeated. A window
that the sketch doesn't find has no second occurrence, so none is lost. The words that repeated windows cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Words, buffers, in_chunks, slices, text_bytes
from lodestone.llm.sketch import Sketch, exactly_elsewhere, exactly_repeated, repeated, seen_elsewhere

WINDOW = 35
CHUNK_BYTES = 4 << 20


def _words(table: pa.Table) -> Iterator[Words]:
    data, at = buffers(table.column("_text"))
    return (Words(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at))


def _windows(table: pa.Table, size: int, form: int = 0) -> np.ndarray:
    """The hashes of all windows of a chunk, in order."""
    return np.concatenate([*(w.runs(size, form)[1] for w in _words(table)), np.empty(0, np.uint64)])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, texts: bool = False) -> DataFrame:
    """One row for each document: id_, n_words, n_removed, kept_sha256; with texts, also kept_text.

    Words are maximal runs without blanks and control characters from tab to carriage return. The kept words are joined by
    one blank. Windows are judged on the input, so of a passage that occurs twice no copy stays. A text that is null, empty
    or shorter than a window loses nothing. Repeated rows are different documents and so repeat each other. An empty table
    gives an empty result; other columns are not read.
    """
    total = text_bytes(docs, text)
    sketch = Sketch.of(total)
    chunks = max(1, -(-total // chunk_bytes))
    chunked = in_chunks(docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), chunk_bytes, "_text")
    kind = docs.schema[id_].dataType
    out = T.StructType([T.StructField(id_, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * texts)

    def flagged(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows the sketch has left, and their two hashes."""
        first = _windows(table, window)
        at = repeated(first, sketch, answers)
        first = first[at]
        return at, first, _windows(table, window, 1)[at]

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, *hashes = flagged(table, answers)
        found[found] = exactly_repeated(*hashes, sketch, answers)
        del hashes
        columns: list[list] = [[], [], [], []]
        done = 0
        for words in _words(table):
            start = words.starts(window)
            hit = start[found[done : done + len(start)]]
            done += len(start)
            change = np.bincount(hit, minlength=len(words.start) + 1)[: len(words.start) + 1] - np.bincount(hit + window, minlength=len(words.start) + 1)[: len(words.start) + 1]
            gone = np.cumsum(change)[:-1] > 0
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                kept = _joined(words.data, words.start[a:b], words.end[a:b], gone[a:b])
                columns[0].append(b - a)
                columns[1].append(int(gone[a:b].sum()))
                columns[2].append(hashlib.sha256(kept).hexdigest())
                columns[3].append(kept.decode() if texts else None)
        arrays = [table.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
        return pa.table(arrays + [pa.array(columns[3], pa.string())] * texts, names=out.names)

    said = seen_elsewhere(chunked, lambda table: _windows(table, window), sketch)
    exact = exactly_elsewhere(chunked, said, lambda table, answers: flagged(table, answers)[1:], sketch, chunks)
    answers = said.unionByName(exact).repartition(chunks, "chunk")
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one blank; bytes.split() cuts at the very bytes that end a word."""
    if not len(start):
        return b""
    if not gone.any():
        return b" ".join(data[start[0] : end[-1]].tobytes().split())
    return b" ".join([data[a:b].tobytes() for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)])
