"""Connected components of links, by rounds of large and small stars over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, written

_LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of some links and the smallest end that it reaches by them."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ends))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            return ends, ends[root]


def _contract(links: DataFrame) -> DataFrame:
    """Links of each partition as stars round the smallest ends that they reach within it, in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(a):
                ends, roots = forest(a, b)
                on = ends != roots
                yield pa.RecordBatch.from_arrays([pa.array(roots[on]), pa.array(ends[on])], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, _LINK)


def components(links: DataFrame, nodes: int | None = None) -> DataFrame:
    """node and component, the smallest node that it reaches; one row for each node that has a link to another.

    links has long columns a and b. Each round is written to the shared folder. No step collects a node's links: stars are
    joins with a minimum, so a node with very many links is split like any skewed key. nodes is about how many there are.
    """
    links = written(_contract(links.filter("a <> b")), "links", nodes)
    before = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        after = written(small, "links", nodes)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(links)
        links = after
        if state == before:
            nodes = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return nodes.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = state
