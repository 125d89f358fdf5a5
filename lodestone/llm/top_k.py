"""Operator 5: exact top-k search by tiled matrix products.

Vectors are packed into shards, and the queries among them into blocks. A tile is the product of a block and a shard; of
each query only the k best of a tile go on. A task merges the lists of its tiles, and a tree merges those of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mix, written

SHARD_ROWS = 4096
BLOCK_ROWS = 512
#: Query blocks go to all executors at once only up to so many bytes; beyond, each block is joined by its number.
BROADCAST_BYTES = 16 << 20
#: Lists of so many tasks meet in a node of the merging tree.
FAN_IN = 32

_SHARD = "shard long, dim int, n int, ids binary, vectors binary"
_BLOCK = "block int, dim int, n int, shards binary, places binary, ids binary, vectors binary"
_LIST = "shard long, place int, query_id long, node long, best array<struct<worst:decimal(38,0), vec_id:long>>"
_EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = 1024, rows: int = SHARD_ROWS) -> DataFrame:
    """Shards of the vectors floor(scale * x): rows of one length each, with their ids.

    Vectors that are null, empty, or hold a null or a component that isn't finite are left out, and so are rows without id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            column, ids = batch.column(1), batch.column(0)
            sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False)) if len(column) else np.empty(0, np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            first = column.offsets.to_numpy(zero_copy_only=False)
            usable = column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(sizes[usable]).tolist():
                at = np.flatnonzero(usable & (sizes == dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    found = np.floor(values[first[at][:, None] + np.arange(dim)] * scale)
                good = np.isfinite(found).all(axis=1) if dim else np.zeros(len(at), bool)
                at, found = at[good], found[good]
                for i in range(0, len(at), rows):
                    yield _record(_SHARD, [[number], [dim], [len(at[i : i + rows])], [keys[at[i : i + rows]].tobytes()], [found[i : i + rows].tobytes()]])
                    number += 1

    return vectors.select(F.col(id_).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, _SHARD)


def _record(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _blocks(shards: DataFrame, every: int, count: int) -> DataFrame:
    """The rows whose id is divisible by every, in blocks; each remembers its shard and its place there.

    Shards are dealt to blocks by a hash: their numbers begin with the partition, which a remainder by a power of two drops.
    """

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, dim, n, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(keys % every == 0)
                if len(at):
                    rows = np.frombuffer(vectors).reshape(n, dim)[at]
                    block = int(mix(np.array([shard], np.uint64))[0] % np.uint64(count))
                    yield _record(_BLOCK, [[block], [dim], [len(at)], [np.full(len(at), shard).tobytes()], [at.astype(np.int64).tobytes()], [keys[at].tobytes()], [rows.tobytes()]])

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        joined = {c: b"".join(r[c] for r in rows) for c in ("shards", "places", "ids", "vectors")}
        return pa.Table.from_batches([_record(_BLOCK, [[rows[0]["block"]], [rows[0]["dim"]], [sum(r["n"] for r in rows)], *([joined[c]] for c in ("shards", "places", "ids", "vectors"))])])

    return shards.mapInArrow(queries, _BLOCK).groupBy("block", "dim").applyInArrow(gather, _BLOCK)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond what doubles hold, in Python's integers."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < _EXACT:
        return queries @ rows.T
    wide = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return wide(queries) @ wide(rows).T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest scores as (-score, id), ties to smaller ids."""
    if len(scores) > k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        if len(at) > k:  # a tie at the end of the list: only its smallest ids count
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
        scores, ids = scores[at], ids[at]
    return sorted((-int(s), i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True))[:k]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank from 1, vec_id, score: of each row whose id is divisible by every, the k rows of the highest scores.

    The score is the inner product of the two vectors' floor(scale * x), as a whole number; one beyond 64 bits becomes the
    nearest that they hold. All rows but the query's own are candidates; ties go to smaller ids. Vectors that are null,
    empty, or hold a null or a component that isn't finite take no part, nor do rows without id; vectors only meet vectors
    of their own length. Repeated rows are different rows: each is a candidate of the other, and a query of its own. Fewer
    candidates than k are all returned; an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    shards = written(whole_numbers(vectors, id_, vector, scale, shard_rows), "shards")
    rows, width = shards.agg(F.sum("n"), F.max("dim")).first()
    count = max(1, -(-(rows or 0) // every // block_rows))
    blocks = written(_blocks(shards, every, count), "blocks")
    asked = blocks.agg(F.sum("n")).first()[0] or 0
    if asked * ((width or 0) * 8 + 24) <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    tiles = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(blocks.withColumnsRenamed({"n": "q_n", "ids": "q_ids", "vectors": "q_vectors"}), ["block", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for batch in batches:
            for row in range(len(batch)):
                r = {c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names)}
                ids, data = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"])
                from_shard, place, q_ids = (np.frombuffer(r[c], np.int64) for c in ("shards", "places", "q_ids"))
                scores = products(np.frombuffer(r["q_vectors"]).reshape(r["q_n"], r["dim"]), data)
                for q in range(r["q_n"]):
                    own = from_shard[q] == r["shard"]
                    s, i = (np.delete(scores[q], place[q]), np.delete(ids, place[q])) if own else (scores[q], ids)
                    key = (int(from_shard[q]), int(place[q]), int(q_ids[q]))
                    lists[key] = sorted(lists.get(key, []) + best_of(s, i, k))[:k]
            if len(lists) > 64 * block_rows:
                yield _lists(lists)
                lists = {}
        if lists:
            yield _lists(lists)

    merged = tiles.mapInArrow(run, _LIST)
    nodes = max(1, merged.rdd.getNumPartitions())
    while True:
        merged = merged.groupBy("shard", "place", "query_id", (F.col("node") / FAN_IN).cast("long").alias("node")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if nodes <= FAN_IN:
            break
        nodes = -(-nodes // FAN_IN)
    final = merged.groupBy("shard", "place", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    entry = final.select("query_id", F.posexplode("best").alias("at", "e"))
    score = F.greatest(F.least(-F.col("e.worst"), F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63) + 1).cast("decimal(38,0)"))
    return entry.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), score.cast("long").alias("score"))


def _lists(lists: dict) -> pa.RecordBatch:
    import decimal

    limit = 10**37
    node = TaskContext.get().partitionId()
    kind = pa.list_(pa.struct([("worst", pa.decimal128(38, 0)), ("vec_id", pa.int64())]))
    best = [[{"worst": decimal.Decimal(max(-limit, min(limit, s))), "vec_id": i} for s, i in found] for found in lists.values()]
    keys = list(lists)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.int64()), pa.array([node] * len(keys), pa.int64()), pa.array(best, kind)],
        names=["shard", "place", "query_id", "node", "best"],
    )
