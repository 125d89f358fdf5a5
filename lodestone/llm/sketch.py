"""A count-min sketch that is merged from the chunks of a corpus and asked by them, as wide as the input demands.

The sketch has one row of counters, several for each byte of text, cut into shards. A chunk adds 1 to the counter of each of
its distinct hashes; it sends a shard only the numbers of the counters it raised, as differences. The shard merges what all
chunks have sent and answers each with one bit for each of its counters: whether another chunk raised it, too. So neither a
task nor the driver ever holds the whole sketch, and what travels grows with the input. (Several rows would raise the
traffic alike and are no better than one that is as wide as they are together, for one counter in sixteen is used.)

The counters overestimate: a hash that occurs in two chunks is always found, one that doesn't is found now and then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import distinct

#: Counters for each byte of text, and bytes of text whose counters a shard holds.
COUNTERS = 2
SHARD_BYTES = 8 << 20
SENT = "shard int, chunk int, kind int, body binary"

Hashes = Callable[[pa.Table], np.ndarray]


@dataclass(frozen=True)
class Sketch:
    bits: int
    shards: int

    @staticmethod
    def of(text_bytes: int, shard_bytes: int = SHARD_BYTES, counters: int = COUNTERS) -> Sketch:
        return Sketch(max(16, (counters * max(1, text_bytes) - 1).bit_length()), max(1, -(-text_bytes // shard_bytes)))

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def bounds(self) -> np.ndarray:
        """The first counter of each shard, and the number of all at the end."""
        return np.array([(k << self.bits) // self.shards for k in range(self.shards + 1)], np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences: 16 bits each, 65535 saying that the next one goes on; or 32 or 64 bits."""
    steps = np.diff(values, prepend=0)
    long = steps // 65535
    if 2 * (len(steps) + long.sum()) <= 4 * len(steps):
        out = np.full(len(steps) + int(long.sum()), 65535, "<u2")
        out[np.arange(len(steps)) + np.cumsum(long)] = steps - 65535 * long
        return b"\2" + out.tobytes()
    wide = 4 if steps.max(initial=0) < 1 << 32 else 8
    return bytes([wide]) + steps.astype(f"<u{wide}").tobytes()


def unpack_sorted(body: bytes) -> np.ndarray:
    steps = np.frombuffer(body, f"<u{body[0]}", offset=1)
    values = np.cumsum(steps, dtype=np.int64)
    return values[steps != 65535] if body[0] == 2 else values


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "chunk", "kind", "body"])


def by_shard(values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, slice]]:
    """Which of some ascending values belong to which shard; shards without any are left out."""
    cut = np.searchsorted(values, bounds)
    return [(k, slice(cut[k], cut[k + 1])) for k in range(len(bounds) - 1) if cut[k + 1] > cut[k]]


def seen_elsewhere(chunked: DataFrame, hashes: Hashes, sketch: Sketch) -> DataFrame:
    """For each chunk and shard, the answer to what the chunk sent, as SENT of kind 1; no row where all answers are no."""

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        cells, bounds = distinct(sketch.cells(hashes(table))), sketch.bounds()
        return _table([(k, chunk, 0, pack_sorted(cells[at] - bounds[k])) for k, at in by_shard(cells, bounds)])

    def merge(table: pa.Table) -> pa.Table:
        lists = [unpack_sorted(b.as_py()) for b in table.column("body")]
        every = np.sort(np.concatenate(lists))
        twice = distinct(every[1:][every[1:] == every[:-1]])
        return _answers(table, [_among(x, twice) for x in lists], 1)

    sent = chunked.groupBy("chunk").applyInArrow(send, SENT)
    return sent.repartition(sketch.shards, "shard").groupBy("shard").applyInArrow(merge, SENT)


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def _answers(table: pa.Table, masks: list[np.ndarray], kind: int) -> pa.Table:
    keys = zip(table.column("shard").to_pylist(), table.column("chunk").to_pylist(), masks, strict=True)
    return _table([(s, c, kind, np.packbits(m).tobytes()) for s, c, m in keys if m.any()])


def repeated(hashes: np.ndarray, sketch: Sketch, answers: pa.Table) -> np.ndarray:
    """Which of a chunk's hashes may occur a second time, in the chunk itself or elsewhere."""
    cells, back, times = np.unique(sketch.cells(hashes), return_inverse=True, return_counts=True)
    found = times > 1
    _apply(found, by_shard(cells, sketch.bounds()), answers, 1)
    return found[back] if len(cells) else np.zeros(0, bool)


def _apply(found: np.ndarray, parts: list[tuple[int, slice]], answers: pa.Table, kind: int) -> None:
    said = {r["shard"]: r["body"] for r in answers.to_pylist() if r["kind"] == kind}
    for k, at in parts:
        if k in said:
            found[at] |= np.unpackbits(np.frombuffer(said[k], np.uint8), count=at.stop - at.start).astype(bool)


# ---------------------------------------------------------------- the exact second pass

_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, where each is found among them, and how often each occurs."""
    pairs = np.empty(len(a), _PAIR)
    pairs["a"], pairs["b"] = a, b >> np.uint64(32)
    order = np.lexsort((pairs["b"], pairs["a"]))
    ranked = pairs[order]
    new = np.ones(len(a), bool)
    new[1:] = (ranked["a"][1:] != ranked["a"][:-1]) | (ranked["b"][1:] != ranked["b"][:-1])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], back, np.bincount(back, minlength=int(new.sum()))


def _pair_bounds(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(shards)] , np.uint64)


def _pair_parts(pairs: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    cut = np.append(np.searchsorted(pairs["a"], _pair_bounds(shards)), len(pairs))
    return [(k, slice(cut[k], cut[k + 1])) for k in range(shards) if cut[k + 1] > cut[k]]


def exactly_elsewhere(chunked: DataFrame, answers: DataFrame, flagged: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], sketch: Sketch, chunks: int) -> DataFrame:
    """Groups exactly what the sketch has left: flagged() gives a chunk's two independent hashes of each.

    Answers as seen_elsewhere(), of kind 2: which of a chunk's distinct ones, in order, also occur in another chunk.
    """

    def send(docs: pa.Table, said: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py()
        pairs, _, _ = _pairs(*flagged(docs, said))
        return _table([(k, chunk, 0, pairs[at].tobytes()) for k, at in _pair_parts(pairs, sketch.shards)])

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b.as_py(), _PAIR) for b in table.column("body")]
        every = np.concatenate(lists)
        _, back, times = _pairs(every["a"], every["b"].astype(np.uint64) << np.uint64(32))
        twice = times[back] > 1
        ends = np.cumsum([len(x) for x in lists])
        return _answers(table, np.split(twice, ends[:-1]), 2)

    sent = chunked.groupBy("chunk").cogroup(answers.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(send, SENT)
    return sent.repartition(sketch.shards, "shard").groupBy("shard").applyInArrow(merge, SENT)


def exactly_repeated(a: np.ndarray, b: np.ndarray, sketch: Sketch, answers: pa.Table) -> np.ndarray:
    """Which of a chunk's flagged hash pairs occur a second time, in the chunk itself or elsewhere."""
    pairs, back, times = _pairs(a, b)
    found = times > 1
    _apply(found, _pair_parts(pairs, sketch.shards), answers, 2)
    return found[back] if len(pairs) else np.zeros(0, bool)
