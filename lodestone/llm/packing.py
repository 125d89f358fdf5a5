"""Operator 3: packing documents into sequences of tokens.

First-fit decreasing over a tournament tree of bin capacities, in groups of documents that a hash deals out at random. Each
group is tokenised, packed and closed by one task. Documents longer than a sequence fill whole ones; what is left of them
and the shorter ones are packed whole. Then the emptiest bins give their tokens to the gaps of the others, so that at most
one bin of a group has a gap; its tokens go into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import SharedBpe
from lodestone.llm.common import text_bytes

#: Bytes of text in a group on average.
GROUP_BYTES = 2 << 20

Piece = tuple[int, int, int]  # document, first id, ids


class Tournament:
    """The free capacity of bins; each inner node holds the most below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes size from the first bin that has room for it."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        found = k - self.leaves
        most[k] -= size
        k //= 2
        while k:
            larger = max(most[2 * k], most[2 * k + 1])
            if most[k] == larger:
                break
            most[k] = larger
            k //= 2
        return found


def pack(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """The pieces of each sequence; pieces of documents of those lengths, without a gap but at sequences of powers of two."""
    full: list[list[Piece]] = []
    items: list[Piece] = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            items.append((d, whole, n - whole))
    items.sort(key=lambda p: -p[2])
    tree, bins = Tournament(max(1, len(items)), capacity), []
    for p in items:
        k = tree.place(p[2])
        if k == len(bins):
            bins.append([])
        bins[k].append(p)
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -used[k])
    give = len(order) - 1
    for at, k in enumerate(order):
        while used[k] < capacity and give > at and used[k] & (used[k] - 1):
            donor = order[give]
            d, s, n = bins[donor].pop()
            moved = min(n, capacity - used[k])
            bins[k].append((d, s + n - moved, moved))
            used[k] += moved
            used[donor] -= moved
            if moved < n:
                bins[donor].append((d, s, n - moved))
            if not bins[donor]:
                give -= 1
    out = full
    for k in order:
        if bins[k] and used[k] < capacity and used[k] & (used[k] - 1):
            out += _powers_of_two(bins[k], used[k])
        elif bins[k]:
            out.append(bins[k])
    return out


def _powers_of_two(pieces: list[Piece], used: int) -> list[list[Piece]]:
    out, rest = [], pieces[::-1]
    for bit in reversed(range(used.bit_length())):
        room = used & 1 << bit
        if not room:
            continue
        out.append([])
        while room:
            d, s, n = rest.pop()
            took = min(n, room)
            out[-1].append((d, s, took))
            room -= took
            if took < n:
                rest.append((d, s + took, n - took))
    return out


def sequences(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, ids: bool = False) -> DataFrame:
    """One row for each piece: id_, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ids, its token ids too.

    A document is the ids of its whole text and end_id. Each id lies in one piece. A sequence holds capacity ids, or as
    many as a power of two below it, and never a gap. A null or empty text is the end alone. Each row is a document of its
    own, repeated ones too; an empty table gives no rows; other columns are not read. A sequence stays within its group, so
    a document longer than others only lengthens its own group.
    """
    spark = docs.sparkSession
    bpe = SharedBpe(spark, vocabulary, pattern, leaf=1 << 16)
    groups = max(1, -(-text_bytes(docs, text) // group_bytes))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField(id_, docs.schema[id_].dataType), *(T.StructField(c, T.LongType()) for c in longs)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)

    def run(table: pa.Table) -> pa.Table:
        tool = bpe.get()
        tokens = [np.append(tool.encode(x.as_py()), np.uint32(end_id)).astype("<u4") for x in table.column("_text")]
        group = table.column("_group")[0].as_py() if len(table) else 0
        rows, taken = [], []
        for number, pieces in enumerate(pack([len(x) for x in tokens], capacity)):
            offset = 0
            for d, s, n in pieces:
                part = tokens[d][s : s + n]
                rows.append((s, n, zlib.crc32(part.tobytes()), len(tokens[d]), group << 32 | number, offset))
                taken.append((d, part))
                offset += n
        columns = np.array(rows, np.int64).reshape(len(rows), len(longs)).T
        arrays = [table.column(id_).take(pa.array([d for d, _ in taken], pa.int64())), *(pa.array(c) for c in columns)]
        if ids:
            arrays.append(pa.array([p.astype(np.int32) for _, p in taken], pa.list_(pa.int32())))
        return pa.table(arrays, names=out.names)

    dealt = docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_group", F.pmod(F.xxhash64(F.col(id_), F.col("_text"), F.lit("packing")), F.lit(groups)))
    return dealt.repartition(groups, "_group").groupBy("_group").applyInArrow(run, out)
