"""Operator 8: near-duplicate lines by MinHash over character shingles.

1. A line's signature holds, for each of BINS parts of the hash space, the smallest hash of its shingles there; a part
   without one asks the others, in an order of its own. Bands are fixed choices of ROWS of the parts and hardly overlap: two
   lines of the least similarity agree in a band with a probability of 0.98 and more, as measured from 15 shingles on.
2. A sketch of all chunks (sketch.py) tells a chunk which of its band keys may occur elsewhere. Lines without such a key
   are like no other and go no further.
3. Lines that share a key are held against the smallest of them. What the keys of one smallest line leave in different
   components is walked until no pair across is left that an exact bound allows. Each pair's similarity is verified exactly.
4. Union-find joins links into components; of each component the first line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SLICE_BYTES, distinct_pairs, in_chunks, mix, text_bytes, written
from lodestone.llm.common import distinct as distinct_values
from lodestone.llm.components import components
from lodestone.llm.jaccard_join import apart, bundles, cross_pairs, gathered_pairs, joined, may_link, members, parity_places
from lodestone.llm.sketch import Sketch, repeated, seen_elsewhere

SHINGLE = 5
PERCENT = 80
BINS = 128
ROWS = 7
BANDS = 20
CHUNK_BYTES = 6 << 20
#: Of the sketch: a line has few keys for its length, each of which may flag it by chance.
SHARD_BYTES = 24 << 20
COUNTERS = 16
#: Lines whose keys a shard gathers.
SHARD_LINES = 40_000
#: Rows of bundles that are handed to Python at once; most bundles have two or three.
BUNDLE_ROWS = 2_000

_rng = np.random.default_rng(31)
_CHOICE = np.concatenate([_rng.permutation(BINS), _rng.permutation(BINS)])[: BANDS * ROWS].reshape(BANDS, ROWS)
#: For each part, the order in which it asks all parts for a value if it has none.
_ASKED = np.argsort(_rng.random((BINS, BINS)), axis=0)
#: So often all parts ask, as arrays are quick; then those that still have none.
_ASKED_BY_ALL = 12
_FACTOR = _rng.integers(1 << 62, 1 << 63, max(ROWS, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIN_BITS = BINS.bit_length() - 1
_FACTOR32 = (_FACTOR >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_NONE = np.uint32((1 << 32) - 1)


def normal(line: str) -> str:
    """What counts of a line: A-Z in lower case, each run of blanks and control characters from tab to carriage return as
    one blank, none at the ends."""
    return _normal(line.encode()).decode()


def _normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _normal_lines(text: bytes) -> list[bytes]:
    """The normal forms of a text's lines; those of a text without blanks in a row or control characters are made at once."""
    text = text.lower()
    if b"  " in text or len(text.translate(None, b"\t\v\f\r")) < len(text):
        return [_normal(line) for line in text.split(b"\n")]
    return [line.strip(b" ") for line in text.split(b"\n")]


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Runs of size characters of a normal line, or the whole of a shorter one."""
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))} if line else set()


_remembered = lru_cache(maxsize=512)(shingles)


def similar(a: str, b: str, percent: int, size: int = SHINGLE) -> bool:
    a, b = sorted((a, b), key=len)
    x = _remembered(b, size)
    if 100 * max(1, len(a) - size + 1) < percent * len(x):  # the shorter line has too few runs, however they fall
        return False
    y = _remembered(a, size)
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """32 bits, scrambled reversibly."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


class _Runs:
    """The characters of normal, non-empty lines in UTF-8, and where in them the lines' runs of size begin."""

    def __init__(self, lines: list[bytes], size: int):
        self.code = np.frombuffer(b"\n".join([*lines, b""]).decode().encode("utf-32-le"), np.uint32)
        stop = np.flatnonzero(self.code == 10)
        self.length = np.diff(stop, prepend=-1) - 1
        self.start = stop - self.length
        #: Lines with fewer characters, whose one run is the whole of them.
        self.short = np.flatnonzero(self.length < size)
        #: Where a run begins: not at a line break, nor at the last size - 1 characters before one.
        self.inside = np.ones(len(self.code), bool)
        for k in range(size):
            self.inside[np.maximum(stop - k, 0)] = False
        self.inside[self.start[self.short]] = True
        self.counts = np.maximum(self.length - size + 1, 1)

    def whole(self, line: int) -> np.ndarray:
        return self.code[self.start[line] : self.start[line] + self.length[line]]


def band_keys(lines: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The keys of normal, non-empty lines in UTF-8, one row each."""
    runs = _Runs(lines, size)
    n = len(runs.code)
    wide = np.concatenate([runs.code, np.zeros(size, np.uint32)])
    value = wide[:n] * _FACTOR32[0]
    for k in range(1, size):
        value += wide[k : n + k] * _FACTOR32[k]
    for i in runs.short.tolist():
        value[runs.start[i]] = sum(int(c) * int(f) for c, f in zip(runs.whole(i), _FACTOR32, strict=False)) & (1 << 32) - 1
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), runs.counts)
    value = _scrambled(value[runs.inside])
    table = np.full(BINS * len(lines), _NONE)  # a row for each part, which asks and lends for all lines at once
    owner += (value >> np.uint32(32 - _BIN_BITS)).astype(np.int64) * len(lines)
    np.minimum.at(table, owner, value)
    table = _lent(table.reshape(BINS, -1)).astype(np.uint64)
    keys = np.zeros((BANDS, len(lines)), np.uint64)
    for r in range(ROWS):
        keys += table[_CHOICE[:, r]] * _FACTOR[r]
    return mix(keys.T + np.arange(BANDS, dtype=np.uint64) * _FACTOR[ROWS])


def _lent(table: np.ndarray) -> np.ndarray:
    """A table of parts by lines; a part without a value has that of the first one it asks that has one."""
    none = table == _NONE
    own = np.where(none, np.uint8(255), np.arange(BINS, dtype=np.uint8)[:, None])
    lender = own.copy()
    for asked in _ASKED[:_ASKED_BY_ALL]:
        if not none.any():
            break
        lender &= own.take(asked, axis=0) | (none.view(np.uint8) - np.uint8(1))  # 255 has all bits
        none = lender == 255
    part, line = np.nonzero(none)
    for asked in _ASKED[_ASKED_BY_ALL:]:
        if not len(line):
            break
        lender[part, line] = found = own[asked[part], line]
        part, line = part[found == 255], line[found == 255]
    return np.take_along_axis(table, (lender % BINS).astype(np.intp), axis=0)


def _lines(table: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """Of a chunk's non-blank lines the row, the number within its text, and the normal form."""
    rows, numbers, found = [], [], []
    for row, text in enumerate(table.column("_text").cast(pa.binary()).to_pylist()):
        for number, line in enumerate(_normal_lines(text)):
            if line:
                rows.append(row)
                numbers.append(number)
                found.append(line)
    return rows, numbers, found


def _portions(lines: list[bytes]) -> Iterator[list[bytes]]:
    """Lines in portions of bounded size; a longer one is taken with those before it."""
    part, size = [], 0
    for line in lines:
        part.append(line)
        size += len(line) + 64  # and what short lines take besides
        if size > SLICE_BYTES // 2:
            yield part
            part, size = [], 0
    if part:
        yield part


def _keys(lines: list[bytes]) -> np.ndarray:
    """Band keys in portions of bounded size."""
    return np.concatenate([np.empty((0, BANDS), np.uint64), *map(band_keys, _portions(lines))])


def _name(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _candidates(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """row_id, number and node of each line that has a key in common with another, once with line and keys. docs: row_id, _text."""
    total = text_bytes(docs, "_text")
    sketch, chunks = Sketch.of(total, SHARD_BYTES, COUNTERS), max(1, -(-total // chunk_bytes))
    chunked = in_chunks(docs, chunk_bytes, "_text", total)

    def hashes(table: pa.Table) -> np.ndarray:
        return _keys(list(dict.fromkeys(_lines(table)[2]))).ravel()

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, numbers, found = _lines(table)
        place: dict[bytes, int] = {}
        code = np.array([place.setdefault(line, len(place)) for line in found], np.int64)
        distinct = list(place)
        keys = _keys(distinct)
        often = repeated(keys.ravel(), sketch, answers).reshape(keys.shape)
        kept = np.flatnonzero(((np.bincount(code, minlength=len(distinct)) > 1) | often.any(axis=1))[code])
        code = code[kept]
        once = np.zeros(len(kept), bool)  # equal lines of a chunk send their text and keys once
        once[np.unique(code, return_index=True)[1]] = True
        sent = code[once]
        names = np.zeros(len(distinct), np.int64)
        names[sent] = [_name(distinct[k]) for k in sent.tolist()]
        at = np.concatenate(([0], np.cumsum(np.where(once, np.count_nonzero(often, axis=1)[code], 0)))).astype(np.int32)
        return pa.table(
            [table.column("row_id").take(pa.array(np.array(rows, np.int64)[kept])), pa.array(np.array(numbers, np.int32)[kept]), pa.array(names[code])]
            + [pa.array([distinct[k].decode() if o else None for o, k in zip(once.tolist(), code.tolist(), strict=True)], pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[sent][often[sent]].astype(np.int64)), mask=pa.array(~once))],
            names=["row_id", "number", "node", "line", "keys"],
        )

    said = seen_elsewhere(chunked, hashes, sketch).repartition(chunks, "chunk")
    kind = T.StructType([T.StructField("row_id", docs.schema["row_id"].dataType), T.StructField("number", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("line", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return chunked.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(finish, kind)


def _shapes(lines: DataFrame) -> DataFrame:
    """class, n_shingles, line and parities (as operator 1 has them) of lines. lines: node, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shapes(part) for part in _portions(batch.column("line").cast(pa.binary()).to_pylist())]
            if found:
                counts, bits = [x for c, _ in found for x in c.tolist()], [x for _, b in found for x in b]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(counts, pa.int64()), batch.column("line"), pa.array(bits, pa.binary())], names=["class", "n_shingles", "line", "parities"])

    return lines.select("node", "line").mapInArrow(run, "class long, n_shingles long, line string, parities binary")


def shapes(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, list[bytes]]:
    """How many distinct shingles normal, non-empty lines have, and what parities() says of line_shingles() of each."""
    runs = _Runs(lines, size)
    n = len(runs.code)
    wide = np.concatenate([runs.code, np.zeros(size, np.uint32)]).astype(np.uint64)
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = mix(value * _FACTOR[k] + wide[k : n + k])
    for i in runs.short.tolist():
        value[runs.start[i]] = line_shingles(lines[i].decode(), size)[0]
    value, at = _distinct_each(value[runs.inside], runs.counts)
    counts = np.diff(at)
    places = np.array([parity_places(c) for c in counts.tolist()], np.int64)
    value = mix(value) & np.repeat(places - 1, counts).astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(places)))  # all are multiples of eight
    hits = np.bincount(value.astype(np.int64) + np.repeat(begin[:-1], counts), minlength=begin[-1])
    bits = np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes()
    begin //= 8
    return counts, [bits[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _distinct_each(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each line in order, and where each line's begin. counts: values of each, one at least."""
    at = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[at]


def line_shingles(line: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a normal line's distinct shingles."""
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(1, len(code) - size + 1)
    value = np.full(n, len(code) if len(code) < size else size, np.uint64)
    for k in range(min(size, len(code))):
        value = mix(value * _FACTOR[k] + code[k : k + n])
    return distinct_values(value)


#: Bits that number a character, five of which and the length of a run make a number of 64 bits.
_CHARACTER = 12


def run_numbers(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray] | None:
    """The shingles of each of some lines as numbers, equal exactly if they are, and where each line's begin.

    None if the lines have too many characters of their own for that.
    """
    if not lines or size * _CHARACTER > 60:
        return None
    runs = _Runs(lines, size)
    code = runs.code.astype(np.uint64)
    if runs.code.max() >> _CHARACTER:
        every, code = np.unique(runs.code, return_inverse=True)
        if len(every) >> _CHARACTER:
            return None
        code = code.astype(np.uint64)
    n = len(code)
    wide = np.concatenate([code, np.zeros(size, np.uint64)])
    value = np.full(n, size << 60, np.uint64)
    for k in range(size):
        value |= wide[k : n + k] << np.uint64(_CHARACTER * k)
    for i in runs.short.tolist():
        here = code[runs.start[i] : runs.start[i] + runs.length[i]].tolist()
        value[runs.start[i]] = len(here) << 60 | sum(c << _CHARACTER * k for k, c in enumerate(here))
    return _distinct_each(value[runs.inside], runs.counts)


def similar_pairs(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """similar() of each x and y, normal lines, in portions of bounded size."""
    out, i = np.zeros(len(x), bool), 0
    while i < len(x):
        place: dict[bytes, int] = {}
        pairs, total, first = [], 0, i
        while i < len(x) and total <= SLICE_BYTES:
            total += sum(len(line) for line in {x[i], y[i]} - place.keys())
            pairs.append((place.setdefault(x[i], len(place)), place.setdefault(y[i], len(place))))
            i += 1
        numbers = run_numbers(list(place))
        if numbers is None:
            out[first:i] = [similar(a.decode(), b.decode(), percent) for a, b in zip(x[first:i], y[first:i], strict=True)]
            continue
        value, at = numbers[0], numbers[1].tolist()
        for k, (p, q) in enumerate(pairs, first):
            both = np.concatenate((value[at[p] : at[p + 1]], value[at[q] : at[q + 1]]))
            both.sort()
            common = np.count_nonzero(both[1:] == both[:-1])
            out[k] = 100 * common >= percent * (len(both) - common)
    return out


def _verified(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of lines that are similar; those that the exact bound of their parities rules out aren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, p, q = (batch.column(c).to_pylist() for c in ("n", "m", "p", "q"))
            may = np.array([may_link(n[i], np.frombuffer(p[i], np.uint64), m[i], np.frombuffer(q[i], np.uint64), percent) for i in range(len(n))], bool)
            batch = batch.filter(pa.array(may))
            good = similar_pairs(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("x", "y")), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = shapes.select(F.col("class").alias("a"), F.col("n_shingles").alias("n"), F.col("parities").alias("p"), F.col("line").alias("x"))
    two = shapes.select(F.col("class").alias("b"), F.col("n_shingles").alias("m"), F.col("parities").alias("q"), F.col("line").alias("y"))
    near = pairs.join(one, "a").filter("n >= 1").join(two, "b").filter(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return near.mapInArrow(run, "a long, b long")


def _meetings(found: DataFrame, shards: int) -> DataFrame:
    """Keys of lines, gathered by shards of the keys: of each key that lines share, their pairs with its smallest, as
    gathered_pairs() takes them. found: node, keys, of some rows null."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            names = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [k for k in range(shards) if cut[k + 1] > cut[k]]
            parts = [order[cut[k] : cut[k + 1]] for k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([names[at].tobytes() for at in parts], pa.binary()), pa.array([keys[at].tobytes() for at in parts], pa.binary())], names=["shard", "names", "keys"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
        names = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("names")])
        order = np.argsort(keys)
        keys, names = keys[order], names[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        least = np.repeat(np.minimum.reduceat(names, new), np.diff(np.append(new, len(keys))))
        pairs = distinct_pairs(np.column_stack([least, names])[least != names])
        return pa.table([pa.array([0], pa.int32()), pa.array([pairs.tobytes()], pa.binary())], names=["kind", "body"])

    sent = found.filter("size(keys) > 0").select("node", "keys").mapInArrow(send, "shard int, names binary, keys binary")
    return sent.repartition(shards, "shard").groupBy("shard").applyInArrow(merge, "kind int, body binary")


def _groups(found: DataFrame, percent: int, lines: int) -> DataFrame:
    """Components of lines, by verified links of those that share a key. found: node, line, keys, of some rows null.

    Each line is first held against the smallest line it shares a key with, then against the smallest of its other keys.
    The lines that share keys with one smallest line and are in different components after that are walked as operator 1 walks
    its bundles, until every pair that the exact bound allows has been compared or joined by others.
    """
    shards = max(1, lines // SHARD_LINES)
    pairs = written(gathered_pairs(written(_meetings(found, shards), "meetings"), shards), "pairs", 2 * lines)
    active = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shapes = written(_shapes(found.filter("line is not null").select("node", "line").join(active, "node", "left_semi").groupBy("node").agg(F.min("line").alias("line"))), "shapes", 8 * lines)
    edges = written(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), shapes, percent), "edges", lines)
    groups = written(components(edges, lines), "components", lines)
    groups = joined(groups, written(_verified(apart(pairs, groups), shapes, percent), "edges", lines), lines)
    met = written(bundles(pairs, groups), "bundles", 2 * lines)
    nodes = written(members(met, shapes, groups), "members", 8 * lines)
    first, last = 0, 1
    while rows := met.count():
        left = written(cross_pairs(met, nodes, groups, percent, first, last, 1 + rows // BUNDLE_ROWS), "pairs", lines)
        # few pairs, for which few of the shapes are dealt out
        few = written(apart(left.filter("a is not null"), groups), "pairs", lines)
        ends = few.select(F.col("a").alias("class")).union(few.select("b")).distinct()
        needed = written(shapes.join(ends, "class", "left_semi"), "shapes", lines)
        groups = joined(groups, written(_verified(few, needed, percent), "edges", lines), lines)
        met = written(met.join(left.filter("a is null").select(F.col("b").alias("meeting")), "meeting", "left_semi"), "bundles", 2 * lines)
        first, last = last, 8 * last
    return groups


def repeated_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id_, number (of the line in its text, from 0), component and stays, of each line that is like another one."""
    plain = docs.select(F.col(id_).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = written(_candidates(plain, chunk_bytes), "lines")
    lines = found.count()
    groups = _groups(found, percent, lines)
    named = found.select("row_id", "number", "node").join(groups, "node", "left").select("row_id", "number", F.coalesce("component", "node").alias("component"))
    named = written(named, "named", lines)
    first = written(named.groupBy("component").agg(F.min(F.struct("row_id", "number")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first", lines)
    out = named.join(first, "component")
    stays = F.struct("row_id", "number").eqNullSafe(F.col("first"))
    return out.select(F.col("row_id").alias(id_), "number", "component", stays.alias("stays"))


def remove_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id_, n_lines, n_removed and kept_text of each row of docs.

    Lines are what line feeds part; blank ones are never removed. Two lines are linked when their sets of runs of five
    characters, A-Z in lower case and with single blanks, have a Jaccard similarity of percent or more; equal lines are. Of the
    lines that links join, the first stays: the smallest id, then the smallest number. A null or empty text has one blank
    line. Rows repeated with their id are judged together and all keep the line that stays. A null id is smaller than any;
    rows without id are judged as one. An empty table gives an empty result; other columns are not read.
    """
    gone = repeated_lines(docs, id_, text, percent, chunk_bytes).filter(~F.col("stays")).groupBy(F.col(id_).alias("_id")).agg(F.sort_array(F.collect_set("number")).alias("_gone"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_), body.alias("_text")).join(gone, F.col(id_).eqNullSafe(F.col("_id")), "left")
    lines = F.split("_text", "\n", -1)
    # the stretches between the lines that go, in one walk
    stretches = "transform(sequence(0, size(_gone)), k -> slice(_lines, IF(k = 0, 0, _gone[k - 1] + 1) + 1, IF(k = size(_gone), size(_lines), _gone[k]) - IF(k = 0, 0, _gone[k - 1] + 1)))"
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.expr(f"array_join(flatten({stretches}), '\\n')"))
    rows = rows.withColumn("_lines", lines)
    return rows.select(id_, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))
