"""Operator 1: exact self-join of documents by the Jaccard similarity of their word n-grams.

1. A document is the set of its n-grams. A sketch of all chunks (sketch.py) tells each chunk which of its n-grams may occur
   elsewhere. A document of which too few do links with nothing, provably, and goes no further. Equal sets form one class.
2. Sets are joined by size bands. For a band, the universe of n-grams is cut by a hash into segments. Two linked sets of the
   band differ in H n-grams at most. A segment indexed by its subset alone fails to meet only if they differ there; one that
   is indexed by its subset and its one-deletion neighbourhood, only if they differ there by two. Segments are allotted to
   the two kinds by their cost, such that together they tell H + 1 differences: linked sets then meet in one. Empty subsets
   meet nothing; a set that has so many that H + 1 isn't reached is indexed once more under another hash.
3. Pairs that meet are held against an exact bound (n-grams whose parities differ), then verified on the sets themselves.
   Where many sets meet under one key, they are paired with the smallest of them, its center. What a center's keys leave in
   different components is walked as one bundle, each set once. No key lists all its pairs.
4. Links join into components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Words, buffers, distinct, distinct_pairs, fresh, in_chunks, mix, shingle_sets, slices, text_bytes, written
from lodestone.llm.components import components
from lodestone.llm.sketch import Sketch, repeated, seen_elsewhere

NGRAM = 5
PERCENT = 75
CHUNK_BYTES = 4 << 20
#: Ratio of the largest to the smallest size of a band.
BAND = 1.4
#: Sets that meet under one key are all paired up to so many; beyond, with the smallest, and again where that isn't enough.
FEW = 3
SEEDS = 6
#: How many of its meetings a set's rows name, so that a pair is listed by few of those in which it meets.
SHOWN = 16
_SETS = "n_shingles long, class long, shingles binary"


# ---------------------------------------------------------------- size bands and their segments


def _salt(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


class Band:
    """Sets of lo to hi n-grams, and the smaller ones that can link with them.

    exact segments tell one difference each, near ones two; needs of them tell that two sets don't link.
    """

    def __init__(self, lo: int, hi: int, percent: int):
        self.lo, self.hi = lo, hi
        self.least = -(-percent * lo // 100)
        self.needs = (100 - percent) * 2 * hi // (100 + percent) + 1
        best = None
        for share in (0.0, 0.25, 0.5, 1.0):
            units = self.needs
            while True:
                near = round(share * units / 2)
                exact = max(0, units - 2 * near)
                total = exact + 2 * near
                lost = self._lost(exact, near, self.least)
                if total - lost - 2 * lost**0.5 >= self.needs or total > 4 * self.needs + 8:
                    break
                units += max(1, units // 20)
            size = (self.least + hi) / 2
            # keys written, and those of one n-gram, which many sets share, thrice
            cost = exact + near + 2 * near * size / total + 3 * exact * (size / total) * np.exp(-size / total)
            if total - lost >= self.needs and (best is None or cost < best[0]):
                best = (cost, exact, near)
        self.exact, self.near = best[1:] if best else (0, -(-self.needs // 2))
        self.units = self.exact + 2 * self.near

    @staticmethod
    def _lost(exact: int, near: int, size: int) -> float:
        """Differences that segments of no or one n-gram won't tell, on average, of a set of that size."""
        each = size / max(1, exact + 2 * near)
        return exact * np.exp(-each) + near * (2 + 2 * each) * np.exp(-2 * each)

    def keys(self, shingles: np.ndarray, number: int) -> np.ndarray:
        """The keys of a set's subsets and neighbourhoods, under as many hashes as it needs."""
        out = []
        for seed in range(SEEDS):
            salt = _salt(2 * (number * SEEDS + seed) + 1)
            at = (mix(shingles ^ salt) >> np.uint64(32)) * np.uint64(self.units) >> np.uint64(32)
            at = at.astype(np.int64)
            segment = np.where(at < self.exact, at, self.exact + (at - self.exact) // 2)
            value = mix(shingles + salt)
            count = np.bincount(segment, minlength=self.exact + self.near)
            total = np.zeros(len(count), np.uint64)
            np.add.at(total, segment, value)
            name = mix(salt + np.arange(len(count), dtype=np.uint64))
            full = count > 0
            out.append(mix(total[full] ^ name[full]))
            if self.near:
                rest = (segment >= self.exact) & (count[segment] > 1)
                out.append(mix((total[segment[rest]] - value[rest]) ^ name[segment[rest]]))
            near = count[self.exact :]
            lost = int((count[: self.exact] == 0).sum() + 2 * (near == 0).sum() + (near == 1).sum())
            if self.units - lost >= self.needs:
                return np.concatenate(out)
        salt = _salt(2 * number + 2)
        return np.concatenate([*out, mix(shingles ^ mix(salt))])  # linked sets share an n-gram


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> list[Band]:
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * BAND))
        out.append(Band(lo, hi, percent))
        lo = hi + 1
    return out


def set_keys(shingles: np.ndarray, percent: int, plan: list[Band]) -> np.ndarray:
    """All keys of a set: of its own band, and of those whose smaller partners it may be."""
    n = len(shingles)
    found = [b.keys(shingles, k) for k, b in enumerate(plan) if b.least <= n <= b.hi and b.needs > 1]
    return distinct(np.concatenate([*found, np.empty(0, np.uint64)]))


def parity_places(n: int) -> int:
    return 1 << max(8, (4 * n - 1).bit_length())


def parities(shingles: np.ndarray) -> bytes:
    """A bitmap: which of its places are hit by an odd number of n-grams; a power of two from 256, four for each or more."""
    places = parity_places(len(shingles))
    hits = np.bincount((mix(shingles) & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(hits & 1, bitorder="little").tobytes()


def may_link(n: int, bits: np.ndarray, m: int, others: np.ndarray, percent: int) -> bool:
    """False only if the two sets certainly don't link: their difference is at least the number of unlike parities."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    least = min(len(bits), len(others))
    bits, others = (np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) if len(x) > least else x for x in (bits, others))
    return (100 + percent) * int(np.bitwise_count(bits ^ others).sum()) <= (100 - percent) * (n + m)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# ---------------------------------------------------------------- steps


def _name(shingles: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(shingles, digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, ngram: int, percent: int, id_: str, text: str, chunk_bytes: int) -> DataFrame:
    """id_, n_shingles, and of documents that may link with another their class and their sorted n-grams."""
    total = text_bytes(docs, text)
    sketch, chunks = Sketch.of(total), max(1, -(-total // chunk_bytes))
    chunked = in_chunks(docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), chunk_bytes, "_text")

    def words(table: pa.Table) -> Iterator[Words]:
        data, at = buffers(table.column("_text"))
        return (Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True) for i, j in slices(at))

    def hashes(table: pa.Table) -> np.ndarray:
        every = [np.empty(0, np.uint64)]
        for w in words(table):
            every += [w.runs(ngram)[1], w.wholes(np.flatnonzero((w.counts() < ngram) & (w.counts() > 0)))]
        return np.concatenate(every)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = [shingle_sets(w, ngram) for w in words(table)]
        every = np.concatenate([x for x, _ in found])
        sizes = np.concatenate([np.diff(at) for _, at in found])
        at = np.concatenate(([0], np.cumsum(sizes)))
        often = np.concatenate(([0], np.cumsum(repeated(every, sketch, answers))))[at]
        may = (sizes > 0) & (100 * np.diff(often) >= percent * sizes)
        bodies = [every[a:b].tobytes() if m else None for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), may.tolist(), strict=True)]
        names = [_name(x) if x is not None else None for x in bodies]
        return pa.table([table.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "n_shingles", "class", "shingles"])

    said = seen_elsewhere(chunked, hashes, sketch).repartition(chunks, "chunk")
    kind = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), *T._parse_datatype_string(_SETS).fields])
    return chunked.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(finish, kind)


def _meetings(classes: DataFrame, percent: int, largest: int, shards: int) -> DataFrame:
    """Keys of all classes, gathered by shards of the keys: pairs that meet (kind 0), of them those of large keys (kind 1).

    A key of few sets gives all their pairs, a large one each member's pair with the smallest, its center.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = bands(percent, largest)
        for batch in batches:
            names, bodies = batch.column("class").to_numpy(zero_copy_only=False), batch.column("shingles")
            for i in range(0, len(names), 512):
                part = [set_keys(np.frombuffer(b.as_py(), np.uint64), percent, plan) for b in bodies[i : i + 512]]
                keys = np.concatenate(part)
                owner = np.repeat(np.arange(len(part), dtype=np.uint16), [len(k) for k in part])
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                cut = np.append(np.searchsorted(keys, np.array([(k << 64) // shards for k in range(shards)], np.uint64)), len(keys))
                rows = [(k, slice(cut[k], cut[k + 1])) for k in range(shards) if cut[k + 1] > cut[k]]
                owners = names[i : i + 512]
                used = [distinct(owner[at]) for _, at in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([owners[u].tobytes() for u in used], pa.binary()), pa.array([np.searchsorted(u, owner[at]).astype("<u2").tobytes() for u, (_, at) in zip(used, rows, strict=True)], pa.binary()), pa.array([keys[at].tobytes() for _, at in rows], pa.binary())],
                    names=["shard", "names", "owners", "keys"],
                )

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        names = np.concatenate([np.frombuffer(r["names"], np.int64)[np.frombuffer(r["owners"], "<u2")] for r in rows])
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(new, len(keys)))
        pairs, stars = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
        for n in np.unique(size[size > 1]).tolist():
            groups = names[new[size == n][:, None] + np.arange(n)]
            if n <= FEW:
                x, y = np.triu_indices(n, 1)
                pairs.append(distinct_pairs(np.column_stack([groups[:, x].ravel(), groups[:, y].ravel()])))
            else:
                stars.append(distinct_pairs(np.column_stack([np.repeat(groups[:, 0], n - 1), groups[:, 1:].ravel()])))
        large = distinct_pairs(np.concatenate(stars))
        every = distinct_pairs(np.concatenate([*pairs, large]))
        return pa.table([pa.array([0, 1], pa.int32()), pa.array([every.tobytes(), large.tobytes()], pa.binary())], names=["kind", "body"])

    sent = classes.select("class", "shingles").mapInArrow(send, "shard int, names binary, owners binary, keys binary")
    return sent.repartition(shards, "shard").groupBy("shard").applyInArrow(merge, "kind int, body binary")


def gathered_pairs(met: DataFrame, parts: int, kind: int = 0) -> DataFrame:
    """The pairs a, b of all shards, each once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                pairs = np.frombuffer(body, np.int64).reshape(-1, 2)
                to = (mix(pairs[:, 0].astype(np.uint64) * np.uint64(3) + pairs[:, 1].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(parts + 1))
                rows = [k for k in range(parts) if cut[k + 1] > cut[k]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([pairs[order[cut[k] : cut[k + 1]]].tobytes() for k in rows], pa.binary())], names=["part", "body"])

    def merge(table: pa.Table) -> pa.Table:
        every = distinct_pairs(np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(-1, 2) for b in table.column("body")]))
        return pa.table([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

    dealt = met.filter(F.col("kind") == kind).select("body").mapInArrow(deal, "part int, body binary")
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(merge, "a long, b long")


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the exact bound doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            good = [may_link(n[i], np.frombuffer(x[i], np.uint64), m[i], np.frombuffer(y[i], np.uint64), percent) for i in range(len(n))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("n"), F.col("parities").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("m"), F.col("parities").alias("y"))
    return pairs.join(one, "a").filter("n >= 1").join(two, "b").filter(f"100 * least(n, m) >= {percent} * greatest(n, m)").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [links(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), percent) for i in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (classes.select(F.col("class").alias(side), F.col("shingles").alias(body)) for side, body in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    one, two = (groups.select(F.col("node").alias(side), F.col("component").alias(to)) for side, to in (("a", "_ca"), ("b", "_cb")))
    named = pairs.join(one, "a", "left").join(two, "b", "left")
    return named.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def bundles(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """meeting and node: of each center that isn't in one component with all members of its keys, these members and itself.

    Two sets that share a large key share its center, so every pair that keys have left open is in a bundle. One bundle for a
    center takes a row for each of its members, however many keys they share.
    """
    centers = apart(stars, groups).select(F.col("a").alias("meeting")).distinct()
    of_open = stars.select(F.col("a").alias("meeting"), F.col("b").alias("node")).join(centers, "meeting", "left_semi")
    return of_open.unionByName(centers.withColumn("node", F.col("meeting")))


def members(met: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each node of the bundles: its component so far as c0, n, parities, and its smallest meetings as low.

    A node has at most one meeting more than keys.
    """
    low = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("meeting")), 1, SHOWN).alias("low"))
    began = groups.select("node", F.col("component").alias("c0"))
    shapes = classes.select(F.col("class").alias("node"), F.col("n_shingles").alias("n"), "parities")
    return low.join(shapes, "node").join(began, "node", "left").withColumn("c0", F.coalesce("c0", "node"))


def cross_pairs(met: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int, first: int, last: int, parts: int | None = None) -> DataFrame:
    """Of meetings whose members are in different components so far, pairs across that the bound allows.

    Each member's allowed partners are taken in order of their distance, those from first up to last; a row with a null a
    says that the meeting b has further ones. Members of the component that was the meeting's largest at the start, before
    the round whose first is 0, list none: of a pair across, one end at least isn't one of them, and it is walked in every
    round. So a meeting never lists all its pairs, and each pair that matters has its turn. A pair whose ends are known to have
    met under a smaller name is left to that meeting, which has it, too. met: as bundles() gives it, the same in all rounds
    but for meetings that are done; nodes: as members() gives it, before the first round. parts: in how many groups whole
    meetings are handed to Python, where there are many small ones; otherwise each by itself.
    """

    def walked(own: int, node: np.ndarray, group: np.ndarray, before: np.ndarray, size: np.ndarray, bits: list[np.ndarray], low: list[frozenset[int]]) -> list[tuple[int | None, int]]:
        if (group == group[0]).all():
            return []
        least = min(map(len, bits))
        rows = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) if len(x) > least else x for x in bits])
        found, more = set(), False
        # who is walked doesn't change when components join between rounds
        _, back, times = np.unique(before, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(back != np.argmax(times)).tolist():
            unlike = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
            good = ((100 + percent) * unlike <= (100 - percent) * (size[i] + size)) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            good[i] = False
            # the order is the same in every round, whatever components have joined since
            near = np.flatnonzero(good)
            near = near[np.lexsort((node[near], unlike[near]))]
            apart = group[near] != group[i]
            for j in near[first:last][apart[first:last]].tolist():
                if min(low[i] & low[j], default=own) >= own:
                    found.add((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
            more |= bool(apart[last:].any())
        return sorted(found) + [(None, own)] * more

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("meeting")
        meeting, node, group, before, size = (table.column(c).to_numpy() for c in ("meeting", "node", "c", "c0", "n"))
        bits = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("parities")]
        low = [frozenset(x) for x in table.column("low").to_pylist()]
        ends = np.flatnonzero(np.append(meeting[1:] != meeting[:-1], True)) + 1
        out = [x for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) for x in walked(int(meeting[a]), node[a:b], group[a:b], before[a:b], size[a:b], bits[a:b], low[a:b])]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    # components are looked up once for each node; the rows of meetings take part in one join
    now = nodes.join(groups.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    full = met.join(now, "node").select("meeting", "node", "low", "c", "c0", "n", "parities")
    by = "meeting" if parts is None else F.pmod(F.xxhash64("meeting"), F.lit(parts)).alias("part")
    return full.groupBy(by).applyInArrow(across, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document: id_, n_shingles, component_id, and class, which equal sets share (null: links with none).

    Words are maximal runs without blanks and control characters from tab to carriage return, A-Z in lower case. The set is
    that of the runs of ngram words, or of the whole sequence if there are fewer words. Two documents link when
    100 * intersection >= percent * union. component_id is the smallest id that links reach, the document's own included.
    A text that is null, empty or without words has an empty set and no link. Repeated rows link with each other. A row
    without id links like others but names no component; a component of such rows alone has none. An empty table gives an
    empty result; other columns are not read. An n-gram stands as 64 bits of its words' hashes.
    """
    sets = written(_sets(docs, ngram, percent, id_, text, chunk_bytes), "sets")
    documents = sets.count()
    sets, classes = _classes(sets, documents)
    found, largest, total = classes.agg(F.count(F.lit(1)), F.max("n_shingles"), F.sum("n_shingles")).first()
    plain = sets.select(F.col("doc_id").alias(id_), "n_shingles", "class")
    if not found:
        return plain.select(id_, "n_shingles", F.col(id_).alias("component_id"), "class")
    shards = max(1, int(total) // 400_000)
    work = 20 * found  # steps that work on sets spread over more tasks than those on numbers alone
    met = written(_meetings(classes, percent, int(largest), shards), "meetings")
    all_pairs = written(gathered_pairs(met, shards), "met")
    pairs = written(_bounded(all_pairs, classes, percent), "pairs", work)
    # each set is first verified against the smallest it may link with; what that leaves apart follows
    edges = written(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), classes, percent), "edges", work)
    groups = written(components(edges, found), "components", found)
    more = written(_verified(apart(pairs, groups), classes, percent), "edges", work)
    groups = joined(groups, more, found)
    stars = written(gathered_pairs(met, shards, 1), "stars")
    large = written(bundles(stars, groups), "bundles", work)
    nodes = written(members(large, classes, groups), "members", work)
    first, last = 0, 1
    while not large.isEmpty():
        left = written(cross_pairs(large, nodes, groups, percent, first, last), "pairs", work)
        groups = joined(groups, written(_verified(apart(left.filter("a is not null"), groups), classes, percent), "edges", work), found)
        # written, so that a round joins what the one before left open, and not all rounds' bundles anew
        large = written(large.join(left.filter("a is null").select(F.col("b").alias("meeting")), "meeting", "left_semi"), "bundles", work)
        first, last = last, 8 * last
    # classes that link with no other still hold equal documents
    named = plain.join(groups, plain["class"] == groups["node"], "left").select(id_, "n_shingles", "class", F.coalesce("component", "class").alias("_c"))
    named = written(named, "named", documents)
    least = named.filter("_c is not null").groupBy("_c").agg(F.min(id_).alias("_least"))
    return named.join(least, "_c", "left").select(id_, "n_shingles", F.when(F.col("_c").isNull(), F.col(id_)).otherwise(F.col("_least")).alias("component_id"), "class")


def _classes(sets: DataFrame, documents: int) -> tuple[DataFrame, DataFrame]:
    """sets, and class, n_shingles, shingles and parities of each distinct set that may link with another.

    Sets are compared themselves: unlike ones whose digests are alike get other names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [np.frombuffer(b.as_py(), np.uint64) for b in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([len(b) for b in bodies], pa.int64()), batch.column("shingles"), pa.array([parities(b) for b in bodies], pa.binary())], names=["class", "n_shingles", "shingles", "parities"])

    tries = 0
    while True:
        distinct = sets.filter("class is not null").select("class", "shingles").distinct()
        classes = written(distinct.mapInArrow(run, "class long, n_shingles long, shingles binary, parities binary"), "classes", 20 * documents)
        alike = classes.groupBy("class").count().filter("count > 1").select(F.col("class").alias("_alike"))
        if alike.isEmpty():
            return sets, classes
        tries += 1
        name = F.when(F.col("_alike").isNull(), F.col("class")).otherwise(F.xxhash64("shingles", F.lit(tries)))
        sets = written(sets.join(alike, F.col("class") == F.col("_alike"), "left").withColumn("class", name).drop("_alike"), "sets")


def joined(groups: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """Components after more links."""
    if edges.isEmpty():
        return groups
    return written(components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(edges), rows), "components", rows)


def keep_one(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns; rows without id stay."""
    found = jaccard_components(docs.select(id_, text), ngram, percent, id_, text)
    name = fresh(docs, "_gone")
    gone = found.filter(F.col(id_) != F.col("component_id")).select(F.col(id_).alias(name)).distinct()
    return docs.join(gone, docs[id_] == gone[name], "left_anti")
