"""Operator 6: a quality classifier, a factorisation machine over hashed words, structure and metadata.

score = sigmoid(bias + sum w[f] x[f] + pairs), where a pair of features adds the product of their factors. All pairs together
are half of (square of the sum minus sum of the squares) for each factor, so a text scores in time linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Words, buffers, fresh, slices

#: Hashed words, factors, and labelled rows that the model is fitted on at most (those of the smallest hash of their id).
WORD_BUCKETS = 1 << 14
FACTORS = 8
SAMPLE_ROWS = 6000
#: Structure statistics, each as a value and as one of BINS ranges; the last is metadata.
STATISTICS = ("words", "bytes a word", "letters", "capitals", "digits", "signs", "other bytes", "distinct words", "lines", "bytes a line", "distinct lines", "sentence ends", "longest word", "most frequent word", "signs that end words", "n_chars")
BINS = 12

_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def features(data: np.ndarray, at: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: where each text's word features begin, their numbers, and the statistics, one row each.

    A text's word features are its distinct hashed words, without regard to case, each with the weight that makes a text's
    squares sum to 1.
    """
    words = Words(data, at, lower=True)
    n = words.counts()
    owner = np.repeat(np.arange(len(n)), n)
    bucket = (words.hash >> np.uint64(20)).astype(np.int64) & WORD_BUCKETS - 1
    keys, times = np.unique(owner * WORD_BUCKETS + bucket, return_counts=True)
    begins = np.searchsorted(keys, np.arange(len(n) + 1) * WORD_BUCKETS)
    most = np.zeros(len(n))
    np.maximum.at(most, keys // WORD_BUCKETS, times)
    size = np.diff(at)
    share = np.zeros((len(n), 5))
    kinds = _CLASS[data]
    for k in range(5):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        share[:, k] = total[at[1:]] - total[at[:-1]]
    length = words.end - words.start
    last = data[words.end - 1] if len(length) else np.empty(0, np.uint8)
    per_text = lambda x: np.bincount(owner, x, len(n)) if len(owner) else np.zeros(len(n))
    longest = np.zeros(len(n))
    np.maximum.at(longest, owner, length)
    ends = per_text(_ENDS[last].astype(float))
    signs = per_text((_CLASS[last] == 4) & ~_ENDS[last] & (last != ord(",")))
    lines, same = _lines(data, at, words)
    one = np.maximum(n, 1)
    stats = np.column_stack(
        [np.log1p(n), per_text(length) / one, share[:, 1] / np.maximum(size, 1), share[:, 2] / np.maximum(size, 1), share[:, 3] / np.maximum(size, 1), share[:, 4] / np.maximum(size, 1), share[:, 0] / np.maximum(size, 1)]
        + [np.diff(begins) / one, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), same / np.maximum(lines, 1), ends / one, np.log1p(longest), most / one, signs / one, np.log1p(np.maximum(meta, 0))]
    )
    return begins, keys % WORD_BUCKETS, stats


def _lines(data: np.ndarray, at: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and distinct ones among them, of each text."""
    number = np.concatenate(([0], np.cumsum(data == 10)))[words.start] + np.searchsorted(at, words.start, "right") * (1 << 40)
    if not len(number):
        return np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    sums = np.add.reduceat(words.hash * (np.uint64(2) * (np.arange(len(words.hash)) - np.repeat(first, np.diff(np.append(first, len(number))))).astype(np.uint64) + np.uint64(3)), first)
    owner = np.searchsorted(at, words.start[first], "right") - 1
    distinct = np.unique(np.column_stack([owner.astype(np.uint64), sums]), axis=0)[:, 0].astype(np.int64)
    return np.bincount(owner, minlength=len(at) - 1), np.bincount(distinct, minlength=len(at) - 1)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # of words, then of ranges of statistics
    factors: np.ndarray
    edges: np.ndarray  # of the ranges

    def rows(self, begins: np.ndarray, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's features begin, their numbers, their values."""
        n, many = np.diff(begins), stats.shape[1]
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(many)], axis=1)
        numbers = WORD_BUCKETS + np.arange(many) * BINS + bins
        start = begins + np.arange(len(begins)) * many
        feature, value = np.empty(start[-1], np.int64), np.empty(start[-1], np.float32)
        fixed = start[1:, None] - many + np.arange(many)
        mask = np.ones(start[-1], bool)
        mask[fixed] = False
        feature[mask], feature[fixed] = words, numbers
        value[mask], value[fixed] = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n), 1 / np.sqrt(many)
        return start, feature, value

    def raw(self, start: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, the factors' sums, and each feature's share in them."""
        each = self.factors[feature] * value[:, None]
        total = np.add.reduceat(each, start[:-1], axis=0)
        squares = np.add.reduceat((each * each).sum(axis=1), start[:-1])
        linear = np.add.reduceat(self.weights[feature] * value, start[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares), total, each

    def score(self, data: np.ndarray, at: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(*self.rows(*features(data, at, meta)))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def fit(begins: np.ndarray, words: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 25, rate: float = 0.05, decay: float = 2e-5, seed: int = 7) -> Model:
    """AdaGrad over small batches, in an order fixed by seed; one class alone gives a model that always answers it."""
    rng = np.random.default_rng(seed)
    many = stats.shape[1]
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((many, BINS - 1))
    size = WORD_BUCKETS + many * BINS
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.1, (size, FACTORS)).astype(np.float32), edges)
    if len(np.unique(labels)) < 2:
        model.factors[:] = 0
        return model
    start, feature, value = model.rows(begins, words, stats)
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            n = start[batch + 1] - start[batch]
            at = np.concatenate(([0], np.cumsum(n)))
            take = np.repeat(start[batch] - at[:-1], n) + np.arange(at[-1])
            f, x = feature[take], value[take]
            out, total, each = model.raw(at, f, x)
            slope = np.repeat((_sigmoid(out) - labels[batch]).astype(np.float32), n) / len(batch) * 8
            named, back = np.unique(f, return_inverse=True)
            gw = np.bincount(back, slope * x, len(named)).astype(np.float32) + decay * model.weights[named]
            pull = slope[:, None] * x[:, None] * (np.repeat(total, n, axis=0) - each)
            gv = np.stack([np.bincount(back, pull[:, k], len(named)) for k in range(FACTORS)], axis=1).astype(np.float32) + decay * model.factors[named]
            seen_w[named] += gw * gw
            seen_v[named] += gv * gv
            model.weights[named] -= rate * gw / np.sqrt(seen_w[named])
            model.factors[named] -= rate * gv / np.sqrt(seen_v[named])
            gb = float(slope.sum() / max(1, n.mean()))
            seen_b += gb * gb
            model.bias -= rate * gb / np.sqrt(seen_b)
    return model


def held_out(id_: str) -> Column:
    """Rows that no model is fitted on: a remainder of 1 of the CRC-32 of the id's text, modulo 3."""
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality", meta: str = "n_chars", sample: int = SAMPLE_ROWS) -> Model:
    """Fits a model on labelled rows that are not held out; at most sample of them, chosen by a hash of their ids.

    Labels other than 0 and 1, ids with different labels, null ids, and labels without a document are passed over.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_).isNotNull() & ~held_out(id_)).groupBy(id_).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).filter("_low = _high")
    chosen = known.orderBy(F.xxhash64(F.col(id_), F.lit("sample")), id_).limit(sample).select(F.col(id_).alias("_id"), F.col("_low").alias("_label"))
    rows = _rows(docs, id_, text, meta).join(F.broadcast(chosen), F.col(id_) == F.col("_id"))  # sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("_text"))
            begins, words, stats = features(data, at, batch.column("_meta").to_numpy(zero_copy_only=False))
            cut = [words[a:b].astype(np.int32).tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(cut, pa.binary()), pa.array([r.tobytes() for r in stats], pa.binary()), batch.column("_label").cast(pa.int32())], names=["id", "words", "stats", "label"])

    kind = T.StructType([T.StructField("id", docs.schema[id_].dataType), T.StructField("words", T.BinaryType()), T.StructField("stats", T.BinaryType()), T.StructField("label", T.IntegerType())])
    found = sorted(rows.mapInArrow(run, kind).collect(), key=lambda r: (r["id"], bytes(r["words"])))[:sample]
    words = [np.frombuffer(r["words"], np.int32) for r in found]
    begins = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    stats = np.array([np.frombuffer(r["stats"]) for r in found]).reshape(len(found), len(STATISTICS))
    return fit(begins, np.concatenate([*words, np.empty(0, np.int32)]).astype(np.int64), stats, np.array([r["label"] for r in found], float))


def _meta(docs: DataFrame, text: str, meta: str) -> Column:
    length = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("double")
    return F.coalesce(F.col(meta).cast("double"), length) if meta in docs.columns else length


def _rows(docs: DataFrame, id_: str, text: str, meta: str) -> DataFrame:
    return docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("_text"), _meta(docs, text, meta).alias("_meta"))


def scores(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", meta: str = "n_chars", keep: bool = False) -> DataFrame:
    """id_, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of each row; with keep, instead the rows of docs
    that are predicted 1, with all their columns.

    The score comes from the whole text and from the column meta; a null text counts as empty, a null or missing meta as the
    text's length. Empty texts have a score too. Repeated rows get equal scores; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORD_BUCKETS and FACTORS

    def scored(texts: pa.Array, counts: pa.Array) -> np.ndarray:
        data, at = buffers(texts)
        meta_ = counts.to_numpy(zero_copy_only=False)
        return np.concatenate([sent.value.score(data[at[i] : at[j]], at[i : j + 1] - at[i], meta_[i:j]) for i, j in slices(at)] or [np.empty(0)])

    if keep:
        names, body, count = docs.columns, fresh(docs, "_body"), fresh(docs, "_count")

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = pa.array(scored(batch.column(body), batch.column(count)) >= 0.5)
                yield batch.filter(good).select(names)

        return docs.withColumns({body: F.coalesce(F.col(text), F.lit("")), count: _meta(docs, text, meta)}).mapInArrow(kept, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scored(batch.column("_text"), batch.column("_meta"))
            yield pa.RecordBatch.from_arrays([batch.column(id_), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=out.names)

    out = T.StructType([T.StructField(id_, docs.schema[id_].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return _rows(docs, id_, text, meta).withColumn("held_out", held_out(id_)).mapInArrow(run, out)
