"""The neighbours of selected passages, for many queries that meet every page.

Few passages have a neighbour: it and they must be relevant, and stand side by side. So each page, as paged scores it, is
searched for stretches: places side by side in one run, of two or more, each of which may be relevant. The search takes too
many rather than too few, and leaves the rules to the operators. Only stretches are dealt out, with the products of the blocks
that they touch; any other passage ends a run, or has none around it, whatever its score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import config as C
from lodestone.functions import text as X
from lodestone.operators import hybrid, paged
from lodestone.operators.ranking import GROUP

#: What the rounding of products and of means may change in a score; more than that.
SLACK = 1e-5
#: What the rules of neighbours need of a passage.
_MEMBER = ["i", "passage_id", "kind", "role", "words", "numbers"]
_LISTS = T.ArrayType(T.DoubleType())
_BLOCK = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("products", _LISTS), T.StructField("heads", _LISTS)])
_STRETCH = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("q", "lo", "hi")), T.StructField("blocks", T.ArrayType(_BLOCK))])


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 1, 3: the owners 0 0 1 2 2 2, and the steps 0 1 0 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _highest(products: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each query and place the highest product of its headings on the page, -inf where there is none."""
    owner, step = _steps(counts)
    out = np.full(products.shape, -np.inf)
    for k in range(int(counts.max(initial=0))):
        here = (step == k) & ~np.isnan(heads)
        to, at = owner[here], heads[here].astype(int)
        out[:, to] = np.maximum(out[:, to], products[:, at])
    return out


def _search(products: np.ndarray, high: np.ndarray, plain: Callable, block: np.ndarray, first: np.ndarray, free: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, first and last place of each stretch. high: the product of a strong section, else -inf. Without a boost a relevant score is needed; a boost needs a score, and a
    relevant paragraph or a strong section."""
    s, least = plain(products), C.MIN_MATCH_PERCENT / 100 - SLACK
    order = np.argsort(block, kind="stable")
    counts = np.bincount(block)
    par = (np.add.reduceat(s[:, order], np.cumsum(counts) - counts, axis=1) / counts)[:, block]
    boosted = body & (s >= C.MINIMUM_SECTION_EVIDENCE - SLACK) & ((par >= least) | (high > -np.inf))
    good = free & ((s >= least) | boosted)
    pair = good[:, :-1] & good[:, 1:] & (first[:-1] == first[1:])
    edge = np.pad(pair, ((0, 0), (1, 1)))
    q, lo = np.nonzero(pair & ~edge[:, :-2])
    return q, lo, np.nonzero(pair & ~edge[:, 2:])[1] + 1


def _matrix(vectors: pa.Array) -> np.ndarray:
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _listed(counts: list[np.ndarray], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32()), values)


def _searched(plain: Callable) -> Callable[..., Column]:
    @F.arrow_udf(T.ArrayType(_STRETCH))
    def found(vectors: pa.Array, asked: pa.Array, places: pa.Array) -> pa.Array:
        """The stretches of each row: a page's vectors, the queries' vectors and what stands at the page's places."""
        out = []
        for v, a, p in zip(vectors, asked, places, strict=True):
            products = np.clip(_matrix(a.values) @ _matrix(v.values).T, -1, 1)
            p = p.values
            block, first, free, body = (p.field(c).to_numpy(zero_copy_only=False) for c in ("block", "first", "free", "body"))
            heads = p.field("heads")
            high = _highest(products, heads.flatten().to_numpy(zero_copy_only=False).astype(float), heads.value_lengths().to_numpy(zero_copy_only=False))
            high[plain(high) < C.STRONG_SECTION - SLACK] = -np.inf  # a weak section changes nothing
            q, lo, hi = _search(products, high, plain, block, first, free, body)
            # the blocks of each stretch, and the places of each of them
            owner, step = _steps(hi - lo + 1)
            counts = np.bincount(block)
            of, b = np.divmod(np.unique(owner * len(counts) + block[lo[owner] + step]), len(counts))
            owner, step = _steps(counts[b])
            at = np.argsort(block, kind="stable")[(np.cumsum(counts) - counts)[b[owner]] + step]
            out.append((np.array([len(q)]), q, lo, hi, np.bincount(of, minlength=len(q)), b, counts[b], products[q[of[owner]], at], high[q[of[owner]], at]))
        n, q, lo, hi, of, b, counts, products, high = zip(*out, strict=True)
        whole = lambda parts: pa.array(np.concatenate(parts), pa.int32())
        high = np.concatenate(high)
        scored = [whole(b), _listed(counts, pa.array(np.concatenate(products))), _listed(counts, pa.array(high, mask=np.isinf(high)))]
        blocks = _listed(of, pa.StructArray.from_arrays(scored, names=_BLOCK.names))
        return _listed(n, pa.StructArray.from_arrays([whole(q), whole(lo), whole(hi), blocks], names=_STRETCH.names))

    return found


def stretches(queries: DataFrame, passages: DataFrame, score: Callable[[Column], Column], plain: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of paged.in_blocks(paged.with_percents(paged.meet()), around=True) that have a member with something near, with
    the columns that neighbours() takes. A block that several stretches touch has a row for each; section_similarity is 0 for a
    weak section too.

    score never falls as the product grows; plain is score over arrays, but for the rounding.
    """
    met, size = paged.crossed(queries, passages, _compact, ("words", "numbers"))
    met = met.select("snapshot_id", "_blocks", "_asked", _searched(plain)("_vectors", "_vs", "_places").alias("_found"))
    dealt = met.repartition(max(8, -(-size // paged.PRODUCTS)), "snapshot_id")
    said = lambda z: F.transform(z["blocks"], lambda c: F.struct(c.alias("c"), F.get("_blocks", c["b"]).alias("b")))
    each = F.transform("_found", lambda z: F.struct(F.get("_asked", z["q"]).alias("a"), z["lo"].alias("lo"), z["hi"].alias("hi"), said(z).alias("said")))
    rows = dealt.select("snapshot_id", F.explode(each).alias("_z")).select("snapshot_id", "_z.a.query_id", "_z.a._a", "_z.lo", "_z.hi", "_z.said")
    scored = lambda x: score(paged.whole(x) / float(10**paged.DIGITS))

    def member(c: Column, m: Column, k: Column) -> Column:
        head = F.get(c["heads"], k)
        section = F.when(head.isNotNull(), F.greatest(F.lit(0.0), scored(head))).otherwise(0.0)
        return F.struct(*(m[f].alias(f) for f in _MEMBER), scored(F.get(c["products"], k)).alias("score"), section.alias("section_similarity"))

    def block(x: Column) -> Column:
        return F.struct(x["b"]["words"].alias("words"), x["b"]["numbers"].alias("numbers"), F.transform(x["b"]["members"], lambda m, k: member(x["c"], m, k)).alias("members"))

    rows = rows.withColumn("_in", F.transform("said", block)).withColumn("_in", F.transform("_in", lambda b: b.withField("par", paged.mean(b["members"]))))
    lo, hi = F.col("lo"), F.col("hi")
    inside = lambda m: m["i"].between(lo, hi)
    percents = F.flatten(F.transform("_in", lambda b: F.transform(F.filter(b["members"], inside), lambda m: paged.percent(m, m["score"], m["section_similarity"], b["par"]))))
    rows = rows.select("snapshot_id", "query_id", "_a", "lo", "hi", "_in", F.sort_array(percents).alias("_percents"))
    near = lambda m: F.when(inside(m), paged.near(m, lo, hi, lo))
    around = F.transform("_in", lambda b: b.withField("members", F.transform(b["members"], lambda m: m.withField("near", near(m)))))
    rows = rows.select(*GROUP, "_a", F.explode(around).alias("_b")).select(*GROUP, "_a", "_b.words", "_b.numbers", "_b.members", F.col("_b.par").alias("_par"))
    return rows.filter(F.exists("members", lambda m: F.size(m["near"]) > 0))


def _compact(pages: DataFrame) -> DataFrame:
    """Blocks with what the rules of neighbours need, and what stands at each place."""
    no = lambda c: F.coalesce(c, F.lit(False))
    place = lambda m, k: F.struct(m["i"].alias("i"), k.alias("block"), m["first"].alias("first"), no(m["kind"] != "heading").alias("free"), no(X.substantive(m["role"])).alias("body"), m["heads"].alias("heads"))
    places = F.array_sort(F.flatten(F.transform("_blocks", lambda b, k: F.transform(b["members"], lambda m: place(m, k)))))
    block = lambda b: F.struct(b["words"].alias("words"), b["numbers"].alias("numbers"), F.transform(b["members"], lambda m: F.struct(*(m[f].alias(f) for f in _MEMBER))).alias("members"))
    return pages.select("snapshot_id", F.transform("_blocks", block).alias("_blocks"), "_vectors", places.alias("_places"))


def neighbours(rows: DataFrame) -> DataFrame:
    """selected, a sentence among the results of a query on a page, and passage_id, one of the passages around it. rows: as of
    stretches(), or whole pages'. A result's lexical score orders it and leaves it in, so it plays no part."""
    chosen = hybrid.relevant(paged.results_before_lexical(rows)).filter(~F.col("is_paragraph"))
    return chosen.select(*GROUP, F.col("passage_id").alias("selected"), F.explode("near").alias("passage_id"))
