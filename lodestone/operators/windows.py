"""Overlapping token windows, and the pairs that a pair model reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config as C


def windows(tokens: Column, size: int, overlap: int | None = None) -> Column:
    """Windows of a token array as structs of tokens, start and end; none for no tokens. The last ends with the array."""
    overlap = size // 4 if overlap is None else overlap
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("invalid token window")
    return _windows(tokens, F.lit(size), F.lit(overlap))


def _windows(tokens: Column, size: Column, overlap: Column) -> Column:
    n, stride = F.size(tokens), size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    cut = lambda i: F.struct(F.slice(tokens, i * stride + 1, size).alias("tokens"), (i * stride).alias("start"), F.least(i * stride + size, n).alias("end"))
    return F.when(n == 0, F.array().cast("array<struct<tokens:array<int>,start:int,end:int>>")).otherwise(F.transform(F.sequence(F.lit(0), last), cut))


def or_empty(found: Column) -> Column:
    """One empty window where there is none."""
    empty = F.array(F.struct(F.array().cast("array<int>").alias("tokens"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    return F.when(F.size(found) == 0, empty).otherwise(found)


def embedding_windows(tokens: Column, prefix: int = 0) -> Column:
    return or_empty(windows(tokens, C.EMBEDDING_TOKENS - prefix, C.EMBEDDING_OVERLAP))


def embedding_input(prefix: Column, tokens: Column) -> Column:
    """What an embedding model reads: start, prefix, window, end."""
    return F.concat(F.array(F.lit(C.EMBED_CLS)), prefix, tokens, F.array(F.lit(C.EMBED_SEP)))


def pair_windows(query: Column, body: Column, section: Column, most: int = C.PAIR_TOKENS) -> Column:
    """All inputs of a pair model for a query and a text: parts of the query, each with windows of the body.

    Nothing is cut off: each token of the query and of the body is in some input, and none is longer than most.
    """
    if not isinstance(most, int) or not C.PAIR_TOKENS_LEAST <= most <= C.PAIR_TOKENS_NATIVE:
        raise ValueError("invalid pair length")
    prefix = F.slice(section, 1, C.SECTION_PREFIX_TOKENS)
    part = F.least(F.lit(256), F.lit(most) - F.size(prefix) - 67)
    parts = or_empty(_windows(query, part, F.lit(32)))

    def of(p: Column) -> Column:
        room = F.lit(most) - F.size(p["tokens"]) - F.size(prefix) - 3
        targets = or_empty(_windows(body, room, F.least(F.lit(64), room - 1)))
        join = lambda t: F.concat(F.array(F.lit(C.PAIR_CLS)), p["tokens"], F.array(F.lit(C.PAIR_SEP)), prefix, t["tokens"], F.array(F.lit(C.PAIR_SEP)))
        return F.transform(targets, join)

    return F.flatten(F.transform(parts, of))


def register(spark) -> None:
    """token_windows(tokens, size, overlap) as a table function for SQL: window_no, tokens, start, end."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="window_no int, tokens array<int>, start int, end int")
    class TokenWindows:
        def eval(self, tokens: list, size: int, overlap: int):  # noqa: A003
            if size < 1 or overlap < 0 or overlap >= size:
                raise ValueError("invalid token window")
            number, end = 0, 0
            while end < len(tokens):
                start = number * (size - overlap)
                end = min(start + size, len(tokens))
                yield number, list(tokens[start:end]), start, end
                number += 1

    spark.udtf.register("token_windows", TokenWindows)


def session_id() -> Column:
    """128 random bits in hexadecimal."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
