"""Text functions as column expressions. Everything but Unicode normalisation stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import config as C

#: White space as the web counts it, which is more than Java's \s.
WHITE = r"[\s   -     　﻿]"
_BREAK = "\u0001"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Lower case, NFD, and no combining marks."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.category(c).startswith("M")))


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none in front."""
    return F.regexp_replace(F.regexp_replace(text, WHITE + "+", " "), "^ ", "")


def sentences(text: Column) -> Column:
    """Sentences by a simple rule: a break after . ! ? and closing marks before blanks; trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?]+[\"')\]]*)[ ]+", "$1" + _BREAK)
    return F.filter(F.transform(F.split(marked, _BREAK), lambda s: F.trim(s)), lambda s: s != "")


_STOP = re.compile(r"[.!?…。！．？]+[\"'’”)\]}»]*\s*|[\r\n  ]+")


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    """Sentences in the manner of Unicode's sentence rules, trimmed, with their offsets in code points.

    A full stop doesn't end one before a digit, before a lower-case word, or between letters without a blank.
    """
    out, begin = [], 0
    for m in _STOP.finditer(text):
        end, mark = m.end(), m.group()
        if begin > m.start() or not mark:
            continue
        if mark[0] == "." and end < len(text):
            rest = re.match(r"[^\w\r\n]*", text[end:]).end()
            following = text[end + rest : end + rest + 1]
            if following.islower() or (not mark[-1].isspace() and text[end].isalnum()):
                continue
        elif mark[0] in "!?" and not mark[-1].isspace() and end < len(text) and text[end].isalnum() and text[end].isascii():
            pass
        out.append((begin, end))
        begin = end
    if begin < len(text):
        out.append((begin, len(text)))
    found = []
    for a, b in out:
        piece = text[a:b]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            found.append((body, a + lead, a + lead + len(body)))
    return found


_SPAN = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
SENTENCE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *_SPAN]))


@F.pandas_udf(SENTENCE)
def unicode_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [] if x is None else [{"text": t, "start": a, "end": b} for t, a, b in split_sentences(x)])


def words(text: Column, normalised: bool = True) -> Column:
    """Letters and digits in runs, lower case before NFKC. normalised says that the text is in NFKC already."""
    low = F.lower(text)
    return F.regexp_extract_all(low if normalised else nfkc(low), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem(word: Column) -> Column:
    """Plural endings off; the first rule that fits counts."""
    n = F.length(word)
    return (
        F.when(word.isin(*C.INVARIANT_WORDS), word)
        .when((n > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(sses|shes|ches|xes|zes|uses)$"), word.substr(F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def lexical_tokens(text: Column, normalised: bool = True) -> Column:
    """Stemmed words, NFKC before lower case, stop words included."""
    low = F.lower(text if normalised else nfkc(text))
    return F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), stem)


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*C.STOP_WORDS))


def is_question(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:" + "|".join(C.QUESTION_WORDS) + r")(?![A-Za-z0-9_])")


def numbers(text: Column) -> Column:
    """Numeric literals, sign included."""
    return F.regexp_extract_all(text, F.lit(r"[+-]?\p{N}+(?:[.,]\p{N}+)*"), F.lit(0))


def standalone_number(query: Column, text: Column) -> Column:
    """Whether a text is nothing but numbers, of which the query lacks one."""
    only = text.rlike(r"^[\p{N}\s .,+\-−–—()/:\[\]]+$")
    return (F.size(numbers(text)) > 0) & only & (F.size(F.array_except(numbers(text), numbers(query))) > 0)


def excluded_reason(query: Column, text: Column) -> Column:
    return F.when(standalone_number(query, text), F.lit(C.EXCLUDED_NUMBER))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether a token list holds a non-empty phrase without a gap."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - F.size(phrase) + 1))
    return (F.size(phrase) > 0) & (F.size(phrase) <= F.size(tokens)) & F.exists(places, lambda i: F.slice(tokens, i, F.size(phrase)) == phrase)


def role(text: Column, kind: Column, reference: Column, navigation: Column, control: Column) -> Column:
    """The role of a passage; the first that fits counts."""
    few = F.size(F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{N}]*"), F.lit(0))) < 4
    return F.when(reference, "reference").when(navigation, "navigation").when(kind == "heading", "body").when(control, "control").when(few, "fragment").otherwise("body")


def substantive(role_: Column) -> Column:
    """A role that is missing counts as body."""
    return F.coalesce(role_, F.lit("body")) == "body"


def preview(text: Column, start: Column, end: Column) -> Column:
    """240 characters or more from 48 before the match on, with an ellipsis if the text begins earlier."""
    first = F.greatest(F.lit(0), start - 48)
    return F.concat(F.when(first > 0, "…").otherwise(""), F.substring(text, first + 1, F.greatest(first + 240, end) - first))


def ordinal(passage_id: Column) -> Column:
    """The index within a passage id, without the version."""
    return F.split_part(passage_id, F.lit(":"), F.lit(2))


UNKNOWN = "[UNK]"


def _folded(text: str) -> tuple[str, list[int], list[int]]:
    """The text in lower case without marks, and for each of its characters where its source begins and ends (UTF-16)."""
    ends = list(accumulate((1 + (ord(c) > 0xFFFF) for c in text), initial=0))
    plain = ["".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x)[0] != "M") for c in text]
    begin = [ends[i] for i, p in enumerate(plain) for _ in p]
    # a mark of its own belongs to the character before it
    last = [i for i, p in enumerate(plain) if p]
    until = dict(zip(last, (ends[j] for j in [*last[1:], len(plain)]), strict=False))
    return "".join(plain), begin, [until[i] if k == len(p) - 1 else ends[i + 1] for i, p in enumerate(plain) for k, _ in enumerate(p)]


def token_offsets(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Where word pieces of an uncased vocabulary stand in the text, in UTF-16 units.

    Known pieces are placed first, from left to right in the text in lower case without marks. An unknown one fills the gap
    up to the piece after it, without white space at its ends. A known one that isn't found takes the whole text.
    """
    flat, begin, end = _folded(text)
    whole = (0, len(text.encode("utf-16-le")) // 2)
    bare = [p.removeprefix("##").lower() for p in pieces]
    filled = lambda at: at + len(flat[at:]) - len(flat[at:].lstrip())
    places: list[tuple[int, int] | None] = []
    at = 0
    for piece, after, known in zip(bare, [*bare[1:], ""], [p != UNKNOWN for p in pieces], strict=True):
        if known:
            found = flat.find(piece, at)
            places.append((found, found + len(piece)) if found >= 0 else None)
            at = found + len(piece) if found >= 0 else at
        else:
            first = filled(at)
            gap = flat.find(after, first + 1) if after else -1
            at = first + len(flat[first : gap if gap >= 0 else None].rstrip())
            places.append((first, at))
    return [whole if p is None else (begin[p[0]] if p[0] < len(flat) else 0, end[p[1] - 1] if 0 < p[1] <= len(flat) else whole[1]) for p in places]


@F.pandas_udf(T.ArrayType(T.StructType(_SPAN)))
def piece_offsets(text: pd.Series, pieces: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in token_offsets(t, list(p))] for t, p in zip(text, pieces, strict=True)])


def register(spark: SparkSession) -> None:
    """Functions for use in SQL: nfkc, unicode_sentences, and words, lexical_tokens and is_question of normalised texts."""
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("unicode_sentences", unicode_sentences)
    stem_sql = """CASE WHEN w IN ('news', 'series', 'species') THEN w WHEN length(w) > 4 AND w LIKE '%ies' THEN concat(left(w, length(w) - 3), 'y')
        WHEN length(w) > 4 AND w RLIKE '(sses|shes|ches|xes|zes|uses)$' THEN left(w, length(w) - 2)
        WHEN length(w) > 3 AND w LIKE '%s' AND NOT w RLIKE '(ss|us|is)$' THEN left(w, length(w) - 1) ELSE w END"""
    found = r"regexp_extract_all(lower(t), r'[\p{L}\p{N}]+', 0)"
    questions = "|".join(C.QUESTION_WORDS)
    for name, kind, body in (
        ("words", "ARRAY<STRING>", found),
        ("lexical_tokens", "ARRAY<STRING>", f"transform({found}, w -> {stem_sql})"),
        ("is_question", "BOOLEAN", rf"t RLIKE r'(?i)^\s*(?:{questions})(?![A-Za-z0-9_])'"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
