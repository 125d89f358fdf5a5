"""Debouncing, coalescing and latest-wins, for batches and for streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watermarked(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withWatermark("ts", delay) if rows.isStreaming else rows


def debounced(rows: DataFrame, quiet: str = "400 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The last query of each burst of a user's keystrokes; a blank one clears and so isn't emitted.

    rows: user_id, ts, query. A burst ends when nothing follows for as long as quiet. A stream needs the watermark's delay
    before it emits; later keystrokes than that are dropped.
    """
    found = _watermarked(rows, delay).groupBy("user_id", F.session_window("ts", quiet).alias("w")).agg(F.max_by("query", F.struct("ts", "query")).alias("query"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("keystrokes"))
    return found.filter(F.trim("query") != "").select("user_id", F.trim("query").alias("query"), "at", "keystrokes")


def coalesced(rows: DataFrame, quiet: str = "250 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """One row for each burst of changes of a page: user_id, began, changes."""
    found = _watermarked(rows, delay).groupBy("user_id", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return found.select("user_id", F.col("w.start").alias("began"), "changes")


def accepted(rows: DataFrame) -> DataFrame:
    """The newest generation of each user, if its query isn't blank; results of older ones are stale."""
    newest = rows.groupBy("user_id").agg(F.max(F.struct("generation", "query")).alias("r"))
    return newest.select("user_id", "r.generation", "r.query").filter(F.trim("query") != "")


def conflated(rows: DataFrame, slot: Column) -> DataFrame:
    """Of the requests that arrive while one runs, the newest: one for each user and slot."""
    return rows.groupBy("user_id", slot.alias("slot")).agg(F.max("generation").alias("generation"))


def routes(rows: DataFrame) -> DataFrame:
    """Sessions both of whose ports have connected, when, and the last focus sent before, which waits until then.

    rows: session_id, at, port of content, panel or focus.
    """
    first = rows.groupBy("session_id").agg(F.min(F.when(F.col("port") == "content", F.col("at"))).alias("c"), F.min(F.when(F.col("port") == "panel", F.col("at"))).alias("p"))
    paired = first.filter("c is not null and p is not null").select("session_id", F.greatest("c", "p").alias("paired_at"))
    waiting = rows.filter("port = 'focus'").join(paired, "session_id").filter("at <= paired_at").groupBy("session_id").agg(F.max("at").alias("focus"))
    return paired.join(waiting, "session_id", "left")


def changes_that_count(rows: DataFrame, watched: tuple[str, ...] = ("hidden", "aria-hidden", "style", "class", "open", "role", "aria-level")) -> DataFrame:
    """Mutations that can change the text: none of the engine's own nodes, and of attributes only those watched.

    rows: own, kind of childList, characterData or attributes, attribute.
    """
    return rows.filter(~F.col("own") & (F.col("kind").isin("childList", "characterData") | ((F.col("kind") == "attributes") & F.col("attribute").isin(*watched))))
