import time

from pyspark.sql import functions as F

from lodestone.plans.search import embed, hashing_embedder
from lodestone.streaming import events as ev
from lodestone.streaming.controller import controlled, step
from lodestone.streaming.incremental import PageRefresher


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("ts", (F.col("ms") / 1000).cast("timestamp")).drop("ms")


def test_debounce_at_its_bounds(spark):
    keys = rows(spark, [(1, "a", 0), (1, "ab", 399), (1, "abc", 399 + 401), (2, "x", 0), (2, "  ", 100)], "user_id long, query string, ms long")
    assert sorted((r["user_id"], r["query"], r["keystrokes"]) for r in ev.debounced(keys).collect()) == [(1, "ab", 2), (1, "abc", 1)]


def test_coalesce_accept_conflate(spark):
    moves = rows(spark, [(1, 0), (1, 200), (1, 451), (2, 0)], "user_id long, ms long")
    assert sorted((r["user_id"], r["changes"]) for r in ev.coalesced(moves).collect()) == [(1, 1), (1, 2), (2, 1)]
    asked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "x"), (2, 6, " ")], "user_id long, generation long, query string")
    assert [(r["user_id"], r["generation"], r["query"]) for r in ev.accepted(asked).collect()] == [(1, 2, "b")]
    assert ev.conflated(asked, F.lit(0)).count() == 2


def test_changes_that_count(spark):
    moves = spark.createDataFrame([(False, "childList", None), (False, "characterData", None), (False, "attributes", "hidden"), (False, "attributes", "data-x"), (True, "childList", None)], "own boolean, kind string, attribute string")
    assert ev.changes_that_count(moves).count() == 3


def test_routes(spark):
    events = spark.createDataFrame([(1, 0, "content"), (1, 1, "focus"), (1, 2, "focus"), (1, 3, "panel"), (2, 0, "content")], "session_id long, at int, port string")
    assert [tuple(r) for r in ev.routes(events).collect()] == [(1, 3, 2)]


def test_controller_steps():
    out, generation, pending = step([("type", "a"), ("type", "ab"), ("flush", ""), ("flush", "")], 0, "")
    assert out == [(2, "ab")] and (generation, pending) == (2, "")
    assert step([("type", "abc"), ("type", "  "), ("flush", "")], 2, "") == ([], 4, "")


def test_debounce_as_a_stream(spark, tmp_path):
    schema = "user_id long, query string, ts timestamp"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = ev.debounced(source, "400 milliseconds", "1 second")
    write = lambda data, name: rows(spark, data, "user_id long, query string, ms long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    write([(1, "a", 0), (1, "ab", 300), (1, "later", 5000)], "1")
    query = out.writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        write([(2, "end", 60_000)], "2")
        query.processAllAvailable()
        query.processAllAvailable()
        assert sorted(r["query"] for r in spark.table("debounced").collect()) == ["ab", "later"]
    finally:
        query.stop()


def test_controller_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("session string, kind string, query string, seq long").json(str(tmp_path / "in"))
    spark.createDataFrame([("s", "type", "a", 1), ("s", "type", "ab", 2), ("s", "flush", "", 3), ("t", "type", "waits", 1)], "session string, kind string, query string, seq long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    query = controlled(source, 400).writeStream.outputMode("append").format("memory").queryName("controlled").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("controlled").count() < 2:
            time.sleep(0.5)
        assert sorted(tuple(r) for r in spark.table("controlled").collect()) == [("s", 2, "ab"), ("t", 1, "waits")]
    finally:
        query.stop()


def test_refresh_makes_vectors_of_new_texts_only(spark, tmp_path):
    refresher = PageRefresher(spark, str(tmp_path), lambda df: embed(df, hashing_embedder()))
    page = lambda i, html: spark.createDataFrame([(i, html)], "page_id long, html string")
    refresher(page(1, "<p>One two three four.</p><p>Five six seven eight.</p>"), 0)
    assert refresher.embedded == 2
    refresher(page(1, "<p>One two three four.</p><p>Five six seven nine.</p>"), 1)
    assert refresher.embedded == 1
    refresher(page(2, "<p>One two three four.</p>"), 2)
    assert refresher.embedded == 0
    assert {r["snapshot_id"]: r["version"] for r in refresher.versions().collect()} == {1: 2, 2: 1}
    assert {r["text"] for r in refresher.vectors().collect()} == {"One two three four.", "Five six seven nine."}


def test_refresh_survives_restarts_and_replays(spark, tmp_path):
    make = lambda: PageRefresher(spark, str(tmp_path), lambda df: embed(df, hashing_embedder()), compact=3)
    rows = lambda *r: spark.createDataFrame(list(r), "page_id long, html string, seen int")
    versions = lambda r: {x["snapshot_id"]: x["version"] for x in r.versions().collect()}
    make()(rows((1, "<p>One two three.</p>", 2), (1, "<p>Older words here.</p>", 1), (None, "<p>No page.</p>", 1)), 0, newest="seen")
    again = make()
    again(rows((1, "<p>Changed by a replay.</p>", 3)), 0, newest="seen")
    assert versions(again) == {1: 1} and {r["text"] for r in again.live().collect()} == {"One two three."}
    again.log.put("live", spark.createDataFrame([("", "Half a batch.", 9, 1)], again.log.schemas["live"]), 1)
    assert {r["text"] for r in make().live().collect()} == {"One two three."}
    make()(rows((1, "", 4), (2, "<p>Four five six.</p>", 4)), 1)
    assert versions(make()) == {1: 2, 2: 1} and {r["text"] for r in make().live().collect()} == {"Four five six."}
    make()(rows((1, "<p>Back with new words.</p>", 5)), 2)
    log = make().log
    assert log.base() == 2 and log.batches() == [] and log.committed(0) and log.committed(2) and not log.committed(3)
    make()(rows((3, "<p>Four five six.</p>", 6)), 3)
    after = make()
    assert versions(after) == {1: 3, 2: 1, 3: 1}
    assert {r["text"] for r in after.live().collect()} == {r["text"] for r in after.vectors().collect()} == {"Back with new words.", "Four five six."}


def test_progress_is_throttled():
    from lodestone.streaming.progress import Throttle

    now, seen = [0.0], []
    throttle = Throttle(seen.append, 0.1, lambda: now[0])
    for t in (0.0, 0.05, 0.09, 0.2, 0.25):
        now[0] = t
        throttle.put({"t": t})
    throttle.close()
    throttle.close()
    assert [x["t"] for x in seen] == [0.0, 0.2, 0.25]
