import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.sources import assets, fixtures, pages, safetensors, synthetic


def walk(html):
    return pages.Extractor().run(html)


def test_blocks_exclusions_and_white_space():
    e = walk("<body><p>One  two\n three four.  And five six seven.</p>x<script>no</script>y<textarea>no</textarea><p hidden>no</p><div style='display: none'>no</div><span aria-hidden='true'>no</span><p>a<br>b</p></body>")
    assert [b["text"] for b in e.blocks] == ["One two three four. And five six seven.", "x", "y", "a", "b"]
    assert [p["text"] for p in e.passages][:2] == ["One two three four.", "And five six seven."]
    assert e.passages[0]["after"] == "And five six seven." and e.passages[1]["before"] == "One two three four." and e.passages[0]["before"] == ""
    assert [p["passage_id"] for p in e.passages] == [f"1:{i}" for i in range(len(e.passages))]


def test_roles():
    e = walk("<nav><a>Home and all the others</a></nav><main><header><p>Words within the main header</p></header><button>Press this button right now</button><p>Text with <a>a link in it</a> stays body text</p><p><a>Only a link is here</a></p><p>Three short words</p></main><ol class='references'><li>A book of one author here</li></ol><footer>Footer text of the whole page</footer>")
    assert [p["role"] for p in e.passages] == ["navigation", "body", "control", "body", "control", "fragment", "reference", "navigation"]


def test_headings_and_scopes():
    e = walk("<h1>Title</h1><p>First words of the page.</p><section><h2>Games</h2><p>Games are played all day.</p><h3>Former games</h3><p>They were played long ago.</p></section><p>After the section comes this.</p><h2>Next</h2><p>Now the next part begins.</p><div role='heading' aria-level='3'>Deep</div><p>Something deep down in there.</p>")
    by = {p["text"]: p for p in e.passages}
    text = {p["passage_id"]: p["text"] for p in e.passages}
    heads = lambda t: [text[i] for i in by[t]["section_heading_ids"]]
    assert heads("They were played long ago.") == ["Games", "Former games"] and heads("After the section comes this.") == []
    assert heads("Something deep down in there.") == ["Next", "Deep"] and by["Deep"]["heading_level"] == 3 and by["Games"]["kind"] == "heading" and by["Games"]["sentence_count"] == 0
    assert e.subject == "Title" and by["First words of the page."]["section_heading_ids"] == []


def test_context_groups():
    e = walk("<section><p>One of the first here.</p><p>Two of the first here.</p></section><section><p>Three of the second here.</p></section>")
    groups = [p["context_group"] for p in e.passages]
    assert groups[0] == groups[1] != groups[2]


def test_frames_and_details():
    e = walk("<iframe src='x'></iframe><iframe srcdoc='&lt;h2&gt;In&lt;/h2&gt;&lt;p&gt;Words of the inner page.&lt;/p&gt;'></iframe><details><summary>Summary of it all here</summary><p>Hidden words of the rest.</p></details><details open><summary>Open one</summary><p>Shown words of the rest.</p></details>")
    texts = [p["text"] for p in e.passages]
    assert e.inaccessible == 1 and e.coverage_note == C.COVERAGE_NOTE and "Words of the inner page." in texts
    assert "Hidden words of the rest." not in texts and "Shown words of the rest." in texts


def test_unclosed_tags_and_nothing():
    assert [b["text"] for b in walk("<p>a<p>b<li>c<li>d").blocks] == ["a", "b", "c", "d"]
    assert walk("").passages == [] and walk("<b>x").blocks[0]["text"] == "x"


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<h1>T</h1><p>One two three four. Five six seven eight.</p>"), (2, "u", None)], "page_id long, url string, html string")
    found = pages.extract(df)
    assert {r["snapshot_id"]: (r["subject"], len(r["passages"])) for r in found.collect()} == {1: ("T", 3), 2: (None, 0)}
    assert pages.blocks(found).count() == 2 and pages.passages(found).filter("kind = 'heading'").count() == 1


def test_safetensors(spark, tmp_path):
    a, b = np.arange(6, dtype="<f4"), np.array([1.5], "<f4")
    header = json.dumps({"__metadata__": {"x": "y"}, "a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "F32", "shape": [1], "data_offsets": [24, 28]}}).encode()
    path = tmp_path / "w.safetensors"
    path.write_bytes(struct.pack("<Q", len(header)) + header + a.tobytes() + b.tobytes())
    found = safetensors.read(spark, str(path))
    assert found.keys() == {"a", "b"} and found["a"].tolist() == a.tolist() and found["b"].tolist() == [1.5]
    wrong = json.dumps({"a": {"dtype": "F16", "shape": [1], "data_offsets": [0, 2]}}).encode()
    with pytest.raises(ValueError, match="type"):
        safetensors.parse(struct.pack("<Q", len(wrong)) + wrong + b"ab")


def test_assets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert bytes(assets.load(spark, str(tmp_path), {"a.bin": good}).first()["content"]) == b"abc"
    with pytest.raises(Exception, match="checksum"):
        assets.load(spark, str(tmp_path), {"a.bin": "0" * 64}).select("content").collect()


def test_fixtures_and_synthetic(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a", "relevantElementIds": ["x", "y"]}, {"query": "b", "relevantElementIds": []}]))
    assert [(r["query_id"], r["query"], r["relevant_ids"]) for r in fixtures.labelled_queries(spark, str(tmp_path / "q.json")).collect()] == [(0, "a", ["x", "y"]), (1, "b", [])]
    rows = synthetic.long_page(spark).orderBy(F.col("ord").desc()).collect()
    assert len(rows) == 231 and rows[0]["text"].startswith("The hidden answer")


def test_deep_nesting():
    e = walk("<div>" * 8000 + "<p>Words at the bottom of it all.</p>" + "</div>" * 8000)
    assert [p["text"] for p in e.passages] == ["Words at the bottom of it all."]
