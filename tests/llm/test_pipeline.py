import hashlib
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import quality
from lodestone.llm import queries as corpus
from tests_llm_helpers import jaccard_expected

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, steps = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        steps[name] = (docs, out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    assert list(steps) == ["quality", "exact_dedup", "jaccard_join", "pii", "packing"]

    before, after = steps["quality"]
    model = quality.train(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scores(before, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == good and 0 < len(good) < before.count()

    before, after = (x.collect() for x in steps["exact_dedup"])
    last = defaultdict(int)
    for r in before:
        last[r["text"]] = max(last[r["text"]], r["doc_id"])
    assert {tuple(r) for r in after} == {tuple(r) for r in before if last[r["text"]] == r["doc_id"]}

    before, after = (x.collect() for x in steps["jaccard_join"])
    stays = {i for i, _, component in jaccard_expected(before) if i == component}
    assert {r["doc_id"] for r in after} == stays

    before, after = ({r["doc_id"]: r for r in x.collect()} for x in steps["pii"])
    assert before.keys() == after.keys()
    assert all(len(before[i]["text"]) >= 0 and before[i]["source"] == after[i]["source"] for i in before)

    texts, pieces = (x.collect() for x in steps["packing"])
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in texts}
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = corpus.queries()[name](spark, DIR)
    cursor = con.execute(corpus.oracle_sql()[name])
    order = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cursor.fetchall())


def test_every_operator_has_a_query(spark):
    found = corpus.queries()
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in found) == 1] == list(range(1, 11))
    for name in ("op6_quality", "op8_line_dedup", "op10_pii"):
        df = found[name](spark, DIR)
        assert df.count() == spark.read.parquet(f"{DIR}/documents.parquet").count() and "doc_id" in df.columns


def test_line_query_hashes_the_kept_text(spark):
    rows = corpus.queries()["op8_line_dedup"](spark, DIR).filter("n_removed = 0").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert rows and all(r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
