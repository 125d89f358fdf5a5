"""The engine's queries over the standard tables. Each runs over its whole tables; plans/oracles.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import cache, context, evaluate, lexical, paged, ranking, rerank, section, segment, similarity, snapshot, stretches, windows
from lodestone.plans import surrogate as S
from lodestone.plans.cut import cut
from lodestone.plans.oracles import oracle_sql
from lodestone.plans.search import hashing_embedder, search
from lodestone.plans.surrogate import table
from lodestone.sources import assets, pages, synthetic
from lodestone.streaming import events as ev

__all__ = ["flagship", "oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_all)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.passages(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- passages of texts


@query
def passages_sentences(spark, sf_dir):
    return _passages(spark, sf_dir).select("snapshot_id", "passage_id", "ord", "block_id", "text", "kind", "role")


@query
def role_counts(spark, sf_dir):
    return _passages(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def neighbor_text(spark, sf_dir):
    return _passages(spark, sf_dir).select("snapshot_id", "ord", "before", "after")


@query
def block_members(spark, sf_dir):
    return segment.blocks(_passages(spark, sf_dir)).select("snapshot_id", "block_id", "text", F.size("passage_ids").alias("members"), F.array_join("passage_ids", " ").alias("ids"))


@query
def snapshot_metrics(spark, sf_dir):
    return segment.metrics(_passages(spark, sf_dir))


@query
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.collapse(F.col("text")).alias("text"))


@query
def section_text(spark, sf_dir):
    """Lines of up to three words head the lines after them; the first line is the title."""
    rows = _passages(spark, sf_dir)
    words = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{N}]*"), F.lit(0)))
    level = F.when(F.col("ord") == 0, 1).when(words <= 3, 2)
    rows = rows.withColumn("heading_level", level).withColumn("kind", F.when(level.isNotNull(), "heading").otherwise("sentence")).withColumn("role", F.lit("body"))
    before = Window.partitionBy("snapshot_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    title = F.first(F.when(F.col("heading_level") == 1, F.col("passage_id")), True).over(before)
    last = F.last(F.when(F.col("heading_level") == 2, F.col("passage_id")), True).over(before)
    rows = rows.withColumn("section_heading_ids", F.filter(F.array(title, last), lambda x: x.isNotNull()))
    return section.with_section(rows).select("snapshot_id", "ord", "kind", "section", "text")


@query
def section_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("section"), F.col("lang").alias("text"))
    return section.inputs(rows).select("section", "text", section.section_key().alias("key"))


@query
def page_subjects(spark, sf_dir):
    rows = _passages(spark, sf_dir).withColumn("heading_level", F.when(F.col("pos") == 0, 1)).withColumn("kind", F.when(F.col("pos") == 0, "heading").otherwise("sentence"))
    return segment.subject(rows)


@query
def coverage_notes(spark, sf_dir):
    frames = table(spark, sf_dir, "pages").select(F.col("page_id").alias("snapshot_id"), (~F.col("html").contains("</nav>")).alias("accessible"))
    return segment.coverage_note(frames)


@query
def preview(spark, sf_dir):
    n = F.length("text")
    start = F.col("doc_id").cast("int") % 200
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), F.least(start, n), F.least(start + 300, n)).alias("preview"))


@query
def highlight_ranges(spark, sf_dir):
    """Where each sentence stands in its block, and whether the block has it there."""
    rows = _passages(spark, sf_dir)
    whole = segment.blocks(rows).select("snapshot_id", "block_id", F.col("text").alias("block_text"))
    before = Window.partitionBy("snapshot_id", "block_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    placed = rows.withColumn("start", start.cast("int")).withColumn("end", (start + F.length("text")).cast("int")).join(whole, ["snapshot_id", "block_id"])
    return placed.select("snapshot_id", "ord", "start", "end", context.valid_range(F.col("block_text"), F.col("text"), F.col("start"), F.col("end")).alias("valid"))


# ---------------------------------------------------------------- tokens


@query
def lexical_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.lexical_tokens(F.col("text")), " ").alias("tokens"), F.size(X.without_stop_words(X.lexical_tokens(F.col("text")))).alias("kept"))


@query
def stem_histogram(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(X.stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


@query
def token_windows(spark, sf_dir):
    ids = F.transform(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""), lambda w: F.length(w))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(windows.windows(ids, C.EMBEDDING_TOKENS, C.EMBEDDING_OVERLAP)).alias("window_no", "w"))
    return found.select("doc_id", "window_no", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.aggregate("w.tokens", F.lit(0), lambda s, x: s + x).alias("token_sum"))


@query
def embedding_inputs(spark, sf_dir):
    ids = F.transform(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""), lambda w: F.length(w))
    prefix = F.array(F.lit(7), F.lit(8))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(windows.embedding_windows(ids, 2)).alias("window_no", "w"))
    made = windows.embedding_input(prefix, F.col("w.tokens"))
    return rows.select("conv_id", "turn", "window_no", F.size(made).alias("length"), F.aggregate(made, F.lit(0), lambda s, x: s + x).alias("token_sum"))


def _turn_pairs(spark, sf_dir) -> DataFrame:
    """Each user turn with the turn that answers it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return asked.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body")), ["conv_id", "turn"])


@query
def pair_windows_count(spark, sf_dir):
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.lit(1))
    pairs = _turn_pairs(spark, sf_dir).select("conv_id", "turn", chars("query").alias("q"), chars("body").alias("b"))
    made = pairs.select("conv_id", "turn", F.transform(windows.pair_windows(F.col("q"), F.col("b"), F.array(F.lit(5), F.lit(6)), 256), lambda x: F.size(x)).alias("sizes"))
    return made.select("conv_id", "turn", F.size("sizes").alias("pairs"), F.array_max("sizes").alias("longest"), F.aggregate("sizes", F.lit(0), lambda s, x: s + x).alias("tokens"))


@query
def is_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_question(F.col("text")).alias("question"))


@query
def standalone_numbers(spark, sf_dir):
    tenths = F.expr("concat(cast(cast(floor(value * 10) as bigint) div 10 as string), '.', cast(cast(floor(value * 10) as bigint) % 10 as string))")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("about "), F.col("user_id").cast("string"))).otherwise(F.concat(tenths, F.lit(" - "), (F.col("user_id") % 5).cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("how many "), tenths).alias("query"), text.alias("text"))
    return rows.select("event_id", "text", X.standalone_number(F.col("query"), F.col("text")).alias("excluded"), F.array_join(X.numbers(F.col("text")), " ").alias("numbers"))


@query
def exact_phrase(spark, sf_dir):
    """Documents that hold a benchmark text word for word: places of its first word, then the words from there on."""
    said = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("words"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", X.words(F.col("text")).alias("phrase")).filter(F.size("phrase") > 0)
    # the pair of the first two words names a place; a phrase of one word is met by the word
    key = lambda words, i: F.xxhash64(F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit("")))
    places = said.select("doc_id", "words", F.explode(F.array_distinct(F.transform("words", lambda w, i: key(F.col("words"), i)))).alias("_k"))
    met = places.join(asked.filter(F.size("phrase") > 1).withColumn("_k", key(F.col("phrase"), F.lit(0))), "_k")
    several = met.filter(X.contains_phrase(F.col("words"), F.col("phrase"))).select("doc_id", "item_id")
    single = asked.filter(F.size("phrase") == 1).select("item_id", F.get("phrase", F.lit(0)).alias("_w"))
    return several.unionByName(said.select("doc_id", F.explode(F.array_distinct("words")).alias("_w")).join(single, "_w").select("doc_id", "item_id"))


# ---------------------------------------------------------------- BM25


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each conversation is a page, its turns the passages; its first user turn is the query."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query")).withColumnRenamed("conv_id", "query_id")
    rows = turns.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("ord"), "text")
    return asked, rows


@query
def bm25_scores(spark, sf_dir):
    asked, rows = _candidates(spark, sf_dir)
    return lexical.bm25(asked, rows, ranking.GROUP, "ord").select("query_id", "ord", F.round("lexical", 6).alias("lexical"))


@query
def bm25_topk(spark, sf_dir):
    asked, rows = _candidates(spark, sf_dir)
    scored = lexical.bm25(asked, rows, ranking.GROUP, "ord").withColumn("lexical", F.round("lexical", 6))
    best = similarity.top(scored, 3, ["query_id"], [F.col("lexical").desc(), F.col("ord")])
    return best.select("query_id", "ord", "lexical", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)


# ---------------------------------------------------------------- vectors


@query
def unit_vectors(spark, sf_dir):
    return S.unit_vectors(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("vector")), 6).alias("norm"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").alias("dim"))


@query
def cosine_scores(spark, sf_dir):
    return S.cosines(spark, sf_dir)


@query
def cosine_topk(spark, sf_dir):
    best = similarity.top(S.cosines(spark, sf_dir, C.RERANK_CANDIDATES), C.RERANK_CANDIDATES, ["query_id"], [F.col("score").desc(), F.col("vec_id")])
    return best.select("query_id", "vec_id", "score", "rank")


def _label_windows(spark, sf_dir) -> DataFrame:
    """Labels as targets, their vectors as windows; two neighbouring query rows as one query's windows."""
    found = S.cosines(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return found.select(F.expr("query_id div 100").alias("query_id"), F.expr("cast(query_id % 100 div 50 as int)").alias("q_no"), "label", F.col("vec_id").cast("int").alias("w_no"), "score", F.col("vec_id").cast("int").alias("start"), (F.col("vec_id") + 1).cast("int").alias("end"))


@query
def max_pool(spark, sf_dir):
    return similarity.pooled(_label_windows(spark, sf_dir), ["label"]).select("query_id", "label", F.round("score", 7).alias("score"))


@query
def mean_pool(spark, sf_dir):
    return similarity.pooled(_label_windows(spark, sf_dir), ["label"], whole=True).select("query_id", "label", F.round("score", 7).alias("score"))


@query
def argmax_window(spark, sf_dir):
    return similarity.pooled(_label_windows(spark, sf_dir), ["label"]).select("query_id", "label", "start", "end")


@query
def relevance_flags(spark, sf_dir):
    rows = S.scores(spark, sf_dir)
    return rows.select("query_id", "passage_id", F.round(V.match_percent(F.col("score")), 4).alias("percent"), V.is_relevant(F.col("score")).alias("relevant"))


# ---------------------------------------------------------------- ranking


def _met_blocks(spark, sf_dir) -> DataFrame:
    return paged.in_blocks(S.met(spark, sf_dir))


@query
def evidence_ranking(spark, sf_dir):
    rows = paged.ranked(_met_blocks(spark, sf_dir))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*ranking.GROUP).orderBy(*ranking.order())))
    return rows.select("query_id", "snapshot_id", "passage_id", F.round("evidence_score", 6).alias("evidence_score"), F.round("section_boost", 6).alias("section_boost"), F.round("paragraph_boost", 6).alias("paragraph_boost"), "tier", F.round("value", 9).alias("value"), "exact_match", "reason", "rank")


@query
def adaptive_paragraphs(spark, sf_dir):
    found = paged.adaptive(_met_blocks(spark, sf_dir))
    return found.select("query_id", "snapshot_id", "passage_id", "is_paragraph", F.round("score", 6).alias("score"), F.round("evidence_score", 6).alias("evidence_score"), "tier", F.round("value", 9).alias("value"), F.col("focus.passage_id").alias("focus_id"))


def _question_rows(spark, sf_dir) -> DataFrame:
    return paged.question_rows(paged.results_before_lexical(_met_blocks(spark, sf_dir)), sentence=0.9, paragraph=1.1)


@query
def question_cutoff(spark, sf_dir):
    return _question_rows(spark, sf_dir).select("query_id", "snapshot_id", "passage_id", "is_paragraph", F.round("question_score", 9).alias("question_score"), F.round("value", 9).alias("value"))


def _results(spark, sf_dir) -> DataFrame:
    return paged.finalize(paged.results_before_lexical(_met_blocks(spark, sf_dir)), S.queries(spark, sf_dir))


@query
def hybrid_final(spark, sf_dir):
    return _results(spark, sf_dir).select("query_id", "snapshot_id", "passage_id", "is_paragraph", "tier", F.round("value", 9).alias("value"), "rank")


@query
def hybrid_question(spark, sf_dir):
    found = paged.finalize(_question_rows(spark, sf_dir), S.queries(spark, sf_dir))
    return found.select("query_id", "snapshot_id", "passage_id", "is_paragraph", F.round("value", 9).alias("value"), "rank")


@query
def result_positions(spark, sf_dir):
    return context.positions(_results(spark, sf_dir)).select("query_id", "snapshot_id", "rank", "of", "previous", "next")


@query
def result_page(spark, sf_dir):
    found = similarity.top(S.cosines(spark, sf_dir), 1 << 30, ["query_id"], [F.col("score").desc(), F.col("vec_id")])
    return context.page(found, 1).select("query_id", "vec_id", "rank")


def _rescored(spark, sf_dir) -> DataFrame:
    rows = S.scores(spark, sf_dir)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*ranking.GROUP).orderBy(F.col("score").desc(), "passage_id"))).filter(F.col("rank") <= C.RERANK_CANDIDATES)
    return ranked.withColumn("rerank_score", F.when(F.col("rank") % 9 == 5, F.lit(float("nan"))).otherwise(F.round(12 * F.col("score") - F.col("rank") % 4, 4)))


@query
def rerank_filter(spark, sf_dir):
    return rerank.filter_reranked(_rescored(spark, sf_dir)).select("query_id", "snapshot_id", "passage_id", "rerank_score")


@query
def rerank_order(spark, sf_dir):
    good = _rescored(spark, sf_dir).filter(V.finite(F.col("rerank_score")))
    return rerank.reranked_order(good).select("query_id", "snapshot_id", "passage_id", "rerank_score", "rerank_rank")


@query
def rerank_pairs(spark, sf_dir):
    """The pair model's place is taken by a plain rule, the share of ones among a window's tokens."""
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) % 7)
    pairs = _turn_pairs(spark, sf_dir).select(F.col("conv_id").alias("query_id"), F.lit(0).cast("long").alias("snapshot_id"), F.col("turn").cast("string").alias("passage_id"), chars("query").alias("query_tokens"), chars("body").alias("body_tokens"), F.array().cast("array<int>").alias("section_tokens"))
    scored = rerank.pair_scores(pairs, lambda batch: [float((x == 1).mean()) for x in batch], most=256)
    return scored.select("query_id", "passage_id", F.round("rerank_score", 6).alias("rerank_score"))


@query
def context_runs(spark, sf_dir):
    return stretches.neighbours(S.stretches(spark, sf_dir))


# ---------------------------------------------------------------- caches, versions


def _inputs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.col("source").alias("section"), F.explode(F.split("text", "\n")).alias("text"))


@query
def dedup_inputs(spark, sf_dir):
    return section.inputs(_inputs(spark, sf_dir))


@query
def incremental_missing(spark, sf_dir):
    rows = _inputs(spark, sf_dir)
    return cache.missing(section.inputs(rows), section.inputs(rows.filter("lang <> 'en'")), ["section", "text"])


@query
def cache_retain(spark, sf_dir):
    rows = _inputs(spark, sf_dir)
    return cache.retained(section.inputs(rows.filter("lang <> 'en'")), rows.filter("lang <> 'fr'"), ["section", "text"])


@query
def cache_refresh(spark, sf_dir):
    rows = _inputs(spark, sf_dir)
    value = lambda df, v: df.withColumn("value", F.lit(v) + F.length("text"))
    return cache.refreshed(value(section.inputs(rows.filter("lang <> 'en'")), 1000), section.inputs(rows.filter("lang <> 'fr'")), ["section", "text"], lambda df: value(df, 0))


@query
def pair_cache(spark, sf_dir):
    return cache.least_recent_out(table(spark, sf_dir, "events"), ["user_id"], C.PAIR_CACHE, ["event_type"], "ts").select("event_type", "user_id", "last_used")


@query
def ranking_cache(spark, sf_dir):
    return cache.first_in_first_out(table(spark, sf_dir, "events"), ["user_id"], C.RANKING_CACHE, ["event_type"], "ts").select("event_type", "user_id", "first_used")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "documents")
    new = old.withColumn("text", F.when((F.col("lang") == "en") & (F.col("n_chars") % 2 == 0), F.regexp_replace("text", "the", "teh")).otherwise(F.col("text")))
    return segment.passages(old), segment.passages(new, version=2)


@query
def snapshot_diff(spark, sf_dir):
    return snapshot.changes(*_versions(spark, sf_dir))


@query
def snapshot_versions(spark, sf_dir):
    old, new = (snapshot.content_hash(p) for p in _versions(spark, sf_dir))
    return snapshot.next_versions(old.withColumn("version", F.lit(1)), new).select("snapshot_id", "version")


# ---------------------------------------------------------------- event streams, as batches


@query
def debounced_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("query"))
    return ev.debounced(rows, "1 hour").select("user_id", "query", "at", "keystrokes")


@query
def mutation_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type <> 'view'").select("user_id", "ts")
    return ev.coalesced(rows, "6 hours").select("user_id", "began", "changes")


@query
def latest_generation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("generation"), F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("query"))
    return ev.accepted(rows).select("user_id", "generation", "query")


@query
def conflated_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("generation"), "ts")
    return ev.conflated(rows, F.date_trunc("day", "ts")).select("user_id", "slot", "generation")


@query
def session_routes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.when(F.col("role") == "user", "content").when(F.col("role") == "assistant", "panel").otherwise("focus").alias("port"))
    return ev.routes(rows).select("session_id", "paired_at", "focus")


# ---------------------------------------------------------------- exports, evaluation, sources


@query
def label_export(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query"), F.col("source").alias("effective_query"), F.sha2("text", 256).alias("passage"), (F.col("n_chars") % 10).alias("score"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return evaluate.label_lines(rows, marks, ["doc_id"], "none", "v1")


@query
def eval_mrr_recall(spark, sf_dir):
    found = evaluate.by_score(S.cosines(spark, sf_dir).filter("query_id <> vec_id"), ["query_id"], ["vec_id"])
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = labels.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    marks = labels.join(asked, "label").filter("query_id <> vec_id").select("query_id", "vec_id")
    report = evaluate.report(evaluate.first_relevant(marks, found, ["vec_id"]))
    return report.select("queries", F.round("mrr", 6).alias("mrr"), F.round("recall_at_3", 6).alias("recall_at_3"))


@query
def page_digests(spark, sf_dir):
    return assets.verified(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.sha2("html", 256).alias("expected"))).select("path", "sha256", "verified")


@query
def synthetic_sentences(spark, sf_dir):
    return synthetic.long_page(spark)


@query
def pages_extract(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def page_passages(spark, sf_dir):
    found = pages.passages(pages.extract(table(spark, sf_dir, "pages")))
    return found.drop("section_heading_ids").withColumn("sections", F.lit(0))


@query
def search_pages(spark, sf_dir):
    """The whole search, over the extracted pages: each page is asked for its own subject, with vectors of hashed words."""
    extracted = cut(pages.extract(table(spark, sf_dir, "pages")))
    asked = extracted.filter("subject is not null").select(F.col("snapshot_id").alias("query_id"), "snapshot_id", F.col("subject").alias("query"))
    found = search(asked, pages.passages(extracted), pages.blocks(extracted), hashing_embedder(256)).results()
    return found.select("query_id", "snapshot_id", "passage_id", "is_paragraph", "text", F.round("score", 6).alias("score"), "rank")
