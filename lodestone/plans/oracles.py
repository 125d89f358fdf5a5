"""The SQL twins of the engine's queries, for DuckDB over the same tables."""

from __future__ import annotations

from lodestone import config as C

_WHITE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def _collapse(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_WHITE}', ' ', 'g'), '^ ', '')"


def _sentences(text: str) -> str:
    marked = rf"""regexp_replace({_collapse(text)}, '([.!?]+["'')\]]*)[ ]+', '\1' || chr(1), 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _stem(w: str) -> str:
    return f"""CASE WHEN {w} IN ('news', 'series', 'species') THEN {w}
      WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN substr({w}, 1, length({w}) - 3) || 'y'
      WHEN length({w}) > 4 AND regexp_matches({w}, '(sses|shes|ches|xes|zes|uses)$') THEN substr({w}, 1, length({w}) - 2)
      WHEN length({w}) > 3 AND {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN substr({w}, 1, length({w}) - 1)
      ELSE {w} END"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def _lexical(text: str) -> str:
    return f"list_transform({_words(text)}, lambda w: {_stem('w')})"


def _kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN ({_STOP}))"


def _phrase(tokens: str, phrase: str) -> str:
    return f"(len({phrase}) > 0 AND contains(' ' || array_to_string({tokens}, ' ') || ' ', ' ' || array_to_string({phrase}, ' ') || ' '))"


_P = f"""lines AS (
  SELECT doc_id, unnest(l) AS body, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), split AS (SELECT doc_id, line, {_sentences("body")} AS s FROM lines
), flat AS (SELECT doc_id, line, unnest(s) AS text, unnest(range(0, len(s))) AS pos FROM split
), p AS (
  SELECT doc_id AS snapshot_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) - 1 AS INTEGER) AS ord, CAST(line AS VARCHAR) AS block_id, pos, text,
    CASE WHEN len(regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{N}}]*')) < 4 THEN 'fragment' ELSE 'body' END AS role
  FROM flat
)"""

_COS = """u AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
), cosines AS (
  SELECT q.vec_id AS query_id, p.vec_id, round(greatest(-1, least(1, list_dot_product(q.e, p.e))), 6) AS score FROM u q, u p WHERE q.vec_id % 50 = 0
)"""

_SCORED = f"""{_COS}, psg AS (
  SELECT vec_id // 100 AS snapshot_id, '1:' || vec_id AS passage_id, vec_id AS ord, vec_id, 'topic ' || label || ' item ' || vec_id % 3 AS text, vec_id % 25 = 0 AS heading,
    CASE vec_id % 11 WHEN 3 THEN 'fragment' WHEN 7 THEN 'navigation' ELSE 'body' END AS role, vec_id // 5 AS block_id, vec_id // 25 AS grp FROM embeddings
), qs AS (
  SELECT vec_id AS query_id, CASE WHEN vec_id % 100 = 0 THEN 'topic ' || label || ' item 0' ELSE 'how many item 1' END AS query FROM embeddings WHERE vec_id % 50 = 0
), sc AS (
  SELECT c.query_id, q.query, p.*, round(greatest(-1, least(1, 2 * c.score)), 6) AS score FROM cosines c JOIN psg p USING (vec_id) JOIN qs q USING (query_id)
), par AS (SELECT query_id, block_id, round(avg(score), 6) AS raw FROM sc GROUP BY ALL)"""


def _evidence(source: str, extra: str = "") -> str:
    """Boosts, evidence, tier, value and reason over own, par, sec, heading, role and exact."""
    return f"""SELECT *, CASE WHEN tier = 4 AND heading THEN 'heading context only' WHEN heading THEN 'heading context only' WHEN tier = 4 THEN 'below cutoff'
        WHEN role = 'body' THEN CASE WHEN sb <> 0 THEN 'body text in matching section' WHEN pb <> 0 THEN 'body text in matching paragraph' ELSE 'body text' END
        WHEN role = 'navigation' THEN 'navigation text' ELSE 'short fragment' END AS reason,
      ev + CASE WHEN exact AND NOT heading THEN {C.EXACT_MATCH_BONUS} ELSE 0 END AS value
    FROM (SELECT *, CASE WHEN NOT (100 * greatest(0, least(1, ev)) >= {C.MIN_MATCH_PERCENT}) THEN 4 WHEN role = 'body' THEN 1 WHEN role = 'fragment' THEN 3 ELSE 2 END AS tier
      FROM (SELECT *, CASE WHEN heading THEN 0 ELSE least(1, own + sb + pb) END AS ev
        FROM (SELECT *, CASE WHEN role = 'body' AND NOT heading AND own >= {C.MINIMUM_SECTION_EVIDENCE} AND sec >= {C.STRONG_SECTION} THEN {C.MAXIMUM_SECTION_BOOST} * CAST(sec AS DOUBLE) ELSE 0 END AS sb,
            CASE WHEN role = 'body' AND NOT heading AND own >= {C.MINIMUM_SECTION_EVIDENCE} AND parsim > own AND 100 * greatest(0, least(1, parsim)) >= {C.MIN_MATCH_PERCENT} THEN least({C.MAXIMUM_PARAGRAPH_BOOST}, parsim - own) ELSE 0 END AS pb
          FROM ({source}))){extra})"""


_RANKED = f"""{_SCORED}, base AS (
  SELECT s.query_id, s.query, s.snapshot_id, s.passage_id, s.ord, s.vec_id, s.text, s.heading, s.role, s.block_id, s.grp, s.score AS own, coalesce(par.raw, s.score) AS parsim,
    CASE WHEN s.heading THEN 0 ELSE greatest(0, coalesce(h.score, 0)) END AS sec, contains(' ' || s.text || ' ', ' ' || s.query || ' ') AS exact, s.text = s.query AS whole
  FROM sc s LEFT JOIN par USING (query_id, block_id) LEFT JOIN sc h ON h.query_id = s.query_id AND h.vec_id = s.grp * 25
), ranked AS ({_evidence("SELECT * FROM base")})"""

_ADAPTIVE = f"""{_RANKED}, members AS (
  SELECT query_id, query, snapshot_id, block_id, count(*) AS n, count(*) FILTER (heading) AS nh, count(*) FILTER (role = 'body') AS nb, count(*) FILTER (role = 'body' AND whole) AS nw,
    arg_min(role, ord) AS first_role, min(ord) AS ord, arg_min(sec, ord) AS sec, max(own) FILTER (role = 'body') AS best, string_agg(text, ' ' ORDER BY ord) AS text FROM ranked GROUP BY query_id, query, snapshot_id, block_id
), chosen AS (
  SELECT m.*, par.raw, (SELECT min(r.ord) FROM ranked r WHERE r.query_id = m.query_id AND r.block_id = m.block_id AND r.role = 'body' AND r.own = m.best) AS focus
  FROM members m JOIN par USING (query_id, block_id) WHERE n >= 2 AND nh = 0 AND nb > 0 AND nw = 0 AND first_role NOT IN ('navigation', 'control', 'reference') AND best - raw <= {C.SENTENCE_FOCUS_MARGIN}
), pbase AS (
  SELECT query_id, query, snapshot_id, '1:' || ord AS passage_id, ord, text, false AS heading, 'body' AS role, block_id, raw AS own, raw AS parsim, sec, contains(' ' || text || ' ', ' ' || query || ' ') AS exact, focus FROM chosen
), paragraphs AS (SELECT * FROM ({_evidence("SELECT * FROM pbase")}) WHERE tier < 4
), adaptive AS (
  SELECT query_id, query, snapshot_id, passage_id, ord, text, role, block_id, own, ev, tier, value, true AS is_paragraph, '1:' || focus AS focus_id FROM paragraphs
  UNION ALL SELECT query_id, query, snapshot_id, passage_id, ord, text, role, block_id, own, ev, tier, value, false, NULL FROM ranked r
  WHERE NOT heading AND NOT EXISTS (SELECT 1 FROM paragraphs p WHERE p.query_id = r.query_id AND p.block_id = r.block_id)
), rows0 AS (SELECT * FROM adaptive WHERE is_paragraph OR role = 'body')"""

_QUESTION = f"""{_ADAPTIVE}, asked AS (
  SELECT a.*, CASE WHEN is_paragraph THEN par.raw * 1.1 ELSE own * 0.9 END AS qs FROM rows0 a LEFT JOIN par USING (query_id, block_id)
), qbody AS (SELECT *, greatest({C.MINIMUM_QUESTION_SCORE}, greatest(0, max(qs) OVER (PARTITION BY query_id, snapshot_id)) - {C.MAXIMUM_QUESTION_DROP}) AS cutoff FROM asked WHERE tier < 4
), rejected AS (SELECT DISTINCT query_id, block_id, cutoff FROM qbody WHERE is_paragraph AND qs < cutoff
), qall AS (
  SELECT query_id, query, snapshot_id, passage_id, ord, text, role, own, ev, tier, value, is_paragraph, qs, cutoff FROM qbody
  UNION ALL SELECT r.query_id, query, snapshot_id, passage_id, ord, text, role, own, ev, tier, value, false, own * 0.9, cutoff FROM ranked r JOIN rejected USING (query_id, block_id) WHERE r.role = 'body' AND r.tier < 4 AND NOT r.heading
), rows1 AS (SELECT * REPLACE ({C.QUESTION_WEIGHT} * qs + (1 - {C.QUESTION_WEIGHT}) * value AS value) FROM qall WHERE qs >= cutoff)"""


def _bm25(rows: str, query: str, keys: str, order: str) -> str:
    """CTEs that end in bm: keys, order and lexical of each of rows (query, text)."""
    return f"""toks AS (SELECT {keys}, {order}, {_lexical("text")} AS t, {_lexical(query)} AS ph FROM {rows}
), lens AS (SELECT *, len({_kept("t")}) AS l, list_distinct({_kept("ph")}) AS terms FROM toks
), stats AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, avg(l) OVER (PARTITION BY {keys}) AS av FROM lens
), each AS (SELECT {keys}, {order}, l, n, CASE WHEN av = 0 THEN 1 ELSE av END AS av, t, unnest(terms) AS term FROM stats
), tf AS (SELECT *, len(list_filter(t, lambda w: w = term)) AS f FROM each
), df AS (SELECT *, count(*) FILTER (f > 0) OVER (PARTITION BY {keys}, term) AS d FROM tf
), bm25 AS (SELECT {keys}, {order}, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av))) AS s FROM df GROUP BY {keys}, {order}
), bm AS (SELECT {keys}, {order}, CASE WHEN len(terms) = 0 THEN 0 ELSE s + CASE WHEN {_phrase("t", "ph")} THEN 2 ELSE 0 END END AS lexical FROM stats LEFT JOIN bm25 USING ({keys}, {order}))"""


_FINAL = """final AS (
  SELECT r.* REPLACE (value + CASE WHEN mx > 0 THEN 0.04 * lexical / mx ELSE 0 END AS value)
  FROM {rows} r JOIN (SELECT *, greatest(0, max(lexical) OVER (PARTITION BY query_id, snapshot_id)) AS mx FROM bm) b USING (query_id, snapshot_id, ord, is_paragraph) WHERE tier < 4
), results AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY tier, value DESC, ord) AS INTEGER) AS rank FROM final)"""

_RESULTS = f"{_ADAPTIVE}, {_bm25('rows0', 'query', 'query_id, snapshot_id', 'ord, is_paragraph')}, {_FINAL.format(rows='rows0')}"
_QRESULTS = f"{_QUESTION}, {_bm25('rows1', 'query', 'query_id, snapshot_id', 'ord, is_paragraph')}, {_FINAL.format(rows='rows1')}"

_CAND = f"""asked AS (
  SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id
), cand AS (SELECT c.conv_id AS query_id, c.turn AS ord, c.text, a.query FROM conversations c JOIN asked a USING (conv_id)), {_bm25("cand", "query", "query_id", "ord")}"""

_LABELS = f"""{_COS}, lw AS (
  SELECT c.query_id // 100 AS query_id, c.query_id % 100 // 50 AS q_no, e.label, c.vec_id AS w_no, c.score FROM cosines c JOIN embeddings e USING (vec_id)
)"""

_IDS = "list_transform(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''), lambda w: length(w))"


def _cut(size: int, overlap: int) -> str:
    """Window numbers of n tokens."""
    return f"unnest(range(0, CAST(ceil(greatest(n - {size}, 0) / CAST({size - overlap} AS DOUBLE)) AS BIGINT) + 1))"


_PAIRS = """turns AS (
  SELECT a.conv_id, a.turn, length(a.text) AS q, length(b.text) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'
), parts AS (
  SELECT conv_id, turn, q, b, unnest(CASE WHEN q = 0 THEN [0] ELSE range(0, CAST(ceil(greatest(q - 187, 0) / 155.0) AS BIGINT) + 1) END) AS i FROM turns
), part AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE least(q - i * 155, 187) END AS ql FROM parts
), room AS (SELECT *, 256 - ql - 2 - 3 AS cap, least(64, 256 - ql - 2 - 3 - 1) AS ov FROM part
), win AS (
  SELECT conv_id, turn, ql, b, cap, ov, unnest(CASE WHEN b = 0 THEN [0] ELSE range(0, CAST(ceil(greatest(b - cap, 0) / CAST(cap - ov AS DOUBLE)) AS BIGINT) + 1) END) AS j FROM room
), pair AS (SELECT conv_id, turn, ql + 2 + 3 + CASE WHEN b = 0 THEN 0 ELSE least(b - j * (cap - ov), cap) END AS size FROM win)"""

_INPUT = "inputs AS (SELECT lang, source AS section, unnest(string_split(text, chr(10))) AS text FROM documents)"

_OLDNEW = f"""d2 AS (SELECT doc_id, CASE WHEN lang = 'en' AND n_chars % 2 = 0 THEN regexp_replace(text, 'the', 'teh', 'g') ELSE text END AS text FROM documents
), l1 AS (SELECT doc_id, unnest(l) AS body, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), l2 AS (SELECT doc_id, unnest(l) AS body, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d2)
), f1 AS (SELECT doc_id, line, unnest(s) AS text, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, line, {_sentences("body")} AS s FROM l1)
), f2 AS (SELECT doc_id, line, unnest(s) AS text, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, line, {_sentences("body")} AS s FROM l2)
), o1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS ord FROM f1
), o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS ord FROM f2
), diff AS (
  SELECT coalesce(o1.doc_id, o2.doc_id) AS snapshot_id, bool_and(o1.text IS NOT DISTINCT FROM o2.text AND o1.line IS NOT DISTINCT FROM o2.line) AS unchanged,
    count(*) FILTER (NOT (o1.text IS NOT DISTINCT FROM o2.text AND o1.line IS NOT DISTINCT FROM o2.line)) AS differing
  FROM o1 FULL JOIN o2 ON o1.doc_id = o2.doc_id AND o1.ord = o2.ord GROUP BY 1
)"""


def _bursts(where: str, gap: str) -> str:
    return f"""ordered AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events {where}
), marked AS (SELECT *, sum(CASE WHEN since IS NULL OR since > INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM ordered)"""


_RESCORED = f"""{_SCORED}, numbered AS (
  SELECT query_id, snapshot_id, passage_id, score, row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY score DESC, passage_id) AS rank FROM sc
), rescored AS (SELECT *, CASE WHEN rank % 9 = 5 THEN NULL ELSE round(12 * score - rank % 4, 4) END AS rerank_score FROM numbered WHERE rank <= 40)"""


def oracle_sql() -> dict[str, str]:
    return {
        "passages_sentences": f"WITH {_P} SELECT snapshot_id, '1:' || ord AS passage_id, ord, block_id, text, 'sentence' AS kind, role FROM p",
        "role_counts": f"WITH {_P} SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY role",
        "neighbor_text": f"WITH {_P} SELECT snapshot_id, ord, lag(text, 1, '') OVER w AS before, lead(text, 1, '') OVER w AS after FROM p WINDOW w AS (PARTITION BY snapshot_id, block_id ORDER BY pos)",
        "block_members": f"WITH {_P} SELECT snapshot_id, block_id, string_agg(text, ' ' ORDER BY ord) AS text, CAST(count(*) AS INTEGER) AS members, string_agg('1:' || ord, ' ' ORDER BY ord) AS ids FROM p GROUP BY snapshot_id, block_id",
        "snapshot_metrics": f"WITH {_P} SELECT snapshot_id, CAST(sum(n) AS BIGINT) AS passages, count(*) FILTER (n > 1) AS paragraphs, CAST(sum(n) AS BIGINT) AS sentences, CAST(0 AS BIGINT) AS headings FROM (SELECT snapshot_id, block_id, count(*) AS n FROM p GROUP BY ALL) GROUP BY snapshot_id",
        "collapsed_text": f"SELECT conv_id, turn, {_collapse('text')} AS text FROM conversations",
        "section_text": f"""WITH {_P}, h AS (SELECT *, CASE WHEN ord = 0 THEN 1 WHEN len(regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{N}}]*')) <= 3 THEN 2 END AS level FROM p)
            SELECT snapshot_id, ord, CASE WHEN level IS NULL THEN 'sentence' ELSE 'heading' END AS kind, text,
              CASE WHEN level IS NULL THEN coalesce(last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY snapshot_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS section FROM h""",
        "section_keys": """SELECT DISTINCT source AS section, lang AS text, '["' || source || '","' || lang || '"]' AS key FROM documents""",
        "page_subjects": f"WITH {_P} SELECT snapshot_id, arg_min(text, ord) AS subject FROM p WHERE pos = 0 AND role = 'body' GROUP BY snapshot_id",
        "coverage_notes": f"SELECT page_id AS snapshot_id, CASE WHEN contains(html, '</nav>') THEN '{C.COVERAGE_NOTE}' ELSE '' END AS coverage_note FROM pages",
        "preview": """SELECT doc_id, CASE WHEN s > 48 THEN '…' ELSE '' END || substr(text, greatest(0, s - 48) + 1, greatest(greatest(0, s - 48) + 240, e) - greatest(0, s - 48)) AS preview
            FROM (SELECT doc_id, text, CAST(least(doc_id % 200, length(text)) AS INTEGER) AS s, CAST(least(doc_id % 200 + 300, length(text)) AS INTEGER) AS e FROM documents)""",
        "highlight_ranges": f"""WITH {_P}, placed AS (SELECT snapshot_id, ord, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY snapshot_id, block_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p)
            SELECT snapshot_id, ord, CAST(s AS INTEGER) AS "start", CAST(s + n AS INTEGER) AS "end", true AS valid FROM placed""",
        "lexical_tokens": f"SELECT conv_id, turn, array_to_string({_lexical('text')}, ' ') AS tokens, CAST(len({_kept(_lexical('text'))}) AS INTEGER) AS kept FROM conversations",
        "stem_histogram": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words("text")}) AS word FROM documents) GROUP BY word)
            SELECT {_stem("word")} AS stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS forms FROM w GROUP BY 1""",
        "token_windows": f"""WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents), n AS (SELECT *, len(ids) AS n FROM t WHERE len(ids) > 0), w AS (SELECT doc_id, ids, n, {_cut(510, 32)} AS i FROM n)
            SELECT doc_id, CAST(i AS INTEGER) AS window_no, CAST(i * 478 AS INTEGER) AS "start", CAST(least(i * 478 + 510, n) AS INTEGER) AS "end", CAST(list_sum(list_slice(ids, i * 478 + 1, i * 478 + 510)) AS INTEGER) AS token_sum FROM w""",
        "embedding_inputs": f"""WITH t AS (SELECT conv_id, turn, {_IDS} AS ids FROM conversations), n AS (SELECT *, len(ids) AS n FROM t), w AS (SELECT conv_id, turn, ids, n, {_cut(508, 32)} AS i FROM n)
            SELECT conv_id, turn, CAST(i AS INTEGER) AS window_no, CAST(4 + least(n - i * 476, 508) AS INTEGER) AS length, CAST(218 + coalesce(list_sum(list_slice(ids, i * 476 + 1, i * 476 + 508)), 0) AS INTEGER) AS token_sum FROM w""",
        "pair_windows_count": f"WITH {_PAIRS} SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS pairs, CAST(max(size) AS INTEGER) AS longest, CAST(sum(size) AS INTEGER) AS tokens FROM pair GROUP BY conv_id, turn",
        "is_question": rf"SELECT conv_id, turn, regexp_matches(text, '(?i)^\s*(?:{'|'.join(C.QUESTION_WORDS)})\b') AS question FROM conversations",
        "standalone_numbers": r"""WITH r AS (SELECT event_id, 'how many ' || tenths AS query, CASE WHEN event_id % 3 = 0 THEN 'about ' || user_id ELSE tenths || ' - ' || user_id % 5 END AS text FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) // 10 || '.' || CAST(floor(value * 10) AS BIGINT) % 10 AS tenths FROM events)),
              n AS (SELECT *, regexp_extract_all(text, '[+-]?\p{N}+(?:[.,]\p{N}+)*') AS ns, regexp_extract_all(query, '[+-]?\p{N}+(?:[.,]\p{N}+)*') AS qn FROM r)
            SELECT event_id, text, len(ns) > 0 AND regexp_matches(text, '^[\p{N}\s.,+\-−–—()/:\[\]]+$') AND len(list_filter(ns, lambda x: NOT list_contains(qn, x))) > 0 AS excluded, array_to_string(ns, ' ') AS numbers FROM n""",
        "exact_phrase": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_words("text")}, ' ') || ' ' AS w FROM documents), b AS (SELECT item_id, {_words("text")} AS ph FROM benchmark)
            SELECT DISTINCT doc_id, item_id FROM d JOIN b ON len(ph) > 0 AND contains(w, ' ' || array_to_string(ph, ' ') || ' ')""",
        "bm25_scores": f"WITH {_CAND} SELECT query_id, ord, round(lexical, 6) AS lexical FROM bm",
        "bm25_topk": f"WITH {_CAND}, r AS (SELECT query_id, ord, round(lexical, 6) AS lexical, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, ord) AS INTEGER) AS rank FROM bm) SELECT * FROM r WHERE rank <= 3",
        "unit_vectors": f"WITH {_COS} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1], 6) AS first, CAST(len(e) AS INTEGER) AS dim FROM u",
        "cosine_scores": f"WITH {_COS} SELECT query_id, vec_id, score FROM cosines",
        "cosine_topk": f"WITH {_COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM cosines) SELECT * FROM r WHERE rank <= 40",
        "max_pool": f"WITH {_LABELS}, a AS (SELECT query_id, q_no, label, max(score) AS s FROM lw GROUP BY ALL) SELECT query_id, label, round(avg(s), 7) AS score FROM a GROUP BY ALL",
        "mean_pool": f"WITH {_LABELS}, a AS (SELECT query_id, q_no, label, avg(score) AS s FROM lw GROUP BY ALL) SELECT query_id, label, round(avg(s), 7) AS score FROM a GROUP BY ALL",
        "argmax_window": f"""WITH {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, q_no, w_no) AS k FROM lw) SELECT query_id, label, CAST(w_no AS INTEGER) AS "start", CAST(w_no + 1 AS INTEGER) AS "end" FROM r WHERE k = 1""",
        "relevance_flags": f"WITH {_SCORED} SELECT query_id, passage_id, round(100 * greatest(0, least(1, score)), 4) AS percent, 100 * greatest(0, least(1, score)) >= 30 AS relevant FROM sc",
        "evidence_ranking": f"WITH {_RANKED} SELECT query_id, snapshot_id, passage_id, round(ev, 6) AS evidence_score, round(sb, 6) AS section_boost, round(pb, 6) AS paragraph_boost, tier, round(value, 9) AS value, exact AS exact_match, reason, CAST(row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY tier, value DESC, ord) AS INTEGER) AS rank FROM ranked",
        "adaptive_paragraphs": f"WITH {_ADAPTIVE} SELECT query_id, snapshot_id, passage_id, is_paragraph, round(own, 6) AS score, round(ev, 6) AS evidence_score, tier, round(value, 9) AS value, focus_id FROM adaptive",
        "question_cutoff": f"WITH {_QUESTION} SELECT query_id, snapshot_id, passage_id, is_paragraph, round(qs, 9) AS question_score, round(value, 9) AS value FROM rows1",
        "hybrid_final": f"WITH {_RESULTS} SELECT query_id, snapshot_id, passage_id, is_paragraph, tier, round(value, 9) AS value, rank FROM results",
        "hybrid_question": f"WITH {_QRESULTS} SELECT query_id, snapshot_id, passage_id, is_paragraph, round(value, 9) AS value, rank FROM results",
        "result_positions": f"WITH {_RESULTS}, k AS (SELECT query_id, snapshot_id, rank, count(*) OVER (PARTITION BY query_id, snapshot_id) AS of FROM results) SELECT query_id, snapshot_id, rank, of, (rank - 2 + of) % of + 1 AS previous, rank % of + 1 AS next FROM k",
        "result_page": f"WITH {_COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM cosines) SELECT query_id, vec_id, rank FROM r WHERE rank > 40 AND rank <= 80",
        "rerank_filter": f"WITH {_RESCORED}, k AS (SELECT *, greatest(4, max(rerank_score) OVER (PARTITION BY query_id, snapshot_id) - 2) AS cutoff FROM rescored WHERE rerank_score IS NOT NULL) SELECT query_id, snapshot_id, passage_id, rerank_score FROM k WHERE rerank_score >= cutoff",
        "rerank_order": f"WITH {_RESCORED} SELECT query_id, snapshot_id, passage_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS rerank_rank FROM rescored WHERE rerank_score IS NOT NULL",
        "context_runs": f"""WITH {_RESULTS}, good AS (SELECT *, NOT heading AND tier < 4 AS ok, 100 * greatest(0, least(1, ev)) AS pct FROM ranked),
              anchors AS (SELECT g.query_id, g.snapshot_id, g.passage_id AS selected, g.ord AS anchor, g.grp AS agrp, greatest(30.0, g.pct - 10) AS least_pct FROM good g JOIN results r ON r.query_id = g.query_id AND r.passage_id = g.passage_id AND NOT r.is_paragraph WHERE g.ok),
              near AS (SELECT a.*, g.passage_id, g.ord, (g.heading OR g.grp <> a.agrp OR NOT g.ok OR g.pct < a.least_pct) AND g.ord <> a.anchor AS stop FROM anchors a JOIN good g USING (query_id, snapshot_id)),
              lim AS (SELECT *, coalesce(max(CASE WHEN stop AND ord < anchor THEN ord END) OVER w, -1) AS lo, coalesce(min(CASE WHEN stop AND ord > anchor THEN ord END) OVER w, 1 << 30) AS hi FROM near WINDOW w AS (PARTITION BY query_id, snapshot_id, selected))
            SELECT query_id, snapshot_id, selected, passage_id FROM lim WHERE ord > lo AND ord < hi AND ord <> anchor""",
        "dedup_inputs": f"WITH {_INPUT} SELECT DISTINCT section, text FROM inputs",
        "incremental_missing": f"WITH {_INPUT} SELECT DISTINCT section, text FROM inputs EXCEPT SELECT section, text FROM inputs WHERE lang <> 'en'",
        "cache_retain": f"WITH {_INPUT} SELECT section, text FROM inputs WHERE lang <> 'en' INTERSECT SELECT section, text FROM inputs WHERE lang <> 'fr'",
        "cache_refresh": f"""WITH {_INPUT}, c AS (SELECT DISTINCT section, text FROM inputs WHERE lang <> 'en'), i AS (SELECT DISTINCT section, text FROM inputs WHERE lang <> 'fr')
            SELECT section, text, CAST(length(text) + CASE WHEN c.section IS NULL THEN 0 ELSE 1000 END AS INTEGER) AS value FROM i LEFT JOIN c USING (section, text)""".replace("SELECT section, text, CAST", "SELECT i.section, i.text, CAST").replace("length(text)", "length(i.text)").replace("USING (section, text)", "ON i.section = c.section AND i.text = c.text"),
        "pair_cache": "WITH u AS (SELECT event_type, user_id, max(ts) AS last_used FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last_used DESC, user_id) AS n FROM u) SELECT event_type, user_id, last_used FROM r WHERE n <= 512",
        "ranking_cache": "WITH u AS (SELECT event_type, user_id, min(ts) AS first_used FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first_used DESC, user_id) AS n FROM u) SELECT event_type, user_id, first_used FROM r WHERE n <= 8",
        "snapshot_diff": f"WITH {_OLDNEW} SELECT snapshot_id, unchanged, differing FROM diff",
        "snapshot_versions": f"WITH {_OLDNEW} SELECT snapshot_id, CASE WHEN unchanged THEN 1 ELSE 2 END AS version FROM diff",
        "debounced_queries": f"""WITH {_bursts("", "'1 hour'")}, r AS (SELECT user_id, burst, arg_max(event_type, ts) AS query, max(ts) AS "at", count(*) AS keystrokes FROM marked GROUP BY ALL)
            SELECT user_id, query, "at", keystrokes FROM r WHERE trim(query) <> ''""",
        "mutation_batches": f"""WITH {_bursts("WHERE event_type <> 'view'", "'6 hours'")} SELECT user_id, min(ts) AS began, count(*) AS changes FROM marked GROUP BY user_id, burst""",
        "latest_generation": "WITH r AS (SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS query FROM events GROUP BY user_id) SELECT * FROM r WHERE query <> 'click'",
        "conflated_requests": "SELECT user_id, date_trunc('day', ts) AS slot, max(event_id) AS generation FROM events GROUP BY ALL",
        "session_routes": """WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS c, min(turn) FILTER (role = 'assistant') AS p FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, greatest(c, p) AS paired_at FROM f WHERE c IS NOT NULL AND p IS NOT NULL)
            SELECT conv_id AS session_id, paired_at, (SELECT max(turn) FROM conversations x WHERE x.conv_id = g.conv_id AND x.role = 'system' AND x.turn <= g.paired_at) AS focus FROM g""",
        "label_export": """SELECT d.doc_id, '{"query":"' || lang || '","effective_query":"' || source || '","passage":"' || sha256(text) || '","relevant":' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || ',"score":' || n_chars % 10 || ',"model":"none","preprocessing":"v1"}' AS line
            FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL""",
        "eval_mrr_recall": f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines WHERE query_id <> vec_id),
              m AS (SELECT q.vec_id AS query_id, min(r.rank) AS first FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id LEFT JOIN r ON r.query_id = q.vec_id AND r.vec_id = e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)
            SELECT count(*) AS queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3 FROM m""",
        "page_digests": "SELECT url AS path, sha256(html) AS sha256, true AS verified FROM pages",
        "synthetic_sentences": """SELECT i AS ord, CASE WHEN i = 230 THEN 'The hidden answer stands at the end of the page.' ELSE 'Note ' || i + 1 || ' describes ' || ['weather', 'harbours', 'gardens', 'railways', 'libraries'][i % 5 + 1] || ' and nothing else.' END AS text FROM range(231) t(i)""",
    }
