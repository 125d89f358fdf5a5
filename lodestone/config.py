"""Fixed values of the ranking rules, in one place, and the settings of a search."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds, weights and sizes that results depend on.
MIN_MATCH_PERCENT = 30
STRONG_SECTION = 0.5
MINIMUM_SECTION_EVIDENCE = 0.2
MAXIMUM_SECTION_BOOST = 0.12
SENTENCE_FOCUS_MARGIN = 0.1
MAXIMUM_PARAGRAPH_BOOST = 0.1
EXACT_MATCH_BONUS = 0.08
MAXIMUM_LEXICAL_BOOST = 0.04
MINIMUM_QUESTION_SCORE = 0.25
MAXIMUM_QUESTION_DROP = 0.15
QUESTION_WEIGHT = 0.75
BM25_K1 = 1.2
BM25_B = 0.75
PHRASE_BONUS = 2.0
RERANK_CANDIDATES = 40
RERANK_MIN_SCORE = 4.0
RERANK_MAX_DROP = 2.0
PAIR_TOKENS = 1024
PAIR_TOKENS_NATIVE = 7999
PAIR_TOKENS_LEAST = 256
CONTEXT_MAX_PERCENT_DROP = 10
EMBEDDING_TOKENS = 510
EMBEDDING_OVERLAP = 32
SECTION_PREFIX_TOKENS = 64
EMBED_CLS, EMBED_SEP = 101, 102
PAIR_CLS, PAIR_SEP, PAIR_PAD = 50281, 50282, 50283
QUERY_QUIET_MS = 400
MUTATION_QUIET_MS = 250
RANKING_CACHE = 8
PAIR_CACHE = 512
PAGE_ROWS = 40
EXCLUDED_NUMBER = "standalone number absent from query"
COVERAGE_NOTE = "Some embedded content cannot be searched on this page."

# Word lists and patterns.
INVARIANT_WORDS = ("news", "series", "species")
STOP_WORDS = tuple("a an the and or of in on at to for from by with is are was were be been it its this that these those i you we they can could do does did how what which who where when why many much".split())
QUESTION_WORDS = tuple("which what where when who why how is are was were does do did can could will would should".split())
EXCLUDED_TAGS = frozenset("script style noscript template textarea input select option svg canvas".split())
BLOCK_TAGS = frozenset("p div section article main aside header footer nav li ul ol dt dd blockquote pre td th tr table figcaption h1 h2 h3 h4 h5 h6".split())
CONTEXT_TAGS = frozenset("section article main aside nav header footer tr blockquote pre".split())
SCOPE_TAGS = frozenset("section article main aside nav header footer".split())


@dataclass(frozen=True)
class SearchConfig:
    """Settings of one search; values out of range are errors."""

    reranker: bool = True
    pair_tokens: int = PAIR_TOKENS
    batch_rows: int = 8
    backend: str = "auto"

    def __post_init__(self) -> None:
        if not isinstance(self.pair_tokens, int) or not PAIR_TOKENS_LEAST <= self.pair_tokens <= PAIR_TOKENS_NATIVE:
            raise ValueError(f"pair_tokens must be a whole number from {PAIR_TOKENS_LEAST} to {PAIR_TOKENS_NATIVE}")
        if self.backend not in ("auto", "wasm", "webgpu") or self.batch_rows not in (4, 8, 16):
            raise ValueError("backend must be auto, wasm or webgpu, and batch_rows 4, 8 or 16")
