"""Constants of the search, ingest and snippet rules.

Every operator reads its thresholds from a :class:`SearchConfig` so a caller
can tune them per job; the defaults are the values the behaviour is defined by.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced).
# ---------------------------------------------------------------------------

# Stopwords for keyphrases, in their original order.
STOPWORDS = (
    "the", "and", "for", "you", "are", "with", "that", "from", "this", "your",
    "have", "will", "not", "but", "was", "were", "can", "our", "about", "into",
    "then", "than", "them", "they", "there", "what", "when", "where", "which",
    "while", "also", "just", "like",
)

# Snippet substrings that mark boilerplate content.
GENERIC_MARKERS = (
    "wordpress",
    "wp-blog-header",
    "content temporarily unavailable",
    "<?php",
)

# Placeholder written for a page whose fetch failed; the prefix is followed by the URL.
PLACEHOLDER_PREFIX = "Content temporarily unavailable for "

# Documented limits of single operators, off unless passed: text cut of I9, rows of L2.
TEXT_CUT = 10000
TEXT_SEARCH_ROWS = 10000

STATUS_PENDING = "pending"
STATUS_COMPLETED = "completed"
STATUS_FAILED = "failed"
STATUSES = (STATUS_PENDING, STATUS_COMPLETED, STATUS_FAILED)

DEFAULT_FILE_NAME = "upload.csv"

# ASCII whitespace as JavaScript's ``\s`` sees it among the ASCII range.
# Written out so Java regex and RE2 (DuckDB) agree (RE2's ``\s`` lacks \x0B).
WS = r"[\t\n\x0B\f\r ]"


# ---------------------------------------------------------------------------
# Fixed values as well: budgets, thresholds, boosts and penalties of the rules.
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class SearchConfig:
    max_top_k: int = 1000
    min_semantic: float = 0.55
    min_semantic_no_text: float = 0.65
    default_per_page: int = 20
    max_per_page: int = 500
    first_page_multiplier: int = 5
    later_page_multiplier: int = 3
    # boosts, added in this order
    boost_title: float = 0.25
    boost_exact: float = 0.35
    boost_snippet: float = 0.20
    boost_url: float = 0.15
    boost_url_path: float = 0.20
    boost_strong: float = 0.15
    strong_semantic: float = 0.7
    # penalties for rows without a text match
    penalty_generic: float = 0.5
    penalty_high: float = 0.98
    penalty_mid: float = 0.88
    penalty_low: float = 0.8
    high_semantic: float = 0.75
    # recency
    recency_max: float = 0.2
    recency_window_h: float = 24.0
    recency_plateau_h: float = 1.0
    text_recency_window_h: float = 72.0
    # ranking tolerance (scores rounded to this many decimals compare equal)
    rank_decimals: int = 3
    # generic content
    generic_short: int = 30
    generic_short_no_text: int = 100
    # snippets
    snippet_chars: int = 500
    min_paragraph: int = 20
    max_phrases: int = 5
    # lexical search
    text_base: float = 0.35
    text_title: float = 0.35
    text_url: float = 0.20
    text_snippet: float = 0.15
    # content shaping
    max_title: int = 500
    max_preview: int = 500
    # bytes of one tile of queries or of vectors in the top-k product
    tile_bytes: int = 4 << 20


DEFAULT = SearchConfig()
