"""String expressions used by matching, snippets and keyphrases.

All functions build Catalyst expressions (no Python UDFs), so they stay inside
whole-stage codegen. Whitespace is the ASCII set of :data:`seekrank.config.WS`;
JavaScript would also treat NBSP and other Unicode blanks as whitespace, which
is a documented difference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekrank.config import WS

WS_RUN = WS + "+"
SEPARATORS = r"[-_./\\]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """Strip leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(c), rf"^{WS_RUN}|{WS_RUN}\z", "")


def collapse_ws(c) -> Column:
    """Each whitespace run becomes one space."""
    return F.regexp_replace(_c(c), WS_RUN, " ")


def norm(c) -> Column:
    """R1 match normaliser: lower, separators to space, one space per run, trimmed."""
    spaced = F.regexp_replace(F.lower(_c(c)), SEPARATORS, " ")
    # after the collapse only single spaces are left, so a space trim is enough
    return F.trim(collapse_ws(spaced))


def blank(c) -> Column:
    """null → ''."""
    return F.coalesce(_c(c), F.lit(""))


def strip_tags(c) -> Column:
    """Remove tags when the text looks like HTML, then collapse whitespace."""
    col = _c(c)
    stripped = F.trim(collapse_ws(F.regexp_replace(col, r"<[^>]*>", " ")))
    return F.when(col.contains("<") & col.contains(">"), stripped).otherwise(col)


def first_word(c) -> Column:
    """First word of an already normalised string ('' for '')."""
    return F.substring_index(_c(c), " ", 1)


def query_words(nq) -> Column:
    """Words of a normalised query longer than two characters (repeats kept)."""
    return F.filter(F.split(_c(nq), WS_RUN), lambda w: F.length(w) > 2)


def without_one_trailing_slash(c) -> Column:
    return F.regexp_replace(_c(c), r"/\z", "")


def url_key(url) -> Column:
    """R10 dedup key: lower-cased URL without one trailing slash."""
    return without_one_trailing_slash(F.lower(_c(url)))


def phrase_tokens(c) -> Column:
    """Keyphrase tokens: non [a-zA-Z0-9 whitespace] → space, lower, split, length > 2."""
    cleaned = F.lower(F.regexp_replace(_c(c), r"[^a-zA-Z0-9\t\n\x0B\f\r ]", " "))
    return F.filter(F.split(cleaned, WS_RUN), lambda t: F.length(t) > 2)
