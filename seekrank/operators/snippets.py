"""Content hydration, best paragraph and keyphrases: T1–T5.

* T3 runs in-row with higher-order functions (split → score → first maximum);
  no shuffle.
* T4/T5 count phrases in one pass over a row's tokens, in Arrow batches.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.config import DEFAULT, STATUS_COMPLETED, STOPWORDS, WS, SearchConfig
from seekrank.functions.text import (blank, norm, phrase_tokens, query_words, strip_tags, ws_trim)

PARA_SPLIT = r"\n" + WS + r"*\n"
_STOP = frozenset(STOPWORDS)
#: Words of a phrase -> weight without and with a query word in it.
_WEIGHTS = {1: (1, 3), 2: (2, 8)}
SENTENCE_SPLIT = r"[.!?]" + WS + "+"


# --------------------------------------------------------------------------- T1

def _content(registry: DataFrame) -> DataFrame:
    return (registry.filter(F.col("status") == STATUS_COMPLETED)
                    .select("id", F.coalesce(F.nullif(F.col("full_text_content"), F.lit("")),
                                             F.nullif(F.col("extracted_content"), F.lit("")),
                                             F.lit("")).alias("content")))


def hydrate(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Full text (else extracted html, else '') of completed rows, joined by id; null for the others."""
    return results.join(_content(registry), "id", "left")


def hydrate_docs(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """T1 per distinct document: ``(id, content)`` of completed rows among ``ids``.

    Each document is fetched once however many queries show it; whether the ids
    are broadcast is left to Spark, which knows their size.
    """
    return _content(registry).join(ids.select("id").distinct(), "id", "left_semi")


# --------------------------------------------------------------------------- T3
#
# The steps below add their intermediate arrays as columns (one projection
# each) instead of nesting them: an expression referenced twice inside a
# lambda would otherwise be inlined and evaluated again per element.

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_paragraph_parts(df: DataFrame, content, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """Query-independent part of T3: text, paragraphs and their normalised forms.

    Adding these before a documents × queries join does the regex work once
    per document instead of once per (document, query).
    """
    raw = blank(_c(content))
    s1 = df.withColumn("_bp_raw", raw).withColumn("_bp_txt", strip_tags(F.col("_bp_raw")))
    s2 = s1.withColumn("_bp_paras", F.filter(F.transform(F.split("_bp_txt", PARA_SPLIT), lambda p: ws_trim(p)),
                                             lambda p: F.length(p) > cfg.min_paragraph))
    # normalise each paragraph once; the scoring lambda then only reads it
    return s2.withColumn("_bp_np", F.transform("_bp_paras", lambda p: norm(p)))


def add_best_paragraph(df: DataFrame, content, query, out: str = "paragraph",
                       cfg: SearchConfig = DEFAULT) -> DataFrame:
    """The paragraph that best matches the query (≤ 500 chars, trimmed)."""
    s2 = df if "_bp_paras" in df.columns else with_paragraph_parts(df, content, cfg)
    s2 = (s2.withColumn("_bp_nq", norm(_c(query)))
            .withColumn("_bp_ql", F.lower(_c(query))))
    s2 = s2.withColumn("_bp_words", query_words(F.col("_bp_nq")))
    nq, ql, words = F.col("_bp_nq"), F.col("_bp_ql"), F.col("_bp_words")

    def score(p, i):
        np_ = F.element_at(F.col("_bp_np"), i + 1)
        per_word = F.aggregate(words, F.lit(0), lambda acc, w: acc
                               + F.when(np_.contains(w), F.lit(10)).otherwise(F.lit(0))
                               + F.when(np_.startswith(w), F.lit(5)).otherwise(F.lit(0)))
        n = F.length(p)
        return (F.when(np_.contains(nq), F.lit(100)).otherwise(F.lit(0))
                + F.when(F.lower(p).contains(ql), F.lit(50)).otherwise(F.lit(0))
                + per_word
                + F.when((n >= 100) & (n <= 500), F.lit(5)).when(n > 500, F.lit(2)).otherwise(F.lit(0)))

    s3 = s2.withColumn("_bp_scores", F.transform("_bp_paras", score))
    best = F.try_element_at("_bp_paras", F.array_position("_bp_scores", F.array_max("_bp_scores")).cast("int"))
    # sentences are only needed (and only split) when there is no paragraph
    sentences = F.when(F.size("_bp_paras") == 0, F.filter(
        F.split("_bp_txt", SENTENCE_SPLIT), lambda s: F.length(ws_trim(s)) > cfg.min_paragraph))
    s4 = s3.withColumn("_bp_best", best).withColumn("_bp_sents", sentences)
    no_para = F.when(F.size("_bp_sents") > 0, F.substring(F.try_element_at("_bp_sents", F.lit(1)), 1, cfg.snippet_chars)) \
        .otherwise(F.substring("_bp_txt", 1, cfg.snippet_chars))
    picked = F.when(F.size("_bp_paras") > 0, ws_trim(F.substring("_bp_best", 1, cfg.snippet_chars))).otherwise(no_para)
    res = F.when(F.length(ws_trim(F.col("_bp_raw"))) == 0, F.lit("")).otherwise(picked)
    return s4.withColumn(out, res).drop(*[c for c in s4.columns if c.startswith("_bp_")])


# --------------------------------------------------------------------------- T4, T5

def add_phrases(df: DataFrame, text, query=None, out: str = "phrases", cfg: SearchConfig = DEFAULT) -> DataFrame:
    """T4 (with ``query``) / T5 (without): up to ``n`` title-cased 1–2 word phrases.

    Unigram weight 1 (3 with a query word), bigram 2 (8 with a query word);
    order score desc, then first occurrence; with a query only phrases holding
    a query word are kept. Tokens and query words are split in the JVM; the
    counting is one pass over the tokens per row, in Arrow batches, so a long
    text costs its length.
    """
    qw = query_words(norm(_c(query))) if query is not None else F.array().cast("array<string>")
    counted = _count_phrases(cfg.max_phrases, query is not None)
    return df.withColumn(out, counted(phrase_tokens(blank(_c(text))), qw))


def _count_phrases(limit: int, with_query: bool):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def count(tokens: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([_top_phrases(t, w, limit, with_query) for t, w in zip(tokens, words)])
    return count


def _occurrences(tokens):
    """Every phrase of the text, as a tuple of one or two words, in the order in which they begin."""
    for here, after in zip_longest(tokens, tokens[1:]):
        if here not in _STOP:
            yield (here,)
            if after is not None and after not in _STOP:
                yield (here, after)


def _top_phrases(tokens, words, limit: int, with_query: bool) -> list[str]:
    if tokens is None:
        return []
    asked, counts = set(words), Counter(_occurrences(list(tokens)))

    def score(phrase: tuple[str, ...]) -> int:
        plain, by_query = _WEIGHTS[len(phrase)]
        return counts[phrase] * (plain if asked.isdisjoint(phrase) else by_query)
    kept = (p for p in counts if not (with_query and asked.isdisjoint(p)))
    best = heapq.nsmallest(limit, kept, key=lambda p: -score(p))  # equal scores stay in order of occurrence
    return [" ".join(w[:1].upper() + w[1:] for w in p) for p in best]


def snippets_and_highlights(page_rows: DataFrame, registry: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """T1 + T3 + T4 for one page of results, then T5 on the snippet where no highlights.

    Output adds ``snippet`` (replaced by the paragraph when there is one),
    ``highlights`` (null when the row had no content) and ``phrases``
    (highlights, else phrases of the snippet). The query-independent paragraph
    work runs once per distinct document; the scoring and phrases per row.
    """
    docs = with_paragraph_parts(hydrate_docs(page_rows.select("id"), registry), "content", cfg)
    h = page_rows.join(docs, "id", "left")
    h = h.withColumn("_has", F.coalesce(F.col("content"), F.lit("")) != "")
    h = add_best_paragraph(h, "content", "query", "_para", cfg)
    h = h.withColumn("_para", F.when(F.col("_has"), F.col("_para")))
    h = add_phrases(h, "_para", "query", "_hl", cfg)
    use = F.col("_has") & ((F.col("_para") != "") | (F.size("_hl") > 0))
    h = (h.withColumn("snippet", F.when(use & (F.col("_para") != ""), F.col("_para")).otherwise(F.col("snippet")))
          .withColumn("highlights", F.when(use, F.col("_hl")))
          .drop("_para", "_hl", "content", "_has"))
    h = add_phrases(h, "snippet", None, "_tp", cfg)
    return h.withColumn("phrases", F.when(F.size(F.coalesce("highlights", F.array())) > 0, F.col("highlights"))
                                    .otherwise(F.col("_tp"))).drop("_tp")
