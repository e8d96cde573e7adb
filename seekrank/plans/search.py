"""R15 end-to-end search: from a batch of queries to one page each.

V1 → V2 → (V3 + V4) → R2…R8 → R9…R13 → T1, T3, T4, T5, and R14 for the meta.
Shuffles: the tiles of V4, the top-k exchange on ``query_id`` (after a partial
top-k per tile), and the joins of the winners' ids with their metadata and
texts. The scored candidates, at most the budget per query, feed both the pages
and the totals; they are written once with ``checkpoint()`` when the search is
built, so neither branch scores them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekrank.config import DEFAULT, SearchConfig
from seekrank.operators.ranking import (FEATURES, dedup_urls, filter_text, query_forms, rank_pipeline, rescore,
                                        search_status)
from seekrank.operators.retrieval import normalise_queries, vector_topk, with_metadata
from seekrank.operators.snippets import snippets_and_highlights
from seekrank.session import checkpoint_dir

RESULT_COLS = ["query_id", "rank", "id", "url", "type", "title", "score", "original_score",
               "recency_boost", "snippet", "highlights", "phrases"]


@dataclass
class SearchResult:
    results: DataFrame
    meta: DataFrame


def prepare_queries(queries: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    q = normalise_queries(queries, cfg)
    has_vec = F.col("qvec").isNotNull() & (F.coalesce(F.size("qvec"), F.lit(0)) > 0)
    return q.withColumn("has_vector", has_vec)


def winners(q: DataFrame, corpus: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """V3+V4: the best ids of every usable query, with the query's columns and forms; narrow rows, by query_id."""
    ok = q.filter(F.col("error").isNull() & F.col("has_vector"))
    top = vector_topk(corpus, ok.select("query_id", "qvec", "k", "types"), cfg, with_meta=False)
    return top.join(query_forms(ok.select("query_id", "query", "per_page", "page", "type_filter_text")), "query_id")


def candidates(q: DataFrame, corpus: DataFrame, now, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """V3+V4 then R2–R8: scored candidates of every usable query.

    Queries join the winners before the documents do, so that the documents'
    texts are exchanged once and are gone when the candidates are ranked.
    """
    scored = rescore(with_metadata(winners(q, corpus, cfg), corpus), now, cfg)
    return scored.drop(*FEATURES, "_nq", "_ql")


def search(queries: DataFrame, corpus: DataFrame, registry: DataFrame, now,
           cfg: SearchConfig = DEFAULT, snippets: bool = True) -> SearchResult:
    """``queries``: query_id, query, types, per_page, page, type_filter_text, qvec."""
    q = prepare_queries(queries, cfg)
    checkpoint_dir(queries.sparkSession)
    scored = candidates(q, corpus, now, cfg).checkpoint()
    page_rows = rank_pipeline(scored, cfg)
    totals = filter_text(dedup_urls(scored)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_available"))
    meta = search_status(q, totals)
    if snippets:
        res = snippets_and_highlights(page_rows, registry, cfg)
    else:
        res = (page_rows.withColumn("highlights", F.lit(None).cast("array<string>"))
                        .withColumn("phrases", F.lit(None).cast("array<string>")))
    return SearchResult(res.select(*RESULT_COLS), meta)
