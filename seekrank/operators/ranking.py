"""Text matching and hybrid re-ranking: R2–R14 and R16.

Input rows are candidates ``(query_id, id, score, url, type, title, snippet,
updated_at)`` with the query's own columns (``query``, ``per_page``, ``page``,
``type_filter_text``) attached. Every window here is partitioned by
``query_id`` (or a superset of it), so after the one exchange on ``query_id``
the ranking, dedup, re-ranking and paging run without another shuffle. Rows per
query are bounded by the candidate budget (≤ 1000).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.config import DEFAULT, GENERIC_MARKERS, SearchConfig
from seekrank.functions.text import blank, first_word, norm, url_key, without_one_trailing_slash, ws_trim
from seekrank.operators.ingest import ts_lit


def _has(text_norm: Column, text_lower: Column, nq: Column, ql: Column) -> Column:
    return text_norm.contains(nq) | text_lower.contains(ql)


# --------------------------------------------------------------------------- per-document features

FEATURES = ("f_nt", "f_nu", "f_ns", "f_np", "f_lt", "f_lu", "f_ls", "f_g0", "f_slen")
URL_FEATURES = ("f_nu", "f_np", "f_lu", "f_g0")  # those that depend on the URL


def doc_features(df: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """Query-independent match inputs of a document, computed once per document.

    Stored with the vector records at index time, these turn the per-(query,
    candidate) work of R2–R6 into plain ``contains`` checks: the regex
    normalisation never runs per pair.
    """
    return df if all(c in df.columns for c in FEATURES) else df.withColumns(feature_columns(cfg))


def feature_columns(cfg: SearchConfig = DEFAULT) -> dict[str, Column]:
    """The match inputs by name, from title, url and snippet."""
    t, u, s = blank("title"), blank("url"), blank("snippet")
    lt, lu, ls = F.lower(t), F.lower(u), F.lower(s)
    bare = without_one_trailing_slash(F.regexp_replace(lu, r"^https?://", ""))
    marker = None
    for m in GENERIC_MARKERS:
        c = ls.contains(m)
        marker = c if marker is None else (marker | c)
    g0 = marker | (F.length(ls) < cfg.generic_short) | (lt == lu) | (lt == bare)
    return {"f_nt": norm(t), "f_nu": norm(u), "f_ns": norm(s), "f_np": norm(F.substring_index(lu, "?", 1)),
            "f_lt": lt, "f_lu": lu, "f_ls": ls, "f_g0": g0, "f_slen": F.length(ls)}


# --------------------------------------------------------------------------- R2

def query_forms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """The forms in which a query is looked for, computed once per query where they are added before its rows are joined."""
    q = F.col(query_col)
    return queries.withColumns({"_nq": norm(q), "_ql": F.lower(q)})


def match_flags(df: DataFrame, query_col: str = "query") -> DataFrame:
    """R2: title/url/snippet matches by normalised or lower-case containment."""
    d = doc_features(df)
    if "_nq" not in df.columns:
        d = query_forms(d, query_col)
    nq, ql = F.col("_nq"), F.col("_ql")
    flags = d.withColumns({"title_m": F.col("f_nt").contains(nq) | F.col("f_lt").contains(ql),
                           "url_m": F.col("f_nu").contains(nq) | F.col("f_lu").contains(ql),
                           "snip_m": F.col("f_ns").contains(nq) | F.col("f_ls").contains(ql)})
    return flags.withColumn("text_m", F.col("title_m") | F.col("url_m") | F.col("snip_m"))


# --------------------------------------------------------------------------- R3

def semantic_gate(df: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """``meets`` = score over the (text-dependent) threshold; rows with neither go.

    The original's extra drop of empty pages under 0.6 and its ×0.8 penalty can
    only apply to rows without a text match below 0.65, which this gate has
    already removed, so they are not reachable and not built.
    """
    o = F.col("original_score")
    need = F.when(F.col("text_m"), F.lit(cfg.min_semantic)).otherwise(F.lit(cfg.min_semantic_no_text))
    return df.withColumn("meets", o >= need).filter(F.col("meets") | F.col("text_m"))


# --------------------------------------------------------------------------- R4

def generic_flag(df: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """Boilerplate snippet, very short snippet, or a title that is just the URL."""
    d = doc_features(df, cfg)
    generic = F.col("f_g0") | ((F.col("f_slen") < cfg.generic_short_no_text) & ~F.col("text_m"))
    return d.withColumn("generic", generic)


# --------------------------------------------------------------------------- R5–R8

def penalised(cfg: SearchConfig = DEFAULT) -> Column:
    """Score after the no-text-match penalty."""
    o = F.col("original_score")
    pen = (F.when(F.col("generic"), o * cfg.penalty_generic)
            .when(o >= cfg.high_semantic, o * cfg.penalty_high)
            .when(o >= cfg.min_semantic_no_text, o * cfg.penalty_mid)
            .otherwise(o * cfg.penalty_low))
    return F.when(F.col("text_m"), o).otherwise(pen)


def exact_flag() -> Column:
    nt = F.col("f_nt")
    nq = F.col("_nq")
    return (nt == nq) | nt.startswith(nq) | (first_word(nt) == first_word(nq))


def url_path_flag() -> Column:
    path = F.substring_index(F.col("f_lu"), "?", 1)
    ql = F.col("_ql")
    return F.col("f_np").contains(F.col("_nq")) | path.contains(F.concat(F.lit("/"), ql))


def recency_boost(now, cfg: SearchConfig = DEFAULT) -> Column:
    """0.2 under one hour (future included), linear to 0 at 24 h."""
    ua = F.col("updated_at")
    hours = F.timestamp_diff("MICROSECOND", ua, ts_lit(now)).cast("double") / F.lit(3.6e9)
    linear = F.greatest(F.lit(0.0), F.lit(cfg.recency_max) * (F.lit(1.0) - hours / F.lit(cfg.recency_window_h)))
    rb = (F.when(hours < cfg.recency_plateau_h, F.lit(cfg.recency_max))
           .when(hours < cfg.recency_window_h, linear).otherwise(F.lit(0.0)))
    on = F.col("meets") & F.col("text_m") & ua.isNotNull()
    return F.when(on, rb).otherwise(F.lit(0.0))


def _plus(flag: Column, amount: float) -> Column:
    return F.when(flag, F.lit(amount)).otherwise(F.lit(0.0))


def boost(df: DataFrame, now, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """Penalty, lexical boosts (in the original order), recency, cap at 1."""
    strong = F.col("meets") & F.col("text_m") & (F.col("original_score") > cfg.strong_semantic)
    out = df.withColumn("recency_boost", recency_boost(now, cfg))
    # left-to-right sum, like the sequence of += in the original
    score = (penalised(cfg) + _plus(F.col("title_m"), cfg.boost_title) + _plus(exact_flag(), cfg.boost_exact)
             + _plus(F.col("snip_m"), cfg.boost_snippet))
    score = F.when(F.col("url_m"), score + F.lit(cfg.boost_url) + _plus(url_path_flag(), cfg.boost_url_path)) \
        .otherwise(score)
    score = score + _plus(strong, cfg.boost_strong) + F.col("recency_boost")
    return out.withColumn("score", F.least(score, F.lit(1.0)))


def rescore(cands: DataFrame, now, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """R2–R8 on candidates whose ``score`` column is the semantic score."""
    raw = F.coalesce(F.col("score"), F.lit(0.0))
    df = cands.withColumn("original_score", F.when(F.isnan(raw), F.lit(0.0)).otherwise(raw))
    df = match_flags(doc_features(df, cfg))
    df = semantic_gate(df, cfg)
    df = generic_flag(df, cfg)
    return boost(df, now, cfg)


# --------------------------------------------------------------------------- R9–R13

def rank_order(cfg: SearchConfig = DEFAULT) -> list[Column]:
    """R9 total order: score to 3 decimals desc, original desc, score desc, id asc.

    The bin is ``floor(score·1000 + 0.5)``: one IEEE product and sum, so every
    engine computes the same bin.
    """
    scale = float(10 ** cfg.rank_decimals)
    binned = F.floor(F.col("score") * F.lit(scale) + F.lit(0.5))
    return [binned.desc(), F.col("original_score").desc(), F.col("score").desc(), F.col("id").asc()]


def rank_results(df: DataFrame, cfg: SearchConfig = DEFAULT, out: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*rank_order(cfg))
    return df.withColumn(out, F.row_number().over(w))


def dedup_urls(df: DataFrame) -> DataFrame:
    """One row per lower-cased URL (one trailing slash dropped); highest score wins."""
    w = Window.partitionBy("query_id", "url_key").orderBy(
        F.col("score").desc(), F.col("original_score").desc(), F.col("id").asc())
    return (df.withColumn("url_key", url_key("url"))
              .withColumn("_dn", F.row_number().over(w)).filter("_dn = 1").drop("_dn", "url_key"))


def facet_hit() -> Column:
    """R11 test: the trimmed, lower-cased facet text is blank or stands in type, url or title."""
    f = F.lower(ws_trim(F.coalesce(F.col("type_filter_text"), F.lit(""))))
    hit = (F.lower(blank("type")).contains(f) | F.lower(blank("url")).contains(f)
           | F.lower(blank("title")).contains(f))
    return (f == "") | hit


def filter_text(df: DataFrame) -> DataFrame:
    """Free-text facet over type, url and title (trimmed, lower-cased)."""
    return df.filter(facet_hit())


def paginate(df: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """Rank, total per query, and the rows of the requested page."""
    ranked = rank_results(df, cfg, "pos")
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    start = (F.col("page") - 1) * F.col("per_page")
    return (ranked.withColumn("total_available", total)
                  .filter((F.col("pos") > start) & (F.col("pos") <= start + F.col("per_page")))
                  .withColumn("rank", F.col("pos") - start).drop("pos"))


def dedup_result_ids(df: DataFrame) -> DataFrame:
    """First row per (query_id, id) by rank, then at most per_page rows."""
    w = Window.partitionBy("query_id", "id").orderBy("rank")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rank_pipeline(scored: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """R9→R10→R9→R11→R12→R13."""
    return dedup_result_ids(paginate(filter_text(dedup_urls(scored)), cfg))


# --------------------------------------------------------------------------- R14

def search_status(queries: DataFrame, totals: DataFrame) -> DataFrame:
    """R14 + meta: one row per query; a query without a usable vector is degraded.

    ``queries`` has ``query_id, page, per_page, error, has_vector``;
    ``totals`` has ``query_id, total_available``.
    """
    j = queries.select("query_id", "page", "per_page", "error", "has_vector").join(totals, "query_id", "left")
    degraded = F.col("error").isNotNull() | ~F.col("has_vector")
    reason = (F.when(F.col("error").isNotNull(), F.col("error"))
               .when(~F.col("has_vector"), F.lit("Embedding generation failed: no query vector")))
    return j.select(
        "query_id", "page", "per_page",
        F.when(degraded, F.lit(0)).otherwise(F.coalesce(F.col("total_available"), F.lit(0))).cast("long")
         .alias("total_available"),
        degraded.alias("degraded"), reason.alias("reason"))


# --------------------------------------------------------------------------- R16

def _pct(c: Column) -> Column:
    return F.round(c * F.lit(100.0), 1)


def present(results: DataFrame, meta: DataFrame) -> DataFrame:
    """Display columns, percent scores and paging flags per query."""
    shown = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    m = meta.select("query_id", F.col("page").alias("_page"), F.col("per_page").alias("_pp"),
                    F.col("total_available").alias("_total"))
    df = results.join(m, "query_id").withColumn("_shown", shown)
    first = F.when(F.col("_shown") == 0, F.lit(0)).otherwise((F.col("_page") - 1) * F.col("_pp") + 1)
    title_shown = F.when(blank("title") == "", F.col("url")).otherwise(F.col("title"))
    return df.select(
        "query_id", "rank", "id", "url", "type",
        title_shown.alias("title_shown"),
        _pct(F.col("score")).alias("relevance_pct"),
        _pct(F.col("original_score")).alias("semantic_pct"),
        F.when(F.col("recency_boost") > 0, _pct(F.col("recency_boost"))).alias("recency_pct"),
        first.cast("long").alias("first_shown"),
        (first + F.col("_shown") - 1).cast("long").alias("last_shown"),
        (F.col("_page") > 1).alias("has_previous"),
        ((F.col("_shown") < F.col("_pp")) & (F.col("_total") > F.col("_shown"))).alias("has_next"),
    )
