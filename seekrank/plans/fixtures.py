"""Derived inputs for the operators, built by Spark from the given tables.

Each builder has a DuckDB twin in :mod:`seekrank.plans.oracle`; both must give
the same rows. Fixed clock: ``NOW`` (NTZ).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekrank.operators.embed import HashedBow
from seekrank.operators.ingest import basic_text, basic_title, shape_content
from seekrank.sources.tables import load

NOW = "2024-01-31 00:00:00"
DIM = 64

PARAGRAPH_QUERIES = ("the", "with that", "and the with")


def page_type(url) -> F.Column:
    return F.regexp_extract(url, r"/(de|en|es|fr)/[0-9]", 1)


def urls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry built from ``pages``: basic extraction, shaped content, fixed statuses and clock."""
    pages = load(spark, sf_dir, "pages")
    ext = pages.select(
        F.col("page_id").alias("id"), "url",
        page_type(F.col("url")).alias("type"),
        basic_title(F.col("html"), F.col("url")).alias("title"),
        basic_text(F.col("html")).alias("text"),
        F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1).alias("html"))
    shaped = shape_content(ext)
    status = (F.when(F.col("id") % 10 == 9, F.lit("pending"))
               .when(F.col("id") % 10 == 8, F.lit("failed")).otherwise(F.lit("completed")))
    return shaped.select(
        "id", "url", "type", "title",
        F.col("preview").alias("content_preview"),
        F.col("html").alias("extracted_content"),
        F.col("text").alias("full_text_content"),
        status.alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("created_at"),
        (F.lit(NOW).cast("timestamp_ntz")
         - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 20).cast("int"))).alias("updated_at"),
    )


def vectors_fx(urls: DataFrame, dim: int = DIM) -> DataFrame:
    """Hashed bag-of-words vector of ``title \\n full text`` per registry row."""
    text = F.concat(F.col("title"), F.lit("\n"), F.col("full_text_content"))
    return urls.select("id", HashedBow(dim).column(text).alias("vector"))


def corpus_fx(urls: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector records of completed rows: vector plus url/type/title/snippet/updated_at."""
    from seekrank.operators.ranking import doc_features
    from seekrank.operators.retrieval import with_norm
    done = urls.filter(F.col("status") == "completed").select(
        "id", "url", "type", "title", F.col("content_preview").alias("snippet"), "updated_at")
    # per-document match inputs are computed once here, at index time
    return doc_features(with_norm(vectors.join(done, "id", "inner")))


def queries_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per page: query text from the page's title or a few fixed forms, by page number.

    query_id, query, types, per_page, page, type_filter_text, like_id (the page
    whose vector is the query's, null for some).
    """
    p = load(spark, sf_dir, "pages").select("page_id", page_type(F.col("url")).alias("kind"),
                                            F.split(F.lower(basic_title(F.col("html"), F.col("url"))), " ").alias("w"))
    n = F.col("page_id")

    def pick(mod: int, default, **by):
        out = None
        for k, v in by.items():
            out = (F.when(n % mod == int(k[1:]), v) if out is None else out.when(n % mod == int(k[1:]), v))
        return out.otherwise(default)

    null, text = F.lit(None), F.lit
    return p.select(
        (n + 1).alias("query_id"),
        pick(8, null.cast("string"), _0=text("the"), _1=F.get("w", F.lit(0)), _2=F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))),
             _3=text("  zzzz "), _4=text(""), _5=text("---"), _6=text("with that")).alias("query"),
        pick(5, null.cast("array<string>"), _0=F.array(text("en"), text("fr")), _2=F.array().cast("array<string>"), _3=F.array("kind")).alias("types"),
        pick(6, null.cast("long"), _0=text(20), _1=text(10), _2=text(5), _4=text(0), _5=text(40)).cast("long").alias("per_page"),
        pick(7, text(1), _1=text(2), _2=null.cast("int"), _3=text(0), _6=text(3)).cast("long").alias("page"),
        pick(9, null.cast("string"), _0=text("EXAMPLE.NET"), _1=text("  "), _2=text("fr")).alias("type_filter_text"),
        F.when(n % 11 != 10, n).alias("like_id"))


def paragraphs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one query: a fixed phrase, or its own first two words."""
    n, words = F.col("doc_id") % 4, F.split(F.lower("text"), " ")
    query = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    for i, q in reversed(list(enumerate(PARAGRAPH_QUERIES))):
        query = F.when(n == i, F.lit(q)).otherwise(query)
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"), query.alias("query"))


def query_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """A query's vector is the vector of the page named by ``like_id``."""
    v = vectors.select(F.col("id").alias("like_id"), F.col("vector").alias("qvec"))
    return queries.join(v, "like_id", "left")


def matches_fx(top: DataFrame) -> DataFrame:
    """Scored matches for R2–R13: the top-k rows of V4, with upper-cased URL copies of a quarter of them.

    Copies are told apart by a suffix of the id, whatever the number of pages.
    """
    from seekrank.operators.ranking import URL_FEATURES, feature_columns
    copies = F.when(F.col("id") % 4 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    url, score, name, copied = F.col("url"), F.col("score"), F.col("id").cast("string"), F.col("_copy")
    both = top.withColumn("_copy", F.explode(copies)).withColumns({
        "url": F.when(~copied, url).when(url.endswith("/"), F.upper(url)).otherwise(F.concat(F.upper(url), F.lit("/"))),
        "score": F.when(~copied, score).otherwise(score + F.when(F.col("id") % 8 == 0, F.lit(-0.003)).otherwise(F.lit(0.003))),
        "id": F.when(copied, F.concat(name, F.lit("-copy"))).otherwise(name)})
    own = feature_columns()  # stored ones hold but for a copy's URL
    return both.withColumns({c: F.when(copied, own[c]).otherwise(F.col(c)) for c in URL_FEATURES if c in top.columns}).drop("_copy")


def upload_rows_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many uploads (a hundred pages each), some blank, padded or repeated later with another type."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    b = pages.select(
        "page_id", F.col("page_id").cast("string").alias("id"),
        F.concat(F.lit("upload-"), F.floor(F.col("page_id") / 100).cast("string"), F.lit(".csv")).alias("upload_id"),
        F.when(F.col("page_id") % 13 == 5, F.lit("")).otherwise(page_type(F.col("url"))).alias("type"),
        F.when(F.col("page_id") % 17 == 3, F.lit("")).otherwise(F.col("url")).alias("url"))
    pad = F.col("page_id") % 7 == 2
    first = b.select(
        "upload_id", (F.col("page_id") * 2).alias("row_no"), "id",
        F.when(pad, F.concat(F.lit("  "), F.col("type"), F.lit(" "))).otherwise(F.col("type")).alias("type"),
        F.when(pad, F.concat(F.lit(" "), F.col("url"), F.lit("  "))).otherwise(F.col("url")).alias("url"))
    again = b.filter(F.col("page_id") % 5 == 0).select(
        "upload_id", (F.col("page_id") * 2 + 1).alias("row_no"), "id", F.lit("Again").alias("type"), "url")
    return first.unionByName(again)


def report_rows_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload rows, uploads without a valid row, and uploads that could not be read (no ``row_no``)."""
    rows = upload_rows_fx(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    none = F.lit(None).cast("string")
    blank_ = pages.filter(F.col("page_id") % 50 == 9).select(
        F.concat(F.lit("blank-"), F.col("page_id").cast("string")).alias("upload_id"), (F.col("page_id") * 2).alias("row_no"),
        none.alias("id"), F.lit(" ").alias("type"), "url", none.alias("error"))
    bad = pages.filter(F.col("page_id") % 50 == 7).select(
        F.concat(F.lit("bad-"), F.col("page_id").cast("string")).alias("upload_id"), F.lit(None).cast("long").alias("row_no"),
        none.alias("id"), none.alias("type"), none.alias("url"), F.lit("csvContent is required").alias("error"))
    return rows.unionByName(blank_).unionByName(bad)


def line_urls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large URL list: one row per order line, with many repeats."""
    key = F.col("l_orderkey")
    return load(spark, sf_dir, "lineitem").select(
        (key * 8 + F.col("l_linenumber")).alias("row_no"), key.alias("order_key"),
        F.concat(F.lit("kind-"), (key % 3).cast("string")).alias("type"),
        F.concat_ws("/", F.lit("https://shop.example.com"), key.cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("url"))


def processed_fx(urls: DataFrame, vectors: DataFrame) -> DataFrame:
    """Worker output per URL: shaped content, vector (null for id % 11 = 6), error for id % 11 = 4; some URLs unregistered."""
    j = urls.join(vectors, "id", "left")
    rows = j.select(
        "id", "url", "type", "title", F.col("content_preview").alias("preview"),
        F.col("full_text_content").alias("text"), F.col("extracted_content").alias("html"),
        F.when(F.col("id") % 11 == 6, F.lit(None)).otherwise(F.col("vector")).alias("vector"),
        F.when(F.col("id") % 11 == 4, F.lit("boom")).alias("error"))
    gone = rows.filter(F.col("id") % 17 == 3).withColumn("url", F.concat("url", F.lit("#gone")))  # outside the registry
    return rows.unionByName(gone).drop("id")
