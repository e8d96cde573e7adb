"""Ingest operators I3–I9, I11, I12: validation, registry upserts, page extraction.

Registry (``urls``) and vector snapshots are plain DataFrames; an upsert is a
pure function returning the next snapshot, written by the caller to a new
versioned folder (never over the folder being read).

Joins against the registry stream the registry and put the upload side on the
build side: uploads are small next to the registry, and AQE turns the join into
a broadcast when the measured size allows it, without a hint.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.config import (DEFAULT, DEFAULT_FILE_NAME, PLACEHOLDER_PREFIX, STATUS_COMPLETED,
                             STATUS_FAILED, STATUS_PENDING, SearchConfig)
from seekrank.functions.text import blank, collapse_ws, ws_trim
from seekrank.operators.numbering import dense_ids
from seekrank.session import staged

REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content_preview", T.StringType()),
    T.StructField("extracted_content", T.StringType()),
    T.StructField("full_text_content", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    # written at index time, so that no search computes them again (see ranking.doc_features)
    T.StructField("norm", T.DoubleType()),
    *(T.StructField(f, T.StringType()) for f in ("f_nt", "f_nu", "f_ns", "f_np", "f_lt", "f_lu", "f_ls")),
    T.StructField("f_g0", T.BooleanType()),
    T.StructField("f_slen", T.IntegerType()),
])

BOOKKEEPING = ("upload_id", "row_no", "file_name", "columns_found", "error")


def ts_lit(now) -> Column:
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    if isinstance(now, _dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(now)).cast("timestamp_ntz")


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def empty_vectors(spark) -> DataFrame:
    return spark.createDataFrame([], VECTOR_SCHEMA)


# --------------------------------------------------------------------------- I3

def _with_upload_id(df: DataFrame) -> DataFrame:
    if "upload_id" in df.columns:
        return df
    return df.withColumn("upload_id", F.lit(DEFAULT_FILE_NAME))


def clean_url_rows(rows: DataFrame) -> DataFrame:
    """null → '' and trim type, url and id (the id is a pass-through only)."""
    out = _with_upload_id(rows)
    for c in ("type", "url", "id"):
        out = out.withColumn(c, ws_trim(blank(F.col(c))) if c in rows.columns else F.lit(""))
    return out


def validate_url_rows(rows: DataFrame) -> DataFrame:
    """I3 valid rows: non-empty type and url after trimming."""
    clean = clean_url_rows(rows)
    return clean.filter((F.length("type") > 0) & (F.length("url") > 0))


def upload_report(rows: DataFrame) -> DataFrame:
    """I3 report per upload: columns found, data rows, valid rows and an error text.

    A row without ``row_no`` stands for an upload that could not be read (I2):
    it is no data row, and its own error is the report's.
    """
    clean = clean_url_rows(rows)
    read = F.col("row_no").isNotNull() if "row_no" in rows.columns else F.lit(True)
    failed = F.max(F.when(~read, F.col("error"))) if "error" in rows.columns else F.lit(None).cast("string")
    if "columns_found" in clean.columns:
        cols = F.first("columns_found", ignorenulls=True)
    else:
        found = [c for c in rows.columns if c not in BOOKKEEPING]
        cols = F.lit(", ".join(found))
    valid = (F.length("type") > 0) & (F.length("url") > 0)
    rep = clean.groupBy("upload_id").agg(
        cols.alias("columns_found"),
        F.count_if(read).alias("row_count"),
        F.count_if(read & valid).alias("url_count"),
        failed.alias("_failed"),
    )
    err = (F.when(F.col("_failed").isNotNull(), F.col("_failed"))
            .when(F.col("row_count") == 0, F.lit("CSV file is empty or contains no data rows"))
            .when(F.col("url_count") == 0,
                  F.concat(F.lit("No valid rows found in CSV. Found columns: "), F.col("columns_found"),
                           F.lit(". Required: type, url (case-insensitive). Optional: id"))))
    return rep.withColumn("error", err).drop("_failed")


# --------------------------------------------------------------------------- I4

def incoming_urls(rows: DataFrame) -> DataFrame:
    """The distinct URLs of the valid rows with type and first ``row_no``, written once."""
    return staged(validate_url_rows(rows).groupBy("url").agg(
        F.min_by("type", F.struct("row_no", "type")).alias("type"), F.min("row_no").alias("first_row_no")), "incoming")


def upsert_urls_changes(registry: DataFrame, rows: DataFrame, now, largest: int | None = None) -> DataFrame:
    """I4, the registry rows that change: known URLs back to pending, new ones pending.

    Existing rows keep type, title and content (only status/updated_at change).
    Duplicate URLs in ``rows`` collapse; the lowest ``row_no`` gives the type.
    New ids go on from the largest one (``largest``, where the table keeps it;
    from 1 in an empty registry) in the order of first ``row_no``, then URL.

    The registry is read once: the known rows, at most as many as the upload
    has, are written, and the new URLs are those that aren't among them.
    """
    return _changes(registry, incoming_urls(rows), now, largest)


def _changes(registry: DataFrame, incoming: DataFrame, now, largest: int | None = None) -> DataFrame:
    ts = ts_lit(now)
    met = staged(registry.join(incoming.select("url"), "url", "left_semi").select(*registry.columns), "known")
    known = met.withColumns({"status": F.lit(STATUS_PENDING), "updated_at": ts})
    new = dense_ids(incoming.join(met.select("url"), "url", "left_anti"), ["first_row_no", "url"], F.lit(0))
    if largest is None:
        base = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))  # one row
        new = new.crossJoin(F.broadcast(base)).withColumn("id", F.col("_base") + F.col("id"))
    else:
        new = new.withColumn("id", F.lit(largest).cast("long") + F.col("id"))
    null = F.lit(None).cast("string")
    new_rows = new.select(
        "id", "url", "type", null.alias("title"), null.alias("content_preview"),
        null.alias("extracted_content"), null.alias("full_text_content"),
        F.lit(STATUS_PENDING).alias("status"), ts.alias("created_at"), ts.alias("updated_at"))
    return known.unionByName(new_rows)


def upsert_urls(registry: DataFrame, rows: DataFrame, now) -> DataFrame:
    """I4: the next registry, the unchanged rows and those of :func:`upsert_urls_changes`; the upload is read once."""
    incoming = incoming_urls(rows)
    same = registry.join(incoming.select("url"), "url", "left_anti").select(*registry.columns)
    return same.unionByName(_changes(registry, incoming, now))


# --------------------------------------------------------------------------- I5

def pending_work(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """One work item per URL with the type (and csv id) of its last valid row."""
    valid = validate_url_rows(rows)
    last = valid.groupBy("url").agg(
        F.max_by("type", "row_no").alias("type"),
        F.max_by("id", "row_no").alias("csv_id"),
        F.count(F.lit(1)).alias("queued"),
    )
    pend = registry.filter(F.col("status") == STATUS_PENDING).select("url", F.col("id").alias("registry_id"))
    return last.join(pend, "url", "inner")


# --------------------------------------------------------------------------- I6, I7

def fetch_pages(work: DataFrame, pages: DataFrame) -> DataFrame:
    """Look each URL up in the crawled ``pages(url, html)`` table; no page = failed fetch.

    A URL crawled more than once gives its last page: largest ``page_id`` where
    there is one, then largest html. The crawl is reduced to the URLs of the
    work first, so only their pages are exchanged; where the work is small
    enough to be sent to all tasks, the crawl itself is not exchanged at all.
    """
    order = F.struct(*([F.col("page_id")] if "page_id" in pages.columns else []), F.col("html"))
    wanted = pages.filter(F.col("html").isNotNull()).join(work.select("url").distinct(), "url", "left_semi")
    one = wanted.groupBy("url").agg(F.max(order).alias("_p")).select("url", F.col("_p.html").alias("html"))
    return work.join(one, "url", "left")


def with_placeholder(df: DataFrame) -> DataFrame:
    """A failed fetch becomes placeholder content and still proceeds."""
    failed = F.col("html").isNull()
    return (df.withColumn("fetch_failed", failed)
              .withColumn("title", F.when(failed, F.col("url")).otherwise(F.col("title")))
              .withColumn("text", F.when(failed, F.concat(F.lit(PLACEHOLDER_PREFIX), F.col("url")))
                                   .otherwise(F.col("text")))
              .withColumn("html", F.when(failed, F.lit("")).otherwise(F.col("html"))))


# --------------------------------------------------------------------------- I8

#: Character references decoded in page text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
_COMMENT = r"(?s)<!--.*?-->"
_SCRIPT_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>"


def decode_entities(c: Column) -> Column:
    for ref, char in ENTITIES:
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def basic_title(html, url) -> Column:
    """Text of the first title element (decoded, blanks collapsed), else the URL."""
    t = F.trim(collapse_ws(decode_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))))
    return F.coalesce(F.nullif(t, F.lit("")), url)


def html_body(html) -> Column:
    """Inside of the body element (to the end where it isn't closed); without one, what follows the head."""
    inside = F.regexp_replace(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1), r"(?is)</body\s*>.*", "")
    return F.when(html.rlike(r"(?i)<body\b[^>]*>"), inside).otherwise(F.regexp_replace(html, r"(?is)^.*</head\s*>", ""))


def basic_text(html) -> Column:
    """Text of the body: no comments, scripts or styles, tags to blanks, decoded, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html_body(html), _COMMENT, " "), _SCRIPT_STYLE, " ")
    return F.trim(collapse_ws(decode_entities(F.regexp_replace(bare, r"<[^>]*>", " "))))


def extract_pages(df: DataFrame, mode: str = "basic") -> DataFrame:
    """I8: page title, text and html from raw HTML (rows with html set).

    ``basic`` is built-in expressions only; ``article`` picks the main block
    with :mod:`seekrank.operators.article` per Arrow batch.
    """
    if mode == "article":
        from seekrank.operators.article import extract_articles
        return extract_articles(df)
    if mode != "basic":
        raise ValueError(f"unknown extraction mode: {mode}")
    html, url = F.col("html"), F.col("url")
    return (df.withColumn("title", basic_title(html, url))
              .withColumn("text", basic_text(html))
              .withColumn("html", html_body(html)))


def extract_fetched(fetched: DataFrame, mode: str = "basic") -> DataFrame:
    """I8 for the pages that were fetched, I7 for the others: ``fetched`` plus fetch_failed, title, text, html."""
    html = F.col("html")
    none = F.lit(None).cast("string")
    got = extract_pages(fetched.filter(html.isNotNull()), mode)
    missed = fetched.filter(html.isNull()).withColumns({"title": none, "text": none})
    return with_placeholder(got.select(*missed.columns).unionByName(missed))


# --------------------------------------------------------------------------- I9

def shape_content(df: DataFrame, cfg: SearchConfig = DEFAULT, max_text: int | None = None) -> DataFrame:
    """Cut the title, derive preview and the text to embed.

    ``max_text`` cuts the text as well; without it the whole text is stored,
    embedded and searched.
    """
    title = F.substring("title", 1, cfg.max_title)
    text = F.substring("text", 1, max_text) if max_text else F.col("text")
    cut = df.withColumns({"title": title, "text": text, "html": blank("html")})
    return cut.withColumns({"preview": F.substring("text", 1, cfg.max_preview),
                            "embed_text": F.concat(F.col("title"), F.lit("\n"), F.col("text"))})


# --------------------------------------------------------------------------- I11

def apply_results(registry: DataFrame, results: DataFrame, now) -> DataFrame:
    """Completed rows get content; rows with an error become failed, content kept.

    Several results for one URL count as one: the largest ``seq`` where there is
    one; then a result without error, and the largest title, text and html.
    """
    ts = ts_lit(now)
    rank = F.struct(*([F.col("seq")] if "seq" in results.columns else []), F.col("error").isNull().alias("ok"), "title", "text", "html")
    kept = [c for c in ("title", "preview", "html", "text", "error") if c in results.columns]
    results = results.groupBy("url").agg(F.max_by(F.struct(*kept), rank).alias("_r")).select("url", "_r.*")
    r = results.select(
        "url", F.col("title").alias("_title"), F.col("preview").alias("_preview"),
        F.col("html").alias("_html"), F.col("text").alias("_text"), F.col("error").alias("_error"),
        F.lit(True).alias("_hit"))
    j = registry.join(r, "url", "left")
    ok = F.col("_hit") & F.col("_error").isNull()
    bad = F.col("_hit") & F.col("_error").isNotNull()

    def pick(new, old):
        return F.when(ok, F.col(new)).otherwise(F.col(old))

    return j.select(
        "id", "url", "type",
        pick("_title", "title").alias("title"),
        pick("_preview", "content_preview").alias("content_preview"),
        pick("_html", "extracted_content").alias("extracted_content"),
        F.when(ok, blank("_text")).otherwise(F.col("full_text_content")).alias("full_text_content"),
        F.when(ok, F.lit(STATUS_COMPLETED)).when(bad, F.lit(STATUS_FAILED)).otherwise(F.col("status")).alias("status"),
        "created_at",
        F.when(F.col("_hit"), ts).otherwise(F.col("updated_at")).alias("updated_at"),
    )


# --------------------------------------------------------------------------- I12

def vector_records(results: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I12 input: look up id and updated_at by URL; returns (records, errors).

    Only rows that have a vector become records; a URL missing from the
    registry gives an error row and the job continues. Records carry the norm
    and the per-document match inputs of the search.
    """
    from seekrank.operators.ranking import doc_features
    from seekrank.operators.retrieval import with_norm
    with_vec = results.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))
    if "error" in results.columns:  # a failed row is marked failed, not synced
        with_vec = with_vec.filter(F.col("error").isNull())
    reg = registry.select("url", "id", F.col("updated_at").alias("_reg_updated_at"))
    j = with_vec.join(reg, "url", "left")
    records = doc_features(with_norm(j.filter(F.col("id").isNotNull()).select(
        "id", "vector", "url", "type", "title", F.col("preview").alias("snippet"),
        F.col("_reg_updated_at").alias("updated_at"),
        *([F.col("seq")] if "seq" in results.columns else []))))
    errors = j.filter(F.col("id").isNull()).select(
        "url", F.lit("Failed to find URL in database").alias("error"))
    return records, errors


def vector_changes(records: DataFrame) -> DataFrame:
    """One record per id, the newest (``seq``, else updated_at), with all stored columns."""
    if "seq" in records.columns:
        order = F.col("seq").desc()
    else:
        order = F.col("updated_at").desc_nulls_last()
    one = Window.partitionBy("id").orderBy(order, F.col("url"))
    return (records.withColumn("_rn", F.row_number().over(one)).filter("_rn = 1")
                   .select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in VECTOR_SCHEMA.fields)))


def upsert_vectors(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Replace vector, metadata and stored match inputs by id."""
    cols = [f.name for f in VECTOR_SCHEMA.fields]
    latest = vector_changes(records)
    keep = vectors.join(latest.select("id"), "id", "left_anti")
    return keep.select(*cols).unionByName(latest)
