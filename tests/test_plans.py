"""Shapes of the plans that must hold at any size."""

import re

from pyspark.sql import functions as F

from seekrank.plans import catalog
from seekrank.plans import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_product_nodes(spark, sf):
    from seekrank.operators.lexical import text_filter
    from seekrank.operators.retrieval import normalise_queries, vector_topk
    corpus, queries = catalog.embedding_requests(spark, sf)
    matched = text_filter(fx.urls_fx(spark, sf), normalise_queries(fx.queries_fx(spark, sf)))
    for df in (vector_topk(corpus, queries), matched, catalog.SPARK["t4_query_phrases"](spark, sf)):
        assert not re.search("CartesianProduct|NestedLoop", plan(df))


def test_ranking_of_text_matches_carries_no_texts(spark, sf):
    """Between the match join and the page rows only ids, numbers and dates are exchanged, by profile of the requests."""
    from seekrank.operators.lexical import text_search
    page, _ = text_search(fx.urls_fx(spark, sf), fx.queries_fx(spark, sf), fx.NOW)
    ranked = [b for b in plan(page.select("query_id", "id", "rank", "score")).split("Exchange hashpartitioning(profile")[1:]]
    assert ranked
    for below in ranked:
        row = below.split("\n")[1]
        assert "title" not in row and "content_preview" not in row and "snippet" not in row


def test_ranking_of_matches_carries_no_match_inputs(spark, sf):
    """Match inputs are not made per pair, copies come without a second top-k, and no text of a match is exchanged for ranking."""
    shown = plan(catalog.SPARK["r11_filter_text"](spark, sf))
    assert "Union" not in shown
    after = shown.split("WindowGroupLimit")[-1]
    assert "f_ns" in after and "regexp_replace(lower(coalesce(snippet" not in after
    for below in shown.split("Exchange hashpartitioning(query_id")[1:]:
        assert "f_n" not in below.split("\n")[1] and "snippet" not in below.split("\n")[1]


def test_a_request_that_matches_everything(spark, sf):
    """A blank query over copies of the registry: the total counts every row, the page is right."""
    from seekrank.operators.lexical import text_search
    from seekrank.session import checkpoint_dir
    urls = fx.urls_fx(spark, sf).drop("extracted_content", "full_text_content")
    checkpoint_dir(spark)
    many = urls.crossJoin(spark.range(100).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") * 100 + F.col("copy")).drop("copy").checkpoint()
    asked = spark.createDataFrame([(1, "", 20, 2)], "query_id long, query string, per_page long, page long")
    page, meta = text_search(many, asked, fx.NOW)
    rows = page.orderBy("rank").collect()
    assert meta.first()["total_available"] == many.count() and [r["rank"] for r in rows] == list(range(1, 21))
    best = sorted(((-int(r["s"] * 1000 + 0.5), r["id"]) for r in _scored(many)))[20:40]
    assert [r["id"] for r in rows] == [i for _, i in best]


def _scored(urls):
    """0.35 and the recency of a blank query, by hand."""
    hours = F.timestamp_diff("SECOND", F.col("updated_at"), F.lit(fx.NOW).cast("timestamp_ntz")) / 3600.0
    return urls.select("id", (F.lit(0.35) + F.when(hours < 72, F.greatest(F.lit(0.0), 0.2 * (1 - hours / 72))).otherwise(0.0)).alias("s")).collect()


def test_upload_reports_of_streams(spark, scratch):
    """A file that can't be read is reported, and the others are stored."""
    import os
    from seekrank.operators.ingest import empty_registry
    from seekrank.streaming import snapshots
    from seekrank.streaming.uploads import stream_uploads
    inbox = os.path.join(scratch, "in")
    os.makedirs(inbox)
    for name, text in (("good.csv", "type,url\nblog,https://a/\n"), ("bad.csv", "type,url\na,b,c\n")):
        with open(os.path.join(inbox, name), "w") as f:
            f.write(text)
    for _ in range(2):  # the second start finds nothing new
        stream_uploads(spark, inbox, scratch + "/reg", lambda b: "2024-01-01 00:00:00", checkpoint=scratch + "/ck", report_path=scratch + "/report").awaitTermination()
    report = {os.path.basename(r["upload_id"]): (r["row_count"], r["url_count"], r["error"]) for r in spark.read.parquet(scratch + "/report").collect()}
    assert report["good.csv"] == (1, 1, None) and "Record Length" in report["bad.csv"][2]
    assert snapshots.read_latest(spark, scratch + "/reg", empty_registry(spark), "url").count() == 1
