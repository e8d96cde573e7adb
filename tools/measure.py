"""

Usage: python tools/measure.py [sf_dir]
Larger inputs are copies of the given tables with a copy number, built by Spark.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seekrank.operators.embed import HashedBow  # noqa: E402
from seekrank.operators.ingest import extract_pages, shape_content  # noqa: E402
from seekrank.operators.lexical import text_search  # noqa: E402
from seekrank.operators.retrieval import vector_topk, with_norm  # noqa: E402
from seekrank.operators.snippets import add_best_paragraph, add_phrases  # noqa: E402
from seekrank.plans import catalog, fixtures as fx  # noqa: E402
from seekrank.session import checkpoint_dir, local_session  # noqa: E402
from seekrank.sources.tables import load  # noqa: E402

RUNS = 5


def timed(name: str, run, rows: int) -> None:
    times = []
    for i in range(RUNS + 1):
        t0 = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - t0)
    mid = statistics.median(times[1:])
    print(f"| {name} | {mid:.2f} | {rows / mid:,.0f} |", flush=True)


def copies(df, n: int, key: str):
    """``n`` copies of a table, told apart by their own column; keys become strings of both."""
    return (df.crossJoin(df.sparkSession.range(n).withColumnRenamed("id", "copy"))
            .withColumn(key, F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))).drop("copy"))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="seekrank-measure")
    checkpoint_dir(spark)
    print("| measure | median s | rows/s |\n|---|---|---|")
    corpus, queries = catalog.embedding_requests(spark, sf)
    n = corpus.count()
    for times, asked, k in ((1, 1, 100), (1, 100, 100), (1, n, 10), (50, 100, 100), (50, 1000, 1000)):
        big = with_norm(copies(corpus, times, "id")).checkpoint()
        q = queries.orderBy("query_id").limit(asked).withColumn("k", F.lit(k)).checkpoint()
        timed(f"vector top-k, {n * times} vectors, {min(asked, n)} queries, k {k}", lambda: vector_topk(big, q, with_meta=False), min(asked, n))
    many = copies(queries, -(-50_000 // n), "query_id").limit(50_000).checkpoint()
    timed(f"vector top-k, {n} vectors, 50000 queries, k 10", lambda: vector_topk(corpus, many, with_meta=False), 50_000)
    pages = load(spark, sf, "pages")
    wide = copies(pages, 10, "page_id").checkpoint()
    bow = HashedBow(64)
    timed(f"ingest: extract, shape, embed, {wide.count()} pages",
          lambda: shape_content(extract_pages(wide)).withColumn("vector", bow.column("embed_text")).select("page_id", "preview", "vector"), wide.count())
    docs = fx.paragraphs_fx(spark, sf).checkpoint()
    timed(f"snippets: best paragraph and phrases, {docs.count()} documents",
          lambda: add_phrases(add_best_paragraph(docs, "content", "query", "p"), "p", "query", "ph").select("doc_id", "p", "ph"), docs.count())
    urls = fx.urls_fx(spark, sf).drop("extracted_content", "full_text_content").checkpoint()
    asked = fx.queries_fx(spark, sf).orderBy("query_id").checkpoint()
    for times, n_q in ((1, 100), (100, 1), (100, 100)):
        reg = copies(urls, times, "id").checkpoint()
        timed(f"text search, {reg.count()} URLs, {n_q} queries", lambda: text_search(reg, asked.limit(n_q), fx.NOW)[0], n_q)


if __name__ == "__main__":
    main()
