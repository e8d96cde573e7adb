"""Bucketed versioned tables, the layout by type, the crawl lookup and the cell index: plans and results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekrank.operators import cells
from seekrank.operators.ingest import empty_registry, fetch_pages, upsert_urls_changes
from seekrank.operators.retrieval import allowed_rows, vector_topk, write_by_type
from seekrank.streaming import snapshots
from tests.test_plans import plan


def registry(spark, n):
    null = F.lit(None).cast("string")
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("https://x/"), "id").alias("url"), F.lit("t").alias("type"), null.alias("title"), null.alias("content_preview"), null.alias("extracted_content"),
        null.alias("full_text_content"), F.lit("completed").alias("status"), *(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")))


def test_a_batch_does_not_exchange_the_registry(spark, scratch):
    """Known URLs are found, and a batch committed, without an exchange of the base or a scan for the largest id."""
    root, empty = scratch + "/registry", empty_registry(spark)
    snapshots.commit(spark, root, registry(spark, 100_000), "url", 0, 0)
    assert snapshots.largest_id(spark, root) == 100_000
    rows = spark.range(99_950, 100_050).select(F.col("id").alias("row_no"), F.lit("t").alias("type"), F.concat(F.lit("https://x/"), F.col("id") + 1).alias("url"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", keep):  # by sorted buckets, and with the batch sent to all tasks
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            current = snapshots.read_latest(spark, root, empty, "url")
            joined = plan(current.join(rows.select("url"), "url", "left_semi"))
            base = next(part for part in re.split(r"\n(?=\s*:?\s*[+:]- )", joined) if "FileScan parquet spark_catalog" in part)
            above = joined[:joined.index(base)].split("Join")[-1]
            assert "Exchange" not in above and ("Bucketed: true" in base or threshold != "-1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    changed = upsert_urls_changes(snapshots.read_latest(spark, root, empty, "url"), rows, "2024-02-01 00:00:00", snapshots.largest_id(spark, root))
    snapshots.commit(spark, root, changed, "url", 1, 1)
    got = snapshots.read_latest(spark, root, empty, "url")
    assert (got.count(), got.select("url").distinct().count(), got.filter("status = 'pending'").count()) == (100_050, 100_050, 100)
    assert got.agg(F.max("id")).first()[0] == 100_050 == snapshots.largest_id(spark, root) and snapshots.largest_id(spark, root, before=1) == 100_000
    written = spark.read.parquet(f"{root}/data").filter(f"{snapshots.VERSION} = 1")
    assert written.count() == 100  # the commit has its own size


def test_point_lookups_read_their_buckets(spark, scratch):
    root, empty = scratch + "/registry", empty_registry(spark)
    snapshots.commit(spark, root, registry(spark, 20_000), "url", 0, 0)
    found = snapshots.find_keys(spark, root, empty, "url", ["https://x/77", "https://x/0"])
    assert [r["id"] for r in found.collect()] == [77]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells the buckets
    try:
        read = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(snapshots.find_keys(spark, root, empty, "url", ["https://x/77", "https://x/0"])))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert read and int(read[1]) <= 2 and int(read[2]) == snapshots.BUCKETS


def test_a_table_of_another_application(spark, scratch):
    """A table that this session's catalog doesn't know, or whose newest versions it hasn't seen."""
    root, empty = scratch + "/t", spark.createDataFrame([], "id long, v string")
    rows = lambda v: spark.createDataFrame([(i, v) for i in range(50)], "id long, v string")
    snapshots.commit(spark, root, rows("a"), "id", 0, 0)
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("versioned_") and root in str(spark.sql(f"DESCRIBE EXTENDED {t.name}").collect()))
    snapshots.commit(spark, root, rows("b"), "id", 1, 1)
    spark.sql(f"ALTER TABLE {name} DROP PARTITION ({snapshots.VERSION} = 1)")  # an external table keeps its files
    assert {r["v"] for r in snapshots.read_latest(spark, root, empty, "id").collect()} == {"b"}
    spark.sql(f"DROP TABLE {name}")
    got = snapshots.read_latest(spark, root, empty, "id").collect()
    assert {r["v"] for r in got} == {"b"} and len(got) == 50


def test_lists_prune_the_folders_of_other_types(spark, scratch):
    rows = spark.range(5000).select("id", F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("type"))
    write_by_type(rows, scratch + "/typed")
    asked = spark.createDataFrame([(1, ["t3", "t3", "no"]), (2, ["t3", "t7"])], "query_id long, types array<string>")
    found = allowed_rows(spark.read.parquet(scratch + "/typed").select("id", "type"), asked)
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 500), (2, 1000)]
    assert "dynamicpruning" in plan(found)
    none = spark.createDataFrame([(3, None), (4, [])], "query_id long, types array<string>")
    assert allowed_rows(rows, none).count() == 10_000


def test_lookup_reduces_the_crawl_first(spark, scratch):
    """The html of pages that no work item names is not exchanged."""
    spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x/"), "id").alias("url"), F.repeat(F.lit("h"), 50).alias("html")).write.parquet(scratch + "/pages")
    work = spark.range(0, 20_000, 1000).select(F.concat(F.lit("https://x/"), "id").alias("url"))
    done = fetch_pages(work, spark.read.parquet(scratch + "/pages"))
    assert done.filter("html is not null").count() == 20
    text = plan(done)
    scan = text.index("FileScan parquet [page_id")
    assert "Join" in text[:scan] and "LeftSemi" in text[:scan].split("Exchange hashpartitioning(url")[-1]


def brute_topk(rows, queries):
    out = {}
    for qid, qv, k, types in queries:
        scored = []
        for i, v, kind in rows:
            norm = np.linalg.norm(v) * np.linalg.norm(qv)
            s = float(np.dot(v, qv) / norm) if norm > 0 and np.isfinite(norm) else 0.0
            if not types or kind in types:
                scored.append((-round(s, 9), i))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_cells_equal_the_exhaustive_search(spark, monkeypatch, kind):
    """Equal rows, and the share of cells skipped: most on clustered vectors, few on random ones."""
    monkeypatch.setattr(cells, "QUERY_BYTES", 600)
    rng = np.random.default_rng(1)
    n, dim = 1500, 12
    centres = rng.normal(size=(30, dim)) * 4
    vecs = centres[rng.integers(0, 30, n)] + 0.15 * rng.normal(size=(n, dim)) if kind == "clustered" else rng.normal(size=(n, dim))
    rows = [(i, [float(x) for x in v], f"t{i % 4}") for i, v in enumerate(vecs)] + [(n + 1, [0.0] * dim, "t1"), (n + 2, [1.0] * dim, None), (n + 3, [1.0] * dim, "t2")]
    queries = [(i, rows[i * 7][1], 1 + i % 5, [None, [], ["t1"], ["t2", "t3"], ["none"]][i % 5]) for i in range(60)] + [(100, [0.0] * dim, 3, None), (101, [1.0] * dim, 2, None)]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(n + 9, None, "t1", None)], "id long, vector array<double>, type string, url string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, qvec array<double>, k int, types array<string>")
    index = cells.build_cells(df, cells=30)
    assert index.known.rows.sum() == len(rows)
    top, report = cells.cell_topk(index, asked)
    got = {}
    for r in sorted(top.collect(), key=lambda r: (-round(r["score"], 9), r["id"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    want = brute_topk(rows, queries)
    assert got == {q: ids for q, ids in want.items() if ids} and report.count() == len(cells.ROUNDS)
    whole = {(r["query_id"], r["id"]) for r in vector_topk(df, asked, with_meta=False).collect()}
    assert {(q, i) for q, ids in got.items() for i in ids} == whole
    queries = [q for q in queries if not q[3] and any(q[1])]  # a list that allows few rows keeps the k-th score low
    told = cells.cell_topk(index, asked.filter("coalesce(size(types), 0) <= 0 and query_id <> 100"))[1].collect()
    tiles = -(-len(queries) // (600 // (8 * dim)))
    share = sum(r["cells_read"] for r in told) / (tiles * len(index.known.cells))
    print(kind, "share of cells read:", round(share, 3))
    assert share < 0.75 if kind == "clustered" else share > 0.2


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<float>, type string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 3)], "query_id long, qvec array<double>, k int")
    assert cells.cell_topk(cells.build_cells(none), asked)[0].count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0], "t") for i in range(5)], "id long, vector array<float>, type string")
    assert sorted(r["id"] for r in cells.cell_topk(cells.build_cells(zeros), asked)[0].collect()) == [0, 1, 2]
