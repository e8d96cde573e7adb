"""Searches over every row as a request: the request set, and what travels for them; an upload is read once."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seekrank.operators import cells, lexical, retrieval
from seekrank.operators.automaton import batch_match_flags
from seekrank.plans import catalog
from seekrank.plans import fixtures as fx
from seekrank.sources.tables import TABLES
from tools.compare import canon


@pytest.mark.parametrize("name", ["r12_paginate", "r14_search_meta", "v3_filter_types", "v4_cell_topk", "l3_text_score", "l4_text_search"])
def test_requests_of_all_rows_equal_the_sql(spark, sf, name):
    """The rules hold for every form of request, and the SQL has no part of the rows as its requests."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = entry.oracle_sql()[name]
    assert "% 50 = 0" not in sql and "// 50" not in sql
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) and canon(got) == canon(duckdb.sql(sql, connection=con).df())


def test_every_embedding_is_a_request(spark, scratch):
    """V4: also embeddings whose id 50 does not divide, and one without an id; even ids ask for their own label."""
    spark.createDataFrame([(i, [1.0, float(i or 0)], 3) for i in (0, 1, 50, 51, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{scratch}/embeddings.parquet")
    _, queries = catalog.embedding_requests(spark, scratch)
    asked = {r["query_id"]: r["types"] for r in queries.collect()}
    assert asked == {0: ["l3"], 1: [], 50: ["l3"], 51: [], None: []}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{scratch}/embeddings.parquet/*.parquet'")
    for name in ("v4_vector_topk", "v4_vector_topk_numpy", "v4_cell_topk"):
        assert {0, 1, 50, 51} <= set(con.sql(entry.oracle_sql()[name]).df()["query_id"].dropna())


def test_searches_take_every_page(spark, sf):
    """Registered searches answer pages that 50 does not divide: as many requests as there are pages."""
    pages = {r[0] for r in fx.urls_fx(spark, sf).select("id").collect()}
    assert {r[0] - 1 for r in entry.queries()["r14_search_meta"](spark, sf).select("query_id").collect()} == pages
    assert {r[0] - 1 for r in entry.queries()["l4_text_search_meta"](spark, sf).select("query_id").collect()} == pages


def test_pages_without_a_number(spark, scratch):
    """They are requests like any other page."""
    rows = [(i, f"https://a.example.com/en/{i}", "<title>a b</title>") for i in (0, 1, 50, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    key = lambda df: sorted((r["query_id"] for r in df.select("query_id").collect()), key=lambda x: x or 0)
    assert key(fx.queries_fx(spark, scratch)) == [None, 1, 2, 51]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{scratch}/pages.parquet/*.parquet'")
    assert len(con.sql(entry.oracle_sql()["v1_normalise_queries"]).df()) == 4


def test_requests_travel_as_lists(spark):
    """V3: a type's requests meet its rows as one list, and rows and requests may repeat or lack an id."""
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "a")]
    asked = [(i, None if i % 4 == 0 else [] if i % 4 == 1 else ["a", "a", "b"] if i % 4 == 2 else [None, "c"]) for i in range(40)] + [(None, ["a"]), (3, ["b"]), (3, ["b"])]
    r = spark.createDataFrame(rows, "id long, type string")
    q = spark.createDataFrame(asked, "query_id long, types array<string>").coalesce(1)
    got = retrieval.allowed_rows(r, q)
    key = lambda t: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in t)
    want = [(i, *row) for i, types in asked for row in rows if not types or (row[1] is not None and row[1] in types)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert "collect_list" in got._jdf.queryExecution().executedPlan().toString()


def test_dealt_lists_are_not_broadcast(spark):
    """V3: few lists, dealt to every group, don't go through the driver, and the groups of pairs are not put together into one task."""
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None) for i in range(90)], "id long, type string")
    asked = spark.createDataFrame([(i, (None, [], ["a"], ["b", "c", "b"])[i % 4]) for i in range(20)], "query_id long, types array<string>")
    got = retrieval.allowed_rows(rows, asked)
    want = sorted((i, r["id"]) for i, types in asked.collect() for r in rows.collect() if not types or (r["type"] is not None and r["type"] in types))
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == want
    shown = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not any("BroadcastHashJoin" in line and "_g" in line for line in shown.splitlines())
    assert got.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_rows_are_found_once_per_profile(spark):
    """L2: equal requests share one profile's first rows, which are each request's own."""
    rows = [(i, f"https://a.example.com/{i}", "en" if i % 2 else "fr", "alpha", "text", ("completed", "pending", "failed")[i % 3], None) for i in range(40)]
    registry = spark.createDataFrame(rows, "id long, url string, type string, title string, content_preview string, status string, updated_at timestamp_ntz")
    asked = [(q, "alpha", ["en"] if q % 3 == 0 else None) for q in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, query string, types array<string>")
    got = lexical.text_filter(registry, queries, max_rows=7)
    rank = lambda r: (("completed", "pending", "failed").index(r[5]), r[0])
    want = [(q, r[0]) for q, _, types in asked for r in sorted((r for r in rows if not types or r[2] in types), key=rank)[:7]]
    assert sorted((r["query_id"], r["id"]) for r in got.select("query_id", "id").collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(profile" in plan and "row_number() windowspecdefinition(query_id" not in plan


def tile(ids, vectors, asked):
    one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t))
    return pa.record_batch({
        "id": one(ids, pa.int64()), "vector": pa.array([vectors.tobytes()], pa.binary()), "norm": one(np.linalg.norm(vectors, axis=1), pa.float64()),
        "type": one(["a"] * len(ids), pa.string()), "query_id": one(list(range(len(asked))), pa.int64()), "qvec": pa.array([asked.tobytes()], pa.binary()),
        "qnorm": one(np.linalg.norm(asked, axis=1), pa.float64()), "k": one([3] * len(asked), pa.int32()), "types": one([[]] * len(asked), pa.list_(pa.string()))})


@pytest.mark.parametrize("scores, held", [(1 << 20, 1 << 20), (30, 40)])
def test_a_task_passes_on_the_best_of_its_tiles(monkeypatch, scores, held):
    """V4: not k rows per query and tile, and the same rows when scores and rows held are bounded tightly."""
    monkeypatch.setattr(retrieval, "SCORES", scores)
    monkeypatch.setattr(retrieval, "HELD", held)
    rng = np.random.default_rng(1)
    vectors, asked = rng.integers(-2, 3, (200, 3)).astype(float), rng.integers(-2, 3, (8, 3)).astype(float)
    out = list(retrieval._best_of_task(tile(list(range(lo, lo + 10)), vectors[lo: lo + 10], asked) for lo in range(0, 200, 10)))
    rows = [tuple(r.values()) for b in out for r in b.select(["query_id", "id", "score"]).to_pylist()]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (asked @ vectors.T) / np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(vectors, axis=1))
    s[~np.isfinite(s)] = 0
    for q in range(8):
        best = sorted(((-sc, i) for i, sc in enumerate(s[q])))[:3]
        mine = sorted((-sc, i) for p, i, sc in rows if p == q)
        assert [i for _, i in mine[:3]] == [i for _, i in best]
    assert len(rows) == 24 if held > 40 else len(rows) < 20 * 24


def test_query_tiles_go_to_groups_of_cells(spark, monkeypatch):
    """A tile of queries that visits every cell travels once per group."""
    sent = cells.dealt_tiles(spark.createDataFrame([(list(range(-1, 500)),), ([7],)], "cells array<int>"), 4)
    assert sorted(r["g"] for r in sent.collect()) == [0, 1, 2, 3, 3]
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "a") for i in range(300)], "id long, vector array<double>, type string")
    monkeypatch.setattr(cells, "ROUNDS", (1, 25))
    index = cells.build_cells(rows, cells=24)
    q = rows.filter("id < 20").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.lit(290).alias("k"))
    top, report = cells.cell_topk(index, q)
    assert top.count() == 20 * 290
    told = report.collect()
    assert sum(r["cells_read"] for r in told) > 4 * sum(r["query_tiles"] for r in told)  # more cells than groups
    want = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(rows, q, with_meta=False).collect()}
    assert {(r["query_id"], r["id"]) for r in top.collect()} == want


def test_dealt_query_strings_are_not_broadcast(spark):
    """R2 by automaton: few query strings, dealt to every group, don't go through the driver; the flags are those of brute force."""
    words = ("alpha", "beta", "gamma")
    docs = spark.createDataFrame([(i, f"https://x/{words[i % 3]}", words[i % 2], None if i % 5 == 0 else words[i % 3]) for i in range(60)] + [(None, None, "Alpha", "x")],
                                 "id long, url string, title string, snippet string")
    asked = spark.createDataFrame([("Alpha",), ("beta",), ("alpha",), (" ",), (None,)], "query string")
    got = batch_match_flags(docs, asked)
    want = {(q, r["id"], *(q.lower() in (r[c] or "").lower() for c in ("title", "url", "snippet"))) for q in ("Alpha", "beta", "alpha") for r in docs.collect()}
    rows = [tuple(r) for r in got.filter("trim(query) <> ''").collect()]
    assert set(rows) == {w for w in want if any(w[2:])} and len(rows) == len(set(rows))
    got.collect()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_dealt_query_tiles_are_not_broadcast(spark, monkeypatch):
    """V4: tiles of queries, dealt to every group, don't go through the driver, and later rounds send the k-th scores with them."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "ab"[i % 2]) for i in range(300)] + [(None, [1.0] * 4, "a")], "id long, vector array<double>, type string")
    q = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.lit(5).alias("k"), F.array("type").alias("types"))
    written, keep = {}, cells.staged
    monkeypatch.setattr(cells, "ROUNDS", (1, 6, 25))
    monkeypatch.setattr(cells, "staged", lambda df, what: written.setdefault(what, []).append((df, keep(df, what))) or written[what][-1][1])
    top, _ = cells.cell_topk(cells.build_cells(rows, cells=24), q)
    by_tiles = retrieval.vector_topk(rows, q, with_meta=False)
    key = lambda df: sorted(((r["query_id"], r["id"]) for r in df.collect()), key=str)
    assert key(top) == key(by_tiles)
    for shown in [df._jdf.queryExecution().executedPlan().toString() for df, _ in written["cell-best"]] + [by_tiles._jdf.queryExecution().executedPlan().toString()]:
        assert "SortMergeJoin [g" in shown and not any("BroadcastHashJoin [g" in line for line in shown.splitlines())
    first, later, _ = ([x for r in kept.select("least").collect() for x in r["least"]] for _, kept in written["visits"])
    assert set(first) == {float("-inf")} and np.isfinite(later).mean() > 0.5


def test_an_upsert_reads_its_upload_once(spark, scratch):
    """I4: the next registry is made from the written URLs of the upload, not from its rows again."""
    from seekrank.operators.ingest import empty_registry, upsert_urls
    rows = [(i, "blog", f"https://a.example.com/{i % 7}") for i in range(20)] + [(20, " ", "https://b.example.com/"), (21, "x", None)]
    spark.createDataFrame(rows, "row_no long, type string, url string").write.parquet(f"{scratch}/upload")
    upload = spark.read.parquet(f"{scratch}/upload")
    first = upsert_urls(empty_registry(spark), upload.filter("row_no < 5"), "2024-01-01 00:00:00")
    second = upsert_urls(first, upload, "2024-01-02 00:00:00")
    assert f"{scratch}/upload" not in second._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["url"]) for r in second.collect()) == [(i + 1, f"https://a.example.com/{i}") for i in range(7)]


def test_rows_passed_on_do_not_grow_with_the_tiles(spark, monkeypatch):
    """V4: a query passes on about FIRST times k rows, not k of every tile; the best rows are those of brute force, with repeated and missing ids."""
    rng = np.random.default_rng(5)
    vectors, asked = rng.normal(size=(6000, 8)), rng.normal(size=(12, 8))
    vectors[7] = vectors[8] = 0
    types, lists = ["ab"[i % 2] for i in range(6000)], [[], None, ["a"], ["none"]]
    rows = spark.createDataFrame([(i, vectors[i].tolist(), types[i]) for i in range(6000)], "id long, vector array<double>, type string").repartition(3)
    q = spark.createDataFrame([(i, asked[i].tolist(), 10, lists[i % 4]) for i in range(12)] + [(None, asked[0].tolist(), 3, None), (1, asked[1].tolist(), 10, None)],
                              "query_id long, qvec array<double>, k int, types array<string>")
    cfg = retrieval.SearchConfig(tile_bytes=8 * 8 * 20)  # 300 tiles
    top = {}
    for r in retrieval.vector_topk(rows, q, cfg, with_meta=False).collect():
        top.setdefault(r["query_id"], []).append(r["id"])
    s = (asked @ vectors.T) / np.maximum(np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(vectors, axis=1)), 1e-300)
    for i in range(12):
        best = [j for j in np.argsort(-s[i], kind="stable").tolist() if not lists[i % 4] or types[j] in lists[i % 4]][:10]
        assert sorted(top.get(i, [])) == sorted(best if i != 1 else best[:5] * 2)
    assert len(top[None]) == 3
    stored, known = retrieval.with_norm(rows), q.withColumn("qnorm", retrieval.l2_norm("qvec"))
    least = retrieval._least_scores(retrieval._best_of_groups(stored.filter(F.pmod(F.xxhash64("id"), F.lit(retrieval.FIRST)) == 0), known, 2, 2, cfg))
    assert least.filter("query_id = 3").count() == 0  # no k rows: no bound
    monkeypatch.setattr(retrieval, "_best_of_task", retrieval._best_of_tiles)
    passed = retrieval._best_of_groups(stored, known.join(least, "query_id", "left").filter("query_id is not null"), 300, 1, cfg).count()
    every = retrieval._best_of_groups(stored, known.filter("query_id is not null"), 300, 1, cfg).count()
    assert passed < 10 * 10 * 3 * retrieval.FIRST < every / 3


def test_tiles_travel_by_cores_not_by_shuffle_partitions(spark, monkeypatch):
    """V4: many shuffle partitions don't send the tiles of queries and of the first rows more often, and the best rows stay the same."""
    sent, deal = [], retrieval._best_of_groups
    monkeypatch.setattr(retrieval, "_best_of_groups", lambda rows, asked, r, q, cfg: (sent.append((r, q)), deal(rows, asked, r, q, cfg))[1])
    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, (400, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(vectors)], "id long, vector array<double>, type string").repartition(6)
    q = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.lit(7).alias("k"))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.nan_to_num((vectors @ vectors.T) / np.outer(np.linalg.norm(vectors, axis=1), np.linalg.norm(vectors, axis=1)))
    want = {(i, j) for i in range(0, 400, 50) for j in np.lexsort((np.arange(400), -s[i].round(9)))[:7].tolist()}
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (2, 40 * cores):
            sent.clear()
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = retrieval.vector_topk(rows, q, with_meta=False).select("query_id", "id").collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
            assert all(r * q <= max(retrieval.FIRST_GROUPS, min(partitions, retrieval.GROUPS * cores)) for r, q in sent) and len(sent) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_match_inputs_of_copies(spark, sf):
    """Stored match inputs stay those of the row's own texts, also for a copy with another URL."""
    from seekrank.operators.ranking import FEATURES, doc_features
    got = catalog._attributed_matches(spark, sf)
    made = doc_features(got.drop(*FEATURES))
    assert got.filter("id like '%-copy'").count() and got.count() == got.select("query_id", "id").distinct().count()
    assert got.select("query_id", "id", *FEATURES).exceptAll(made.select("query_id", "id", *FEATURES)).count() == 0
