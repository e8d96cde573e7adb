"""Sources (I1, I2), upserts (I4, I12), embedder routing (I10) and streams."""

import os

import pytest
from pyspark.sql import functions as F

from seekrank.operators.embed import BatchEmbedder, EmbedError, HashedBow, embed
from seekrank.operators.ingest import empty_registry, empty_vectors, upload_report, upsert_urls, validate_url_rows
from seekrank.operators.numbering import dense_ids
from seekrank.sources.csv_urls import read_upload_payloads, read_url_csv
from seekrank.streaming import snapshots
from seekrank.streaming.uploads import encode_csv, stream_process, stream_uploads

CSV_OK = '﻿ ID , Type,URL\n1, blog ,https://a.example.com/x\n\n2,news,"https://b.example.com/y,z"\n3,"multi\nline",https://c.example.com/\n'


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_read_url_csv_header_bom_blank_quoted(spark, scratch):
    p = _write(scratch, "a.csv", CSV_OK)
    rows = validate_url_rows(read_url_csv(spark, p)).orderBy("row_no").collect()
    assert [(r["id"], r["type"], r["url"]) for r in rows] == [
        ("1", "blog", "https://a.example.com/x"), ("2", "news", "https://b.example.com/y,z"),
        ("3", "multi\nline", "https://c.example.com/")]


def test_read_url_csv_ragged_rejected(spark, scratch):
    """A ragged file rejects itself, with a report, and the files beside it are read."""
    files = {"bad.csv": "type,url\nblog,https://a.example.com,extra\n", "good.csv": "url,type\nhttps://g/,blog\n", "short.csv": "id,type,url\n1,blog,https://s/\n2,blog\n",
             "open.csv": 'type,url\nblog,"https://o/\nnews,https://p/\n', "head.csv": "type,url\n", "blank.csv": "\n \n"}
    for name, text in files.items():
        _write(scratch, name, text)
    got = read_url_csv(spark, scratch)
    assert [(r["file_name"], r["type"], r["url"]) for r in got.filter("error is null").collect()] == [("good.csv", "blog", "https://g/")]
    errors = {r["file_name"]: r["error"] for r in got.filter("error is not null").collect()}
    assert errors.pop("open.csv").startswith("Quote Not Closed")
    empty = "CSV file is empty or contains no data rows"
    assert errors == {"bad.csv": "Invalid Record Length: expected 2, got 3", "short.csv": "Invalid Record Length: expected 3, got 2",
                      "head.csv": empty, "blank.csv": empty}
    report = {r["upload_id"].rsplit("/", 1)[1]: (r["row_count"], r["url_count"]) for r in upload_report(got).collect()}
    assert report["good.csv"] == (1, 1) and report["bad.csv"] == (0, 0) and len(report) == len(files)
    lax = read_url_csv(spark, os.path.join(scratch, "short.csv"), strict=False).collect()
    assert sorted((r["id"], r["url"]) for r in lax) == [("1", "https://s/"), ("2", None)]


def test_one_file_is_read_by_many_tasks(spark, scratch):
    """Fields with line breaks, commas and quotes in a file of many byte ranges, some wholly inside one field."""
    import csv
    import io
    import random
    r, rows = random.Random(7), []
    for i in range(3000):
        note = "".join(r.choices(["a", "\n", ",", '"', " x", "\r\n", "\u00e9"], k=r.randrange(30)))
        rows.append((str(i), "blog" + "\n" * (i % 3), f"https://x/{i}", note if i != 1500 else "line\n" * 20_000))
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([("Id", "TYPE", "url", "note"), *rows])
    with open(os.path.join(scratch, "large.csv"), "w", encoding="utf-8", newline="") as f:
        f.write(out.getvalue())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(scratch).rdd.getNumPartitions() > 20
        got = read_url_csv(spark, scratch).orderBy("row_no").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [(g["id"], g["type"], g["url"]) for g in got] == [row[:3] for row in rows]
    assert {g["columns_found"] for g in got} == {"Id, TYPE, url, note"} and {g["error"] for g in got} == {None}


def test_payloads(spark):
    rows = [("u1", encode_csv(CSV_OK), None), ("u2", encode_csv("type,url\n"), "f.csv"),
            ("u3", encode_csv("name,link\nx,y\n"), None), ("u4", None, None)]
    out = read_upload_payloads(spark.createDataFrame(rows, "upload_id string, csv_content string, file_name string"))
    got = {r["upload_id"]: r for r in out.filter("error IS NOT NULL").collect()}
    assert got["u2"]["error"] == "CSV file is empty or contains no data rows"
    assert got["u4"]["error"] == "csvContent is required"
    valid = validate_url_rows(out.filter("error IS NULL"))
    assert valid.filter("upload_id = 'u1'").count() == 3 and valid.filter("upload_id = 'u3'").count() == 0
    assert out.filter("upload_id = 'u1'").first()["file_name"] == "upload.csv"


@pytest.mark.parametrize("rows,parts,adaptive", [(3000, 7, True), (60_000, 8, True), (400_000, 16, True), (400_000, 200, False)])
def test_dense_ids_are_dense_and_ordered(spark, rows, parts, adaptive):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(0, rows * 3, 3).select(F.col("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide")).repartition(7)
        out = dense_ids(df, ["k"], F.lit(100))
        got = out.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("id") != 101 + F.col("k") / 3)).first()
        assert tuple(got) == (rows, rows, 101, 100 + rows, 0)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_upsert_of_many_urls_written_to_parquet(spark, scratch):
    rows = spark.range(0, 100_000).select(F.col("id").alias("row_no"), F.lit("t").alias("type"),
                                          F.concat(F.lit("https://x/"), F.repeat(F.md5((F.col("id") % 90_000).cast("string")), 8)).alias("url"))
    upsert_urls(empty_registry(spark), rows, "2024-01-01 00:00:00").write.parquet(scratch + "/reg")
    got = spark.read.parquet(scratch + "/reg").agg(F.count("*"), F.countDistinct("url"), F.countDistinct("id"), F.max("id")).first()
    assert tuple(got) == (90_000,) * 4


def test_upsert_urls_is_idempotent_and_keeps_first_type(spark):
    rows = spark.createDataFrame([(1, "a", "https://x"), (2, "b", "https://x"), (3, "c", "https://y")],
                                 "row_no long, type string, url string")
    r1 = upsert_urls(empty_registry(spark), rows, "2024-01-01 00:00:00")
    r2 = upsert_urls(r1, rows, "2024-01-01 00:00:00")
    a = sorted((r["id"], r["url"], r["type"], r["status"]) for r in r1.collect())
    b = sorted((r["id"], r["url"], r["type"], r["status"]) for r in r2.collect())
    assert a == b == [(1, "https://x", "a", "pending"), (2, "https://y", "c", "pending")]


def test_embed_fallback_routing(spark):
    def primary(texts):
        out = []
        for t in texts:
            if t == "rate":
                out.append(EmbedError("rate limited", 429))
            elif t == "bad":
                out.append(EmbedError("bad request", 400))
            elif t == "empty":
                out.append([])
            else:
                out.append([1.0, 2.0])
        return out

    def secondary(texts):
        return [[9.0, 9.0] if t != "empty" else EmbedError("no", 500) for t in texts]

    df = spark.createDataFrame([("ok",), ("rate",), ("bad",), ("empty",)], "t string")
    out = {r["t"]: r for r in embed(df, "t", BatchEmbedder("p", primary), BatchEmbedder("s", secondary)).collect()}
    assert list(out["ok"]["vector"]) == [1.0, 2.0] and out["ok"]["provider"] == "p"
    assert list(out["rate"]["vector"]) == [9.0, 9.0] and out["rate"]["provider"] == "s"
    assert out["bad"]["vector"] is None and out["bad"]["error"] == "Embedding generation failed: bad request"
    assert out["empty"]["vector"] is None and out["empty"]["error"] == "Embedding generation failed: Generated embedding is empty"


def test_faulty_embedder_answers_stay_with_their_rows(spark):
    def short(texts):
        if len(texts) > 1:
            return [[1.0]]  # too few: asked again text by text
        if texts[0] == "scalar":
            return [3.5]
        if texts[0] == "raise":
            raise RuntimeError("boom")
        return [[float(len(texts[0]))]]

    df = spark.createDataFrame([("a",), ("scalar",), ("raise",), ("bbb",)], "t string").coalesce(1)
    out = {r["t"]: r for r in embed(df, "t", BatchEmbedder("p", short)).collect()}
    assert list(out["a"]["vector"]) == [1.0] and list(out["bbb"]["vector"]) == [3.0]
    assert out["scalar"]["vector"] is None and "not a vector" in out["scalar"]["error"]
    assert out["raise"]["error"] == "Embedding generation failed: boom"


def test_hashed_bow_counts(spark):
    df = spark.createDataFrame([("Alpha beta alpha, GAMMA!",), ("",), ("ab cd",)], "t string")
    vecs = [r["v"] for r in df.select(HashedBow(16).column(F.col("t")).alias("v")).collect()]
    assert sum(vecs[0]) == 4 and max(vecs[0]) >= 2 and sum(vecs[1]) == 0 and sum(vecs[2]) == 0


def test_tile_topk_equals_brute_force(spark):
    import numpy as np
    from seekrank.config import SearchConfig
    from seekrank.operators.retrieval import vector_topk
    rng = np.random.default_rng(3)
    vecs = [(f"d{i:03}", [float(x) for x in rng.integers(-2, 3, 6)], "abc"[i % 3] if i % 7 else None) for i in range(300)] + [("none", None, "a"), ("empty", [], "a")]
    asked = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, 6)], i % 12, [None, [], ["a"], ["a", "c"]][i % 4]) for i in range(40)]
    corpus = spark.createDataFrame(vecs, "id string, vector array<double>, type string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id string, qvec array<double>, k int, types array<string>").repartition(3)
    got = {}
    for r in vector_topk(corpus, queries, SearchConfig(tile_bytes=1500), with_meta=False).collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0
    for q, v, k, types in asked:
        all_ = sorted((-round(cos(v, w), 9), i) for i, w, t in vecs if w and (not types or t in types))
        mine = sorted(got.get(q, []))
        assert [s for s, _ in mine] == [s for s, _ in all_[:k]]
        cut = all_[k - 1][0] if 0 < k <= len(all_) else None
        assert {x for x in mine if x[0] != cut} == {x for x in all_[:k] if x[0] != cut}


def test_empty_url_is_no_result(spark):
    from seekrank.operators.retrieval import vector_topk
    corpus = spark.createDataFrame([(1, [1.0], "a", "", "t", "s", None), (2, [1.0], "a", "u", "t", "s", None), (3, [1.0], "a", None, "t", "s", None)],
                                   "id long, vector array<float>, type string, url string, title string, snippet string, updated_at timestamp_ntz")
    queries = spark.createDataFrame([(1, [1.0], 2000)], "query_id long, qvec array<float>, k long")
    assert [r["id"] for r in vector_topk(corpus, queries).collect()] == [2]


def test_upload_stream_replay_safe(spark, scratch):
    inbox, reg = os.path.join(scratch, "in"), os.path.join(scratch, "reg")
    os.makedirs(inbox)
    _write(inbox, "one.csv", "type,url\nblog,https://a.example.com/\nnews,https://b.example.com/\n")
    clock = lambda b: f"2024-01-0{b + 1} 00:00:00"
    q = stream_uploads(spark, inbox, reg, clock, checkpoint=os.path.join(scratch, "ck1"))
    q.awaitTermination()
    _write(inbox, "two.csv", "URL,Type\nhttps://b.example.com/,other\nhttps://c.example.com/,blog\n")
    q = stream_uploads(spark, inbox, reg, clock, checkpoint=os.path.join(scratch, "ck1"))
    q.awaitTermination()
    snap = snapshots.read_latest(spark, reg, empty_registry(spark), "url")
    got = sorted((r["id"], r["url"], r["type"]) for r in snap.collect())
    assert got == [(1, "https://a.example.com/", "blog"), (2, "https://b.example.com/", "news"),
                   (3, "https://c.example.com/", "blog")]
    # replaying batch 1 from the version before it gives the same snapshot
    from seekrank.sources.csv_urls import read_upload_payloads as parse
    from seekrank.streaming.uploads import order_rows
    before = snapshots.read_latest(spark, reg, empty_registry(spark), "url", before=1)
    payload = spark.createDataFrame([("two.csv", encode_csv("URL,Type\nhttps://b.example.com/,other\nhttps://c.example.com/,blog\n"), "two.csv")],
                                    "upload_id string, csv_content string, file_name string")
    again = upsert_urls(before, order_rows(parse(payload)), clock(1))
    assert sorted((r["id"], r["url"], r["type"]) for r in again.collect()) == got


def test_process_stream(spark, sf, scratch):
    from seekrank.plans.fixtures import urls_fx
    from seekrank.sources.tables import load
    pages = load(spark, sf, "pages")
    reg_root, vec_root = os.path.join(scratch, "reg"), os.path.join(scratch, "vec")
    registry = urls_fx(spark, sf).withColumn("status", F.lit("pending"))
    snapshots.commit(spark, reg_root, registry, "url", -1, -1)
    work_dir = os.path.join(scratch, "work")
    work = registry.select("url", "type", F.col("id").alias("row_no")).unionByName(
        spark.createDataFrame([("https://missing.example.com/", "en", 0)], "url string, type string, row_no long"))
    work.write.parquet(work_dir)
    q = stream_process(spark, work_dir, pages, reg_root, vec_root, os.path.join(scratch, "metrics"),
                       lambda b: "2024-02-01 00:00:00", checkpoint=os.path.join(scratch, "ck2"))
    q.awaitTermination()
    reg = snapshots.read_latest(spark, reg_root, empty_registry(spark), "url")
    vec = snapshots.read_latest(spark, vec_root, empty_vectors(spark), "id")
    n = registry.count()
    assert reg.filter("status = 'completed'").count() == n
    assert vec.count() == n
    m = spark.read.parquet(os.path.join(scratch, "metrics")).first()
    assert m["completed"] == n and m["vector_synced"] == n
    problems = spark.read.parquet(os.path.join(scratch, "metrics-problems")).collect()
    assert [(r["url"], r["problem"]) for r in problems] == [("https://missing.example.com/", "Failed to find URL in database")]
    assert vec.filter("norm IS NULL OR f_nt IS NULL").count() == 0


def test_article_mode(spark, sf):
    from seekrank.operators.article import extract_article
    from seekrank.operators.ingest import extract_pages
    from seekrank.sources.tables import load
    pages = load(spark, sf, "pages")
    out = extract_pages(pages, mode="article").select("page_id", "url", "title", "text", "html").collect()
    assert len(out) == pages.count()
    for r in out:
        assert r["title"] and r["text"]
        assert "<nav" not in r["html"] and "<footer" not in r["html"] and "<h1>" in r["html"]
    # densest block, dropped script text, no main block at all
    t, x, h = extract_article("<html><head><title>T</title></head><body><nav>menu</nav><div><p>short</p></div>"
                              "<div><p>" + "long text " * 20 + "</p><script>x()</script></div></body></html>", "u")
    assert t == "T" and x == ("long text " * 20).strip() and "menu" not in x and "x()" not in x
    t, x, h = extract_article("<html><head></head><body><span>hi there</span><!-- c --></body></html>", "http://x")
    assert (t, x) == ("http://x", "hi there")


def test_process_batch_replay_gives_same_state(spark, sf, scratch):
    from seekrank.plans.fixtures import urls_fx
    from seekrank.sources.tables import load
    from seekrank.streaming.uploads import process_batch
    pages = load(spark, sf, "pages")
    reg_root, vec_root, met = (os.path.join(scratch, x) for x in ("reg", "vec", "met"))
    registry = urls_fx(spark, sf).withColumn("status", F.lit("pending"))
    snapshots.commit(spark, reg_root, registry, "url", -1, -1)
    batch = registry.select("url", "type")

    def state():
        reg = snapshots.read_latest(spark, reg_root, empty_registry(spark), "url")
        vec = snapshots.read_latest(spark, vec_root, empty_vectors(spark), "id")
        return (sorted(tuple(r) for r in reg.select("id", "status", "title", "updated_at").collect()),
                sorted((r["id"], tuple(r["vector"])) for r in vec.select("id", "vector").collect()))

    process_batch(spark, batch, 0, pages, reg_root, vec_root, met, "2024-02-01 00:00:00")
    first = state()
    process_batch(spark, batch, 0, pages, reg_root, vec_root, met, "2024-02-01 00:00:00")  # replay
    assert state() == first
    assert all(r[1] == "completed" for r in first[0])


def test_type_queued_last_wins(spark, scratch):
    from seekrank.streaming.uploads import process_batch
    pages = spark.createDataFrame([(1, "u", "<body>hello there</body>")], "page_id long, url string, html string")
    reg = upsert_urls(empty_registry(spark), spark.createDataFrame([(1, "zeta", "u")], "row_no long, type string, url string"), "2024-01-01 00:00:00")
    roots = [os.path.join(scratch, x) for x in ("reg", "vec", "met")]
    snapshots.commit(spark, roots[0], reg, "url", -1, -1)
    batch = spark.createDataFrame([("u", "zeta", 1), ("u", "alpha", 2)], "url string, type string, row_no long")
    process_batch(spark, batch, 0, pages, *roots, "2024-02-01 00:00:00")
    assert [r["type"] for r in snapshots.read_latest(spark, roots[1], empty_vectors(spark), "id").collect()] == ["alpha"]


def test_stream_needs_a_checkpoint_and_versions_only_grow(spark, scratch):
    with pytest.raises(ValueError):
        stream_uploads(spark, scratch, scratch + "/reg", lambda b: "2024-01-01 00:00:00")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    for v in (0, 1, 2):
        snapshots.commit(spark, scratch + "/t", rows.withColumn("v", F.lit(str(v))), "id", v, v)
    snapshots.commit(spark, scratch + "/t", rows.withColumn("v", F.lit("2b")), "id", 2, 2)  # a replay of the newest
    with pytest.raises(ValueError):
        snapshots.commit(spark, scratch + "/t", rows, "id", 0, 0)
    assert snapshots.read_latest(spark, scratch + "/t", rows.limit(0), "id").first()["v"] == "2b"


def test_changed_keys_and_compaction(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "COMPACT_EVERY", 3)
    want, root, empty = {}, scratch + "/t", spark.createDataFrame([], "id long, v string")
    for v in range(8):
        part = {k: f"{v}" for k in range(v, 12, v + 1)}
        want |= part
        snapshots.commit(spark, root, spark.createDataFrame(list(part.items()), "id long, v string"), "id", v, v)
        assert dict(map(tuple, snapshots.read_latest(spark, root, empty, "id").collect())) == want
    assert [f for _, f in snapshots.versions(spark, root)][0] and len(snapshots.versions(spark, root)) <= 3
    assert spark.read.parquet(root + "/data/_table_version=4").count() < 12  # changed keys only


def test_unreadable_manifest_is_an_error(spark, scratch):
    root = scratch + "/t"
    os.makedirs(root + "/_manifest")
    with open(root + "/_manifest/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        snapshots.read_latest(spark, root, spark.createDataFrame([], "id long"), "id").count()
    assert snapshots.read_latest(spark, scratch + "/none", spark.createDataFrame([], "id long"), "id").count() == 0


def test_files_with_different_headers(spark, scratch):
    d = scratch + "/in"
    os.makedirs(d)
    _write(d, "a.csv", "type,url\nblog,https://a/\n")
    _write(d, "b b.csv", "\n URL , Note,Type\nhttps://b/,x,news\n")
    rows = read_url_csv(spark, d).collect()
    assert sorted((r["type"], r["url"], r["columns_found"]) for r in rows) == [("blog", "https://a/", "type, url"), ("news", "https://b/", "URL, Note, Type")]


def test_payload_quoting_encoding_and_report(spark):
    import base64
    bad = base64.b64encode(b"type,url\nblog,https://x/\xff\n").decode()
    rows = [("quoted", encode_csv('type, url\nblog, "https://x/a,b"\n"news" ,https://y\n'), None), ("utf", bad, None), ("empty", encode_csv("type,url\n"), None),
            ("none", None, None), ("ragged", encode_csv("type,url\na,b,c\n"), None), ("open", encode_csv('type,url\na,"b\n'), None)]
    out = read_upload_payloads(spark.createDataFrame(rows, "upload_id string, csv_content string, file_name string"))
    valid = sorted((r["upload_id"], r["type"], r["url"]) for r in validate_url_rows(out.filter("error IS NULL")).collect())
    assert valid == [("quoted", "blog", "https://x/a,b"), ("quoted", "news", "https://y"), ("utf", "blog", "https://x/\ufffd")]
    rep = {r["upload_id"]: (r["row_count"], r["url_count"], r["error"]) for r in upload_report(out).collect()}
    assert rep["quoted"] == (2, 2, None) and rep["empty"] == (0, 0, "CSV file is empty or contains no data rows")
    assert rep["none"] == (0, 0, "csvContent is required") and "Record Length" in rep["ragged"][2] and rep["open"][2]


def test_one_row_per_url_in_lookup_and_results(spark):
    from seekrank.operators.ingest import apply_results, fetch_pages
    work = spark.createDataFrame([("u", "t")], "url string, type string")
    pages = spark.createDataFrame([(1, "u", "old"), (2, "u", "new"), (3, "u", None)], "page_id long, url string, html string")
    assert [r["html"] for r in fetch_pages(work, pages).collect()] == ["new"]
    reg = upsert_urls(empty_registry(spark), spark.createDataFrame([(1, "t", "u")], "row_no long, type string, url string"), "2024-01-01 00:00:00")
    res = spark.createDataFrame([("u", "T1", "p", "h", "x", "boom"), ("u", "T2", "p", "h", "x", None)], "url string, title string, preview string, html string, text string, error string")
    assert [(r["title"], r["status"]) for r in apply_results(reg, res, "2024-01-02 00:00:00").collect()] == [("T2", "completed")]


def test_basic_extraction_rules(spark):
    from seekrank.operators.ingest import extract_pages
    html = ["<HTML><HEAD><TITLE> A &amp; B\n</TITLE><style>x</style></HEAD><BODY class=a>Hi<!-- a > b --> <Script>var x='<p>'</Script>&lt;there&gt; &amp;amp; <b>you</b></BODY></HTML>",
            "<html><head><title></title></head><body>open", "no tags at all", "<head><title>T</title></head><p>x</p>"]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = [(r["title"], r["text"]) for r in extract_pages(df).orderBy("page_id").collect()]
    assert got == [("A & B", "Hi <there> &amp; you"), ("u1", "open"), ("u2", "no tags at all"), ("T", "x")]
