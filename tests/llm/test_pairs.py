"""op3, op4, op5: sketches, exact top-k and the n-gram join against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seekrank.llm import common, components, jaccard, sketch, topk
from tests.llm.conftest import ODD, prose
from tools.compare import canon


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketch_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in entry.queries()["op3_scaled_sketch"](spark, sf).collect()}
    order = sorted(texts, reverse=True)
    errors, prints = [], {}
    for d, follower in zip(order, order[1:] + order[:1]):
        t, half = texts[d], len(texts[d]) // 2
        edited = t[:len(t) - half] + texts[follower][:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = shingles(t, 5)
        errors.append(r["near_edited"] - similarity(own, shingles(edited, 5)))
        assert abs(r["near_next"] - similarity(own, shingles(texts[follower], 5))) < 0.35
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert abs(np.mean(errors)) < 0.05 and np.mean(np.abs(errors)) < 0.12


def test_sketch_odd_rows(odd, empty):
    rows = sketch.fingerprint_documents(odd).collect()
    assert len(rows) == len(ODD)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and 0 <= r["share_in_edited"] <= 1
        prints.setdefault(r["doc_id"], []).append(r)
    assert prints[0][0]["fingerprint"] == prints[1][0]["fingerprint"] == prints[2][0]["fingerprint"] == ""
    assert prints[5][0]["fingerprint"] == prints[6][0]["fingerprint"] == prints[7][0]["fingerprint"] != ""
    assert prints[3][0]["fingerprint"] and prints[0][0]["n_chars"] == 0
    assert sketch.fingerprint_documents(empty).count() == 0


def test_sketch_of_a_single_row(spark):
    r = sketch.fingerprint_documents(spark.createDataFrame([(1, prose(3, 40))], "doc_id long, text string")).first()
    t = prose(3, 40)
    assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - len(t) // 2] + t[:len(t) // 2]).encode()).hexdigest()
    assert r["near_next"] == 1.0


def test_next_of_a_frequent_id(spark):
    """An id of a third of the rows, and as many rows without one, are spread over ranges, and the chain of neighbours is kept."""
    ids = [None] * 300 + [7] * 300 + list(range(-150, 150))
    rows = [(d, prose(i, 3)) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("t", F.col("text"))
    got = sketch.with_next(df, "t").collect()
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]]))
    follows = {a: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert len(got) == len(rows) and all(r["next"]["t"] == follows[r["doc_id"], r["text"]] for r in got)
    keyed = df.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    sizes = [r["count"] for r in keyed.groupBy(sketch._buckets(keyed, 90)).count().collect()]
    assert max(sizes) < 60


def test_sketches_merge(spark):
    pairs = spark.createDataFrame([(prose(i, 4 + i % 30), prose(i + 50, 3 + i % 17)) for i in range(60)] + [("", ""), ("", "one"), (" ", None)], "a string, b string")
    pairs = pairs.withColumn("c", F.concat_ws(" ", "a", "b"))
    rows = sketch.with_sketch(sketch.with_sketch(pairs.fillna(""), "a", "sa", n=1), "b", "sb", n=1)
    rows = sketch.with_sketch(rows, "c", "sc", n=1).withColumn("m", F.struct(*sketch.merged(sketch.of("sa"), sketch.of("sb"))))
    assert rows.filter(~F.col("m").eqNullSafe(F.struct(*sketch.of("sc")))).count() == 0


def test_short_texts_inside_long_ones(spark):
    """Containment is an estimate or unknown, never a wrong 0; exact answers fill the gaps; fingerprints are recomputed."""
    rows = [(i, " ".join(prose(i, 300).split()[20:20 + k]), prose(i, 300)) for i, k in enumerate([5 + j % 30 for j in range(200)])]
    df = spark.createDataFrame(rows, "id long, short string, long string")
    df = sketch.with_sketch(sketch.with_sketch(df, "short", "a"), "long", "b")
    df = sketch.with_hashes(sketch.with_hashes(df, "short", "ha"), "long", "hb")
    got = df.select("id", sketch.containment(sketch.of("a"), sketch.of("b")).alias("c"), sketch.likeness(sketch.of("a"), sketch.of("b")).alias("j"), F.size("a").alias("n"), sketch.written(sketch.of("a")).alias("w"),
                    sketch.share(F.col("ha"), F.col("hb")).alias("ec"), sketch.jaccard(F.col("ha"), F.col("hb")).alias("ej"), F.col("a").alias("kept"),
                    F.col("b").alias("long_kept"), F.col("hb").alias("all")).collect()
    top = -(1 << 63) + (1 << 64) // sketch.SCALE
    for r, (_, short, long) in zip(sorted(got), rows):
        own, whole = shingles(short, 5), shingles(long, 5)
        assert (r["c"], r["j"] is None) == ((None, True) if r["n"] == 0 else (1.0, False)) and r["ec"] == 1.0
        assert r["ej"] == len(own) / len(whole) and r["w"] == ("".join(f"{h & (1 << 64) - 1:X}" if h < 0 else f"{h:X}" for h in r["kept"]) or r["w"])
        assert r["long_kept"] == sorted({h for h in r["all"] if h < top}) and len(set(r["all"])) == len(whole)
        assert r["w"].startswith("-") == (r["n"] == 0)
    assert 5 < sum(r["n"] == 0 for r in got) < 100


def test_topk_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert canon(entry.queries()["op4_pivot_topk"](spark, sf).toPandas()) == canon(con.sql(entry.oracle_sql()["op4_pivot_topk"]).df())


def brute_topk(rows, k, scale=256):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in rows if i % 2 == 0}):
        own = min(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def test_topk_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows += [(40, [1.0] * 6), (41, [1.0] * 6), (41, [1.0] * 6), (42, None), (43, [None] * 6), (44, [float("nan")] * 6), (45, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (46, []), (47, [1e12] * 6), (48, [-1e12] * 6), (50, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, raw int").repartition(3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, k=5).collect())
    assert got == brute_topk(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def brute_components(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((((d is None, d or 0), len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def rows_of(df):
    return sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_join_query(spark, sf, texts):
    assert rows_of(entry.queries()["op5_ngram_join"](spark, sf)) == brute_components(texts.items(), 3, 90, 100)


def near_copies(seed, count, words, most):
    """A text and copies of it with up to ``most`` words changed."""
    base = prose(seed, words).split()
    rng = np.random.default_rng(seed)
    out = []
    for c in range(count):
        w = list(base)
        for p in rng.choice(words, rng.integers(0, most + 1), replace=False):
            w[p] = f"new{seed}x{c}x{p}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_finds_every_link(spark, monkeypatch, n, num, den):
    """Groups of near copies around the threshold, small and large, in small blocks."""
    texts = near_copies(1, 40, 60, 4) + near_copies(2, 40, 200, 9) + near_copies(3, 20, 14, 2) + near_copies(4, 12, 700, 30)
    texts += [prose(9, k) for k in range(1, 40)] + ["x y", "x  Y", "x", "X", ""]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.join_components(df, n, num, den)) == brute_components(rows, n, num, den)


def test_join_lists_every_link(spark, monkeypatch):
    """Links inside a component too, by brute force over the distinct sets; copies by membership."""
    texts = near_copies(1, 30, 60, 4) + near_copies(2, 30, 200, 9) + near_copies(3, 15, 14, 2) + [prose(9, k) for k in range(1, 30)] + ["x y", "x  Y", ""]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(5000 + i, t) for i, t in enumerate(texts[:20])]
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    links, membership = jaccard.join_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80, 100)
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(shingles(t, 3)), []).append(d)
    empties = sets.pop(frozenset())
    least = [(min(ids), s) for s, ids in sets.items()]
    want = sorted(tuple(sorted((i, j))) for k, (i, s) in enumerate(least) for j, t in least[:k] if 100 * len(s & t) >= 80 * len(s | t))
    got = links.collect()
    assert sorted(tuple(sorted((r["a_doc_id"], r["b_doc_id"]))) for r in got) == want and len(want) > 2 * len(least)
    by = {}
    for r in membership.collect():
        by.setdefault(r["node"], []).append(r["doc_id"])
    assert by.pop(None) == empties and sorted(map(sorted, by.values())) == sorted(map(sorted, sets.values()))
    rep = {n: min(ids) for n, ids in by.items()}
    assert all((rep[r["a"]], rep[r["b"]]) == (r["a_doc_id"], r["b_doc_id"]) for r in got)


def test_rows_without_ids_link(spark, monkeypatch):
    """Texts that only rows without doc_id hold link like others, also as a bridge between others."""
    base = prose(20, 100).split()
    one = lambda k: base[:k] + [f"new{k}"] + base[k + 1:]
    bridge = [(1, " ".join(one(5))), (None, " ".join(base)), (None, " ".join(base)), (2, " ".join(one(50))), (None, " ".join(one(60)[:60] + one(90)[60:]))]
    texts = near_copies(5, 30, 80, 4) + near_copies(6, 20, 300, 12)
    rows = bridge + [(None if i % 3 else 10 + i, t) for i, t in enumerate(texts)] + [(None, t) for t in near_copies(7, 6, 50, 2)] + [(None, None), (None, "")]
    first, middle, last = (shingles(bridge[k][1], 3) for k in (0, 1, 3))
    measure = jaccard.Measure(3, 93, 100)
    assert [measure.links(len(x & y), len(x), len(y)) for x, y in ((first, middle), (middle, last), (first, last))] == [True, True, False]
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(jaccard.join_components(df, 3, 93, 100))
    assert got == brute_components(rows, 3, 93, 100)
    assert ((False, 2), 98, 1) in got and ((True, 0), 98, 1) in got
    sets = [frozenset(shingles(t, 3)) for _, t in rows]
    distinct = {s for s in sets if s}
    links = {s: sum(100 * len(s & t) >= 93 * len(s | t) for t in distinct) - 1 for s in distinct}
    counts = jaccard.join_counts(df, 3, 93, 100).collect()
    assert sorted((r["n_shingles"], r["n_links"]) for r in counts) == sorted((len(s), links.get(s, 0)) for s in sets)
    classes = {r["class_id"] for r in counts if r["class_id"]}
    assert None not in classes and len({c for _, n, c in got if n and c is not None}) <= len(classes) < len(distinct)


def test_join_odd_rows(odd, empty):
    got = jaccard.join_components(odd)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert sum(map(len, by.values())) == len(ODD)
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[4] == [(1, 4)]
    assert by[5] == by[6] == by[7] and by[5][0][1] == by[11][0][1] == 5
    assert by[9][0] == by[9][1] and len(by[None]) == 2
    assert jaccard.join_components(empty).count() == 0


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2)])
def test_pigeonhole_is_sound(num, den):
    """Linked random sets share a signature, whatever the allocation."""
    measure = jaccard.Measure(1, num, den)
    rng = np.random.default_rng(num)
    texts = []
    for size in list(range(1, 30)) + [50, 80, 120, 300]:
        words = [f"w{x}" for x in rng.choice(10_000, size, replace=False)]
        apart = measure.most_apart(2 * size)
        for _ in range(6):
            cut = int(rng.integers(0, apart // 2 + 1))
            texts += [" ".join(words), " ".join(words[cut:] + [f"v{x}" for x in rng.choice(10_000, apart // 2 - cut, replace=False)])]
    for rows in (1, 10 ** 4, 10 ** 9):
        sets = jaccard.Sets(texts, 1)
        edges = jaccard.band_edges(int(sets.size.max()))
        bands = [jaccard.allocate(measure, lo, hi - 1, rows) for lo, hi in zip(edges[:-1], edges[1:])]
        sig, of = jaccard.signatures(sets, bands, measure)
        by = [set(sig[of == i].tolist()) for i in range(len(texts))]
        for i in range(0, len(texts), 2):
            a, b = set(sets.row(i).tolist()), set(sets.row(i + 1).tolist())
            if measure.links(len(a & b), len(a), len(b)):
                assert by[i] & by[i + 1]
    assert any(b.deletions for b in bands)  # large tables index deletions


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(1, 99))
def test_most_apart(size, num):
    m = jaccard.Measure(1, num, 100)
    for other in range(size, size * 100 // num + 2):
        best = max((o for o in range(0, size + 1) if m.links(o, size, other)), default=None)
        if best is not None:
            low = min(o for o in range(0, size + 1) if m.links(o, size, other))
            assert size + other - 2 * low <= m.most_apart(size + other)
            assert size >= m.least_partner(other)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in edges], "a string, b string")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{f"{i:04}": "0000" for i in range(31)}, **{f"{i:04}": "0100" for i in range(100, 130)}, "0200": "0200", "0201": "0200"}


def test_marks_are_asked_before_rows_are_exchanged(spark, monkeypatch):
    """Spark would move a semi join below the join with the marks, and exchange every text and signature."""
    plans, staged = {}, common.staged
    monkeypatch.setattr(common, "staged", lambda df, what, batch=None: (plans.setdefault(what, df._jdf.queryExecution().optimizedPlan().toString()), staged(df, what, batch))[1])
    rows = [(i, prose(i // 2, 60) + (" end" if i % 2 else "")) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(12)}
    assert all("__marks" in plans[what] and "LeftSemi" not in plans[what] for what in ("members", "sets"))
