"""Edge rows of the ranking and snippet rules, with expectations worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seekrank.operators.ranking import dedup_urls, rank_pipeline, rescore
from seekrank.operators.snippets import add_best_paragraph, add_phrases

NOW = "2024-01-31 00:00:00"
SNIP = "x" * 120


def _cands(spark, rows, query="zzz", page=1, per_page=50, tft=None):
    schema = ("query_id long, id long, score double, url string, type string, title string, snippet string, "
              "updated_at timestamp_ntz")
    df = spark.createDataFrame(rows, schema)
    return (df.withColumn("query", F.lit(query)).withColumn("per_page", F.lit(per_page).cast("long"))
              .withColumn("page", F.lit(page).cast("long")).withColumn("type_filter_text", F.lit(tft).cast("string")))


def ts(h):
    return dt.datetime(2024, 1, 31) - dt.timedelta(hours=h)


@pytest.mark.parametrize("score,kept,expected", [
    (0.6499, False, None), (0.65, True, 0.65 * 0.88), (0.7499, True, 0.7499 * 0.88), (0.75, True, 0.75 * 0.98),
])
def test_no_text_gate_and_penalties(spark, score, kept, expected):
    rows = [(1, 1, score, "https://a.example.com/p", "en", "Alpha beta", SNIP, None)]
    out = rescore(_cands(spark, rows), NOW).collect()
    assert (len(out) == 1) == kept
    if kept:
        assert out[0]["score"] == pytest.approx(expected)


@pytest.mark.parametrize("score,kept", [(0.0, True), (0.5499, True), (0.55, True)])
def test_text_match_passes_at_any_score(spark, score, kept):
    rows = [(1, 1, score, "https://a.example.com/zzz", "en", "Alpha", SNIP, None)]
    assert (rescore(_cands(spark, rows), NOW).count() == 1) == kept


@pytest.mark.parametrize("hours,boost", [(-1, 0.2), (0, 0.2), (0.99, 0.2), (1, 0.2 * (1 - 1 / 24)),
                                         (12, 0.1), (24, 0.0), (72, 0.0)])
def test_recency_bands(spark, hours, boost):
    rows = [(1, 1, 0.9, "https://a.example.com/zzz", "en", "Alpha", SNIP, ts(hours))]
    r = rescore(_cands(spark, rows), NOW).first()
    assert r["recency_boost"] == pytest.approx(boost)


def test_generic_snippets_are_penalised(spark):
    rows = [(1, i, 0.9, f"https://a.example.com/{i}", "en", "Alpha beta", s, None)
            for i, s in enumerate(["wordpress site", "x" * 29, "x" * 99, "has <?php code" + "x" * 100, SNIP])]
    got = {r["id"]: r["score"] for r in rescore(_cands(spark, rows), NOW).collect()}
    assert got[4] == pytest.approx(0.9 * 0.98)
    for i in range(4):
        assert got[i] == pytest.approx(0.45)


def test_title_equal_to_bare_url_is_generic(spark):
    rows = [(1, 1, 0.9, "https://a.example.com/x/", "en", "a.example.com/x", SNIP, None)]
    assert rescore(_cands(spark, rows), NOW).first()["generic"]


def test_url_dedup_drops_one_trailing_slash_only(spark):
    rows = [(1, 1, 0.9, "https://a.example.com/zzz/", "en", "t", SNIP, None),
            (1, 2, 0.8, "HTTPS://A.EXAMPLE.COM/ZZZ", "en", "t", SNIP, None),
            (1, 3, 0.7, "https://a.example.com/zzz//", "en", "t", SNIP, None)]
    out = dedup_urls(rescore(_cands(spark, rows), NOW)).select("id").collect()
    assert sorted(r["id"] for r in out) == [1, 3]


def test_separator_only_query_matches_everything(spark):
    rows = [(1, i, 0.1, f"https://a.example.com/{i}", "en", "T", SNIP, None) for i in range(5)]
    out = rescore(_cands(spark, rows, query="---"), NOW)
    assert out.count() == 5 and all(r["text_m"] for r in out.collect())


def test_pages_are_disjoint_and_bounded(spark):
    rows = [(1, i, 0.5 + i / 1000, f"https://a.example.com/zzz{i}", "en", "T", SNIP, None) for i in range(30)]
    p1 = rank_pipeline(rescore(_cands(spark, rows, per_page=7, page=1), NOW)).collect()
    p2 = rank_pipeline(rescore(_cands(spark, rows, per_page=7, page=2), NOW)).collect()
    assert len(p1) == 7 and len(p2) == 7
    assert not ({r["id"] for r in p1} & {r["id"] for r in p2})
    scores = [r["score"] for r in sorted(p1, key=lambda r: r["rank"])]
    assert all(a >= b - 0.001 for a, b in zip(scores, scores[1:]))


# ----------------------------------------------------------------- T3–T5, expectations worked out by hand

LONG = "with that and the with " * 30
PARAGRAPHS = [
    # content, query, paragraph
    (None, "the", ""),
    ("", "the", ""),
    ("   \n  ", "the", ""),
    ("short\n\nlines\n\nonly", "the", "short\n\nlines\n\nonly"),  # nothing longer than 20: the text itself
    ("<p>Html text</p>\n\n<p>second block with the words</p>", "the", "Html text second block with the words"),
    ("a" * 20, "the", "a" * 20),
    ("b" * 21 + "\n\n" + "c" * 99, "the", "b" * 21),  # both 0: the first
    ("b" * 21 + "\n\n" + "c" * 100, "the", "c" * 100),  # 5 for its length
    ("b" * 501 + "\n\n" + "c" * 500, "the", "c" * 500),  # 2 against 5
    ("x " * 50 + "\n\n" + LONG, "the", LONG[:500].strip()),
    # 100 + 50 + 10 + 10 against the same and 5 for the prefix
    ("something with that inside it\n\nwith that comes first here", "with that", "with that comes first here"),
    # normalised match only (100) against one word (10) and the length (5)
    ("a well-known thing it is" + "\n\n" + "known " * 20, "well known", "a well-known thing it is"),
    ("first of two paragraphs\n\nsecond of two paragraphs", "---", "first of two paragraphs"),  # an empty normalised query is everywhere
    ("One two.  A sentence that is long\nenough.", "zzz", "One two.  A sentence that is long\nenough."),
    ("Yes. \n \n No!\n\nOh? Eh. \n\nA b c d e f g h i j. Z", "zzz", "A b c d e f g h i j. Z"),
]
PHRASES = [
    # text, query, phrases
    (None, "data", []),
    ("the the with with that that", None, []),
    ("a b c", None, []),
    ("The quick, brown fox's den", None, ["Quick Brown", "Brown Fox", "Fox Den", "Quick", "Brown"]),
    # data 3x3, science 3x3, "data science" 2x8, the other pairs 8 each; lab holds no query word
    ("data data science data science science lab", "data science", ["Data Science", "Data", "Science", "Data Data", "Science Data"]),
    ("data data science data science science lab", None, ["Data Science", "Data", "Science", "Data Data", "Science Data"]),
    ("alpha beta gamma", "beta", ["Alpha Beta", "Beta Gamma", "Beta"]),
    ("alpha beta gamma", "zzz", []),
    ("alpha beta gamma", "---", []),
    ("alpha the beta", None, ["Alpha", "Beta"]),
]


def test_best_paragraph_by_hand(spark):
    df = spark.createDataFrame([(i, c, q) for i, (c, q, _) in enumerate(PARAGRAPHS)], "i int, content string, query string")
    got = {r["i"]: r["para"] for r in add_best_paragraph(df, "content", "query", "para").collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(PARAGRAPHS)}


def test_phrases_by_hand(spark):
    for with_query in (True, False):
        rows = [(i, t, q) for i, (t, q, _) in enumerate(PHRASES) if (q is not None) == with_query]
        df = spark.createDataFrame(rows, "i int, content string, query string")
        got = {r["i"]: list(r["ph"]) for r in add_phrases(df, "content", "query" if with_query else None, "ph").collect()}
        assert got == {i: PHRASES[i][2] for i, _, _ in rows}


def test_phrases_of_a_long_text(spark):
    words = [f"word{i % 7000}" for i in range(60_000)] + ["needle haystack"] * 500
    df = spark.createDataFrame([(" ".join(words),)], "content string")
    assert add_phrases(df, "content", None, "ph").first()["ph"][:1] == ["Needle Haystack"]
