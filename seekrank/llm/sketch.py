"""Threshold-scaled sketches of word shingles; DataFrame functions only.

The sketch of a text is the set of its shingle hashes below a fixed fraction of
the hash range. Sketches of unequal texts stay comparable: the sketch of a union
is the union of the sketches, and shares of common hashes estimate Jaccard
likeness and containment. The least hash of all is kept beside them, as a name
for short texts none of whose hashes lies below the threshold; it takes no part
in estimates: a sketch that holds no hash says nothing about containment, and
``likeness`` and ``containment`` are null there. ``jaccard`` and ``share`` answer
from the texts' full hashes (``with_hashes``); the query makes them for those
rows only.

Words are runs between white space, lower-cased; a text of fewer words than a
shingle is one shingle; a text without words has the empty sketch. Likeness of
two texts without words is 1, of one without and another 0.

Rules for odd input: a null text is the empty text; the next document of equal
doc_ids goes by hash, then text; null doc_ids count as the smallest; a table of
one row is its own next; repeated rows appear each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.llm import common

WORDS = 5
#: One of so many hashes is kept.
SCALE = 8
_LOWEST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """Hashes of all runs of n words; of the whole sequence if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return (F.when(F.size(words) >= n, runs)
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>")))


class Sketch(NamedTuple):
    """The two columns of a sketch: ``kept``, the sorted distinct hashes below the threshold, and ``least`` of all hashes (null without words)."""

    kept: Column
    least: Column


def of(name: str) -> Sketch:
    """The sketch that ``with_sketch`` has added under this name."""
    return Sketch(F.col(name), F.col(f"{name}_least"))


def with_sketch(rows: DataFrame, text: str, name: str, n: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of the column ``text``: the columns ``name`` and ``name_least``."""
    top = F.lit(_LOWEST + (1 << 64) // scale).cast("long")
    all_hashes = F.col("__hashes")
    return (rows.withColumn("__words", words_of(F.col(text)))
            .withColumn("__hashes", shingle_hashes(F.col("__words"), n)).drop("__words")
            .withColumns({name: F.array_sort(F.array_distinct(F.filter(all_hashes, lambda h: h < top))), f"{name}_least": F.array_min(all_hashes)})
            .drop("__hashes"))


def with_hashes(rows: DataFrame, text: str, name: str, where: Column | None = None, n: int = WORDS) -> DataFrame:
    """Adds ``name``: all distinct hashes of the column ``text``, of the rows for which ``where`` holds (else none).

    The words are a column of their own, so that they are made once per row.
    """
    words = words_of(F.col(text))
    return (rows.withColumn("__words", words if where is None else F.when(where, words).otherwise(F.array().cast("array<string>")))
            .withColumn(name, F.array_distinct(shingle_hashes(F.col("__words"), n))).drop("__words"))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    return Sketch(F.array_sort(F.array_union(a.kept, b.kept)), F.least(a.least, b.least))


def _known(sketch: Sketch) -> Column:
    """Whether a sketch can be compared: it holds hashes, or its text has no words."""
    return (F.size(sketch.kept) > 0) | sketch.least.isNull()


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 of two empty ones."""
    common_n = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common_n.cast("double"), F.size(a) + F.size(b) - common_n), F.lit(1.0))


def share(a: Column, b: Column) -> Column:
    """Share of a's hashes that b holds; 1 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(1.0))


def likeness(a: Sketch, b: Sketch) -> Column:
    """Estimated Jaccard similarity of two sketches; null where one of them holds no hash though its text has words."""
    return F.when(_known(a) & _known(b), jaccard(a.kept, b.kept))


def containment(a: Sketch, b: Sketch) -> Column:
    """Estimated share of a's shingles that b holds; 1 for a text without words, null where a's sketch holds no hash."""
    return F.when(_known(a), share(a.kept, b.kept))


def written(sketch: Sketch) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash; the least hash after a dash for a text with words and no hash kept."""
    kept = F.array_join(F.transform(sketch.kept, F.hex), "")
    return F.when(_known(sketch), kept).otherwise(F.concat(F.lit("-"), F.lpad(F.hex(sketch.least), 16, "0")))


def _buckets(rows: DataFrame, n: int) -> Column:
    """A number that rises with the columns ``key`` and ``h``: about ``n`` values of about equal row counts.

    At most 256 bounds from approximate percentiles of the key, each range cut
    into equal widths. A key that several percentiles fall on is a range of its
    own, cut by ``h`` into as many parts as its rows are worth.
    """
    outer = min(n, 256)
    inner = -(-n // outer)
    found = rows.agg(F.percentile_approx("key", [i / outer for i in range(1, outer)], 10_000).alias("b"),
                     F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if found["lo"] is None:
        return F.lit(0).cast("long")
    times, top = Counter(found["b"] or []), (1 << 63) - 1
    hot = {v: n for v, n in times.items() if n > 1}
    edges = sorted({found["lo"], *times, *(min(v + 1, top) for v in hot), min(found["hi"] + 1, top)})
    bounds = F.array(*(F.lit(e).cast("long") for e in edges))
    cuts = F.array(*(F.lit(inner * hot.get(e, 1)) for e in edges))
    at = F.greatest(F.size(F.filter(bounds, lambda e: e <= F.col("key"))), F.lit(1))
    lo, hi = F.element_at(bounds, at).cast("double"), F.element_at(bounds, F.least(at + 1, F.lit(len(edges)))).cast("double")
    by_key = F.coalesce(F.try_divide(F.col("key").cast("double") - lo, hi - lo), F.lit(0.0))
    by_hash = F.col("h").cast("double") / float(1 << 64) + 0.5
    part = F.floor(F.when(F.element_at(bounds, at).isin(list(hot)), by_hash).otherwise(by_key) * F.element_at(cuts, at))
    return at.cast("long") * (inner * outer + 1) + F.greatest(F.lit(0), F.least(part, F.element_at(cuts, at) - 1))


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """Adds next_<column> for each carried column: its value in the next row by descending doc_id; the last row's next is the first.

    Rows are dealt into many ranges of doc_id, those of a frequent one into
    ranges of the text's hash. The first row of each range goes
    into the range above it as well (the first of all into the last range), so
    one shuffle and one window per range see every pair of neighbours.
    """
    keyed = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(_LOWEST).cast("long"))).withColumn("h", F.xxhash64("text"))
    bucket = _buckets(keyed.select("key"), 24 * common.partitions(rows.sparkSession))
    keyed = keyed.withColumn("bucket", bucket)
    heads = sorted((r["bucket"], r["m"]["key"], r["m"]["h"]) for r in
                   keyed.groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("m")).collect())  # one per range
    above = {b: heads[(i + 1) % len(heads)][0] for i, (b, _, _) in enumerate(heads)}
    extra = rows.sparkSession.createDataFrame([(b, k, h, above[b]) for b, k, h in heads], "bucket long, key long, h long, also long")
    dealt = (keyed.join(F.broadcast(extra), ["bucket", "key", "h"], "left")
             .withColumn("copy", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("last"))))
                                           .otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("last")),
                                                              F.struct(F.col("also").alias("b"), F.lit(True).alias("last"))))))
             .select("doc_id", "text", "key", "h", *(c for c in carried if c != "text"), "copy.b", "copy.last"))
    order = Window.partitionBy("b").orderBy("last", F.col("key").desc(), F.col("h").desc(), F.col("text").desc())
    # a range of one row whose own copy stands behind it needs no special case: its copy is its next
    return (dealt.select("*", F.lead(F.struct(*carried)).over(order).alias("next"))
            .filter(~F.col("last")).drop("key", "h", "b", "last"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's.

    Edited text: the last half of the code points (floor) replaced by the first as many, or all, of the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "sketch"), "text", "sketch", "sketch_least")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (rows.withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next.text", F.lit(1), half)))
            .select("doc_id", "n_chars", "text", "sketch", "sketch_least", F.col("next.text").alias("next_text"),
                    F.col("next.sketch").alias("next_sketch"), F.col("next.sketch_least").alias("next_sketch_least"), "edited"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    own, edited, following = (of(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    rows = rows.withColumns({"ask_edited": ~(_known(own) & _known(edited)), "ask_next": ~(_known(own) & _known(following))})
    rows = with_hashes(rows, "text", "all_own", F.col("ask_edited") | F.col("ask_next"))
    rows = with_hashes(rows, "edited", "all_edited", F.col("ask_edited"))
    rows = with_hashes(rows, "next_text", "all_next", F.col("ask_next"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(own).alias("fingerprint"), written(edited).alias("edited_fingerprint"),
        F.coalesce(likeness(own, edited), jaccard(F.col("all_own"), F.col("all_edited"))).alias("near_edited"),
        F.coalesce(likeness(own, following), jaccard(F.col("all_own"), F.col("all_next"))).alias("near_next"),
        F.coalesce(containment(own, edited), share(F.col("all_own"), F.col("all_edited"))).alias("share_in_edited"))
