"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

Every group (lang, source) and every language gives each kept term a smoothed
share of its occurrences, in whole billionths. Two groups differ by the sum over
all kept terms of (p - q)^2 / (p + q); a group's own terms are those it uses
more than its language does.

Terms are counted inside tasks, summed once by (lang, term), numbered densely
and cut into blocks of ``BLOCK`` numbers. A group's share of a block is a pair
of sorted arrays (term ids, counts). For every unordered pair of groups and
block the two pairs of arrays are co-grouped by an equi-join and merged
sparsely: a galloping intersection prices the terms of both, what is left of
either side is priced against the other's zero share, and the terms of neither
are one number times their count. So no task holds more than a block of a
group, and a hot source is many blocks. Sources are dealt to tiles; pairs of
tiles spread the pairs of one language over tasks.

Rules for odd input: a null text, lang or source is ''; groups without terms
take part (their shares are equal ones); a language without kept terms has
distance 0 between its sources and no terms; a language with one source has no
pairs; repeated rows and equal doc_ids count each; an empty table gives an empty
result; further columns are ignored. Equal values rank by the item's UTF-8
order. Whole texts are read, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.llm import common

#: Shares are whole numbers of this many parts.
SCALE = 1_000_000_000
#: Terms of one block; at most 2 ** 16.
BLOCK = 8192
#: Sources that one tile holds, about.
TILE = 16
#: Different terms that a counting task holds before it hands them on.
HELD = 300_000
#: Bytes of texts as terms see them: capitals small, ASCII other than letters blank, the rest as it is.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_NUMBERED = "lang string, source string, term string, n long, lang_n long, part int, place long"


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            for lo in range(0, len(words), 50_000):
                part = words[lo:lo + 50_000]
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()),
                    "term": pa.array(part, pa.binary()).cast(pa.string()), "n": pa.array([n[w] for w in part], pa.int64()),
                    "docs": pa.array([docs[w] for w in part], pa.int64())})
        held.clear()

    for b in common.slices(batches):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            own = terms(text)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(own)
            docs.update(set(own))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of every (lang, term) among those of this task; rows come sorted by both."""
    part, place, before = TaskContext.get().partitionId(), -1, None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, bool)
        for k, c in enumerate(("lang", "term")):
            col = b.column(c)
            other = pc.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = other if k == 0 else new[1:] | other
        new[0] = before != (b.column("lang")[0].as_py(), b.column("term")[0].as_py())
        places = place + np.cumsum(new)
        place, before = int(places[-1]), (b.column("lang")[-1].as_py(), b.column("term")[-1].as_py())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(places)],
                                         [*b.schema.names, "part", "place"])


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """Staged (lang, source, term, n, lang_n, block, tid) of terms in at least ``least`` documents of their language.

    One shuffle by (lang, term) of counts that the tasks have summed; document
    counts, the language's counts and the numbers all come from that one pass.
    """
    spark = docs.sparkSession
    counts = docs.mapInArrow(_count, _COUNTS).repartition(common.partitions(spark), "lang", "term")
    sums = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    rows = (sums.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
            .filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")
            .sortWithinPartitions("lang", "term"))
    rows = common.staged(rows.mapInArrow(_number, _NUMBERED), "terms")
    lasts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.max("place") + 1).collect())  # one row per partition
    starts = np.cumsum([0, *(n for _, n in lasts)])
    first = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(lasts, starts)], "part int, first long")
    number = F.col("first") + F.col("place")
    return rows.join(F.broadcast(first), "part").select(
        "lang", "source", "term", "n", "lang_n", F.expr(f"(first + place) div {BLOCK}").alias("block"), (number % BLOCK).cast("int").alias("tid"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids and counts of every (lang, source, block); rows come sorted by all of these and tid."""
    key, ids, counts = None, [], []

    def row():
        return pa.record_batch({
            "lang": pa.array([key[0]], pa.string()), "source": pa.array([key[1]], pa.string()), "block": pa.array([key[2]], pa.int64()),
            "ids": pa.array([np.concatenate(ids).astype("<u2").tobytes()], pa.binary()),
            "counts": pa.array([np.concatenate(counts).astype("<i8").tobytes()], pa.binary())})
    for b in batches:
        if not b.num_rows:
            continue
        names = [b.column(c) for c in ("lang", "source", "block")]
        other = np.zeros(b.num_rows, bool)
        for c in names:
            other[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(other)
        tid, n = b.column("tid").to_numpy(), b.column("n").to_numpy()
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            at = tuple(c[int(lo)].as_py() for c in names)
            if key is not None and at != key:
                yield row()
                ids, counts = [], []
            key = at
            ids.append(tid[lo:hi])
            counts.append(n[lo:hi])
    if key is not None:
        yield row()


def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), digit by digit in base 1000 so that nothing overflows."""
    left, out = np.asarray(count, np.int64) + 2, 0
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return 1 + out


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def gallop(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """First place in the sorted ``among`` not below each of the sorted ``keys``.

    Every 64th key is found by bisection; from there the keys in between take
    doubling steps until they are passed, and bisect inside the last step.
    """
    if not len(keys) or not len(among):
        return np.zeros(len(keys), np.int64)
    low = np.repeat(np.searchsorted(among, keys[::64]), 64)[:len(keys)].astype(np.int64)
    end, step = len(among), 1
    high = low.copy()
    behind = np.flatnonzero((high < end) & (among[np.minimum(high, end - 1)] < keys))
    while behind.size:
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(end, high[behind] + step)
        step *= 2
        behind = behind[(high[behind] < end) & (among[np.minimum(high[behind], end - 1)] < keys[behind])]
    open_ = np.flatnonzero(low < high)
    while open_.size:
        mid = (low[open_] + high[open_]) // 2
        less = among[mid] < keys[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def merged(ids_a: np.ndarray, n_a: np.ndarray, whole_a: int, ids_b: np.ndarray, n_b: np.ndarray, whole_b: int, n_terms: int) -> int:
    """Sum of differences over ``n_terms`` terms, of which the arrays name those that occur."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, whole_a, ids_b, n_b, whole_b = ids_b, n_b, whole_b, ids_a, n_a, whole_a
    p, q = share(n_a, whole_a), share(n_b, whole_b)
    none_p, none_q = share(0, whole_a), share(0, whole_b)
    at = gallop(ids_a, ids_b)
    both = at < len(ids_b)
    both[both] = ids_b[at[both]] == ids_a[both]
    alone = np.ones(len(ids_b), bool)
    alone[at[both]] = False
    absent = n_terms - len(ids_a) - len(ids_b) + int(both.sum())
    return int(difference(p[both], q[at[both]]).sum() + difference(p[~both], none_q).sum()
               + difference(none_p, q[alone]).sum() + absent * difference(none_p, none_q))


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids_a, n_a, ids_b, n_b = ([np.frombuffer(x or b"", t) for x in b.column(c).to_pylist()]
                                  for c, t in (("ids", "<u2"), ("counts", "<i8"), ("other_ids", "<u2"), ("other_counts", "<i8")))
        whole_a, whole_b, n_terms = (b.column(c).to_pylist() for c in ("whole", "other_whole", "terms"))
        value = [merged(*x) if x[-1] else 0 for x in zip(ids_a, n_a, whole_a, ids_b, n_b, whole_b, n_terms)]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("source"), b.column("other"), pa.array(value, pa.int64())],
                                         ["lang", "source", "other", "value"])


def pair_tasks(groups: DataFrame, blocks: DataFrame, arrays: DataFrame) -> DataFrame:
    """lang, source, other, value of every unordered pair of a language's sources (source < other).

    ``groups``: lang, source, whole, tile, tiles; ``blocks``: lang, block, terms;
    ``arrays``: lang, source, block, ids, counts.
    """
    rows = groups.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left")
    rows = rows.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"lo": F.least("tile", "u"), "hi": F.greatest("tile", "u")}).drop("u", "tiles")
    other = rows.select("lang", "block", "lo", "hi", F.col("source").alias("other"), F.col("whole").alias("other_whole"),
                        F.col("tile").alias("other_tile"), F.col("ids").alias("other_ids"), F.col("counts").alias("other_counts"))
    pairs = (rows.join(other, ["lang", "block", "lo", "hi"])
             .filter((F.col("source") < F.col("other")) & ((F.col("lo") == F.col("hi")) | (F.col("tile") != F.col("other_tile"))))
             .select("lang", "source", "other", "whole", "other_whole", "terms", "ids", "counts", "other_ids", "other_counts"))
    return (pairs.mapInArrow(_price, "lang string, source string, other string, value long")
            .groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))


def _share(count: Column, whole: Column) -> Column:
    """``share`` as an expression: whole division of decimals, so that nothing overflows or rounds."""
    product = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", product, whole.cast("decimal(19,0)")) + 1


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and each group's own terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_terms(docs, least)
    langs = kept.groupBy("lang", "block").agg(F.count_distinct("tid").alias("terms"), F.sum("n").alias("n"))
    langs = common.staged(langs, "blocks")
    names = docs.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    whole = langs.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("n").alias("lang_n"))
    zero = F.lit(0).cast("long")
    v, tiles = F.coalesce("v", zero), F.ceil(F.col("sources") / TILE).cast("int")
    groups = common.staged(
        names.join(sums, ["lang", "source"], "left").join(sizes, "lang").join(whole, "lang", "left").select(
            "lang", "source", (F.coalesce("n", zero) + 2 * v).alias("whole"), (F.coalesce("lang_n", zero) + 2 * v).alias("lang_whole"),
            tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile")), "groups")
    blocks = langs.select("lang", "block", "terms").unionByName(
        groups.select("lang", F.lit(-1).cast("long").alias("block"), zero.alias("terms")).distinct())  # so that every pair meets once at least
    rows = kept.select("lang", "source", "block", "tid", "n").repartition(common.partitions(docs.sparkSession), "lang", "source", "block")
    arrays = common.staged(rows.sortWithinPartitions("lang", "source", "block", "tid")
                           .mapInArrow(_arrays, "lang string, source string, block long, ids binary, counts binary"), "arrays", batch="8m")
    pairs = pair_tasks(groups.drop("lang_whole"), blocks, arrays)
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    apart = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    own = (kept.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
           .withColumns({"p": _share(F.col("n"), F.col("whole")), "q": _share(F.col("lang_n"), F.col("lang_whole"))})
           .filter("n > 0 and p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    first = own.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return apart.withColumn("rank", F.row_number().over(by)).unionByName(first)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, v, coalesce(n, 0) + 2 * v AS whole, lang_n + 2 * v AS lang_whole
      FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM n GROUP BY 1, 2) USING (lang, source)
      LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_n FROM kept GROUP BY 1) USING (lang)),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
                1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // whole AS p, 1 + 1000000000::HUGEINT * (kept.lang_n + 2) // lang_whole AS q
         FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(apart.value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN apart ON apart.lang = x.lang AND apart.source = x.source AND apart.item = y.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM cell WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
WHERE part = 'pair' OR rank <= 10
"""
