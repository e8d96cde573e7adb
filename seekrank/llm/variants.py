"""Spelling variant grouping: words one edit apart, found through Bloom filters.

Words are runs of Latin letters with their number of occurrences. Two are near
when one inserted, deleted or replaced letter turns one into the other. A word's
form is its near word with the most occurrences, if these are many times its
own; its root is the end of the chain of forms.

A task generates a word's edits as 64-bit hashes only: all deletions, and
replacements by greater letters (an insertion is a deletion seen from the other
word, a replacement by a smaller letter likewise, so every pair is met once).
The hash of a word is a sum over its places, so that an edit's hash is a few
additions. The hashes are probed in blocked Bloom filters, one shard per word
length and part, whose bits for one word lie in one 64-bit block. Only positive
edits are written out as strings and joined with the vocabulary, which removes
the false ones; so the result is exact.

Filters are broadcast a group of shards at a time, ``FILTER_BYTES`` at most:
a larger vocabulary takes more passes, never more memory.

Rules for odd input: a null text has no words; a null doc_id counts as the empty
string in the rule that varies words; repeated rows and equal doc_ids count each;
ties of forms go to the smallest word in code-point order; an empty table gives
an empty result; further columns are ignored. Whole texts and words of any
length are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekrank.llm import common

#: Different words that a counting task holds before it hands them on.
HELD = 500_000
#: Bits of a filter for one word, and bits set for it in its block.
WORD_BITS, SET_BITS = 24, 4
#: Bytes of filters that are broadcast at a time; one part of a shard takes no more.
FILTER_BYTES = 32 << 20
#: Edits whose hashes a task holds at a time.
EDITS = 1 << 20
#: Latin-1 bytes of texts as words see them: capitals A-Z small, letters as they are, the rest blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: What a letter adds to the hash of its word, times the number of its place.
_LETTER_KEY = common.odd_numbers(256, 5)


def occurrences(doc_id: int | None, text: str, vary: int, least_letters: int) -> Counter:
    """Words of ``text`` (Latin-1 bytes, so a byte is a letter) and how often they occur.

    With ``vary``, a run whose crc32 with the doc_id is divisible by it loses a
    letter. Other characters than Latin-1 end a run like any that is no letter.
    """
    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter = Counter()
    for run, n in runs.items():
        if len(run) >= least_letters:
            if vary:
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
                if h % vary == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < least_letters:
                        continue
            words[run] += n
    return words


def _count(vary: int, least_letters: int):
    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for lo in range(0, len(words), 50_000):
            part = words[lo:lo + 50_000]
            yield pa.record_batch({"word": pa.array([w.decode("latin-1") for w in part], pa.string()),
                                   "n": pa.array([held[w] for w in part], pa.int64())})
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in common.slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    held.update(occurrences(doc_id, text, vary, least_letters))
            if len(held) > HELD:
                yield from out(held)
        yield from out(held)
    return run


def vocabulary(docs: DataFrame, vary: int, least_letters: int, least_n: int) -> DataFrame:
    """Staged (word, n) of words that occur at least ``least_n`` times."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(vary, least_letters), "word string, n long")
    words = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)
    return common.staged(words, "vocabulary")


class Letters:
    """Hashes of words of one length, a row of Latin-1 letters each, and of their edits."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.count, self.length) = rows, rows.shape
        self.place = common.odd_numbers(self.length, 3)
        self.value = _LETTER_KEY[rows]
        self.hash = (self.value * self.place).sum(1)

    def deletions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, hash) of all deletions, one for each run of equal letters."""
        here = self.value * self.place
        left = np.cumsum(here, 1) - here
        moved = np.zeros_like(here)
        moved[:, 1:] = self.value[:, 1:] * self.place[:-1]
        right = moved.sum(1, keepdims=True) - np.cumsum(moved, 1)
        first = np.ones(self.rows.shape, bool)
        first[:, 1:] = self.rows[:, 1:] != self.rows[:, :-1]
        row, at = np.nonzero(first)
        return row, at, (left + right)[row, at]

    def replacements(self, at: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, letter, hash) of all replacements at place ``at`` by greater letters."""
        row, k = np.nonzero(letters[None, :] > self.rows[:, at, None])
        new = letters[k]
        return row, new, self.hash[row] + (_LETTER_KEY[new] - self.value[row, at]) * self.place[at]


def bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A well-mixed number for the block, and the word of bits set in it."""
    z = (h ^ (h >> np.uint64(33))) * _MIX
    z ^= z >> np.uint64(29)
    mask = np.zeros(len(z), np.uint64)
    for k in range(SET_BITS):
        mask |= np.uint64(1) << ((z >> np.uint64(6 * k)) & np.uint64(63))
    return z >> np.uint64(32), mask


def by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """Places of the words of each length, cut so that a group's letters fit in memory."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in groups.items():
        step = max(1, EDITS // (8 * n))
        for lo in range(0, len(places), step):
            yield n, places[lo:lo + step]


class Filters:
    """The shards of one pass: blocks of (length, part) at fixed places of one array of 64-bit words."""

    def __init__(self, shards: list[tuple[int, int, int, int]]):
        """``shards``: (length, part, parts, blocks)."""
        self.shards, at = {}, 0
        for length, part, parts, blocks in shards:
            self.shards.setdefault(length, []).append((part, parts, at, blocks))
            at += blocks
        self.size = at

    def place(self, length: int, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every shard of a length: (which hashes belong to it, their blocks, their bits)."""
        if length not in self.shards:
            return
        block, mask = bits(h)
        for part, parts, at, blocks in self.shards[length]:
            own = np.flatnonzero(block % np.uint64(parts) == part) if parts > 1 else np.arange(len(h))
            yield own, at + ((block[own] // np.uint64(parts)) % np.uint64(blocks)).astype(np.int64), mask[own]

    def built(self, words: DataFrame) -> np.ndarray:
        """The filter array; its words are made in tasks, at most FILTER_BYTES of them come back."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [w.encode("latin-1") for w in b.column("word").to_pylist()]
                for length, places in by_length(own):
                    h = Letters(np.frombuffer(b"".join(own[i] for i in places), np.uint8).reshape(-1, length)).hash
                    for which, at, mask in self.place(length, h):
                        yield pa.record_batch({"at": pa.array(at), "mask": pa.array(mask.view(np.int64))})
        rows = words.select("word").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = np.zeros(self.size, np.uint64)
        out[rows.column("at").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
        return out


def passes(sizes: list[tuple[int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Shards (length, part, parts, blocks) dealt to passes of at most FILTER_BYTES, from (length, words)."""
    most, out, room = FILTER_BYTES // 8, [], 0
    for length, n in sorted(sizes):
        blocks = -(-n * WORD_BITS // 64)
        parts = -(-blocks // most)
        for part in range(parts):
            own = -(-blocks // parts)
            if own > room:
                out.append([])
                room = most
            out[-1].append((length, part, parts, own))
            room -= own
    return out


def _probe(filters: Filters, shared, letters: np.ndarray):
    def hits(length: int, h: np.ndarray, array: np.ndarray) -> np.ndarray:
        good = np.zeros(len(h), bool)
        for which, at, mask in filters.place(length, h):
            good[which] = array[at] & mask == mask
        return np.flatnonzero(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = shared.value
        for b in batches:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            counts = b.column("n").to_numpy()
            out, of = [], []
            for length, places in by_length(words):
                group = Letters(np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(-1, length))
                if length - 1 in filters.shards:
                    row, at, h = group.deletions()
                    for i in hits(length - 1, h, array):
                        w, k = words[places[row[i]]], at[i]
                        out.append(w[:k] + w[k + 1:])
                        of.append(places[row[i]])
                if length in filters.shards:
                    for k in range(length):
                        row, new, h = group.replacements(k, letters)
                        for i in hits(length, h, array):
                            w = words[places[row[i]]]
                            out.append(w[:k] + bytes((new[i],)) + w[k + 1:])
                            of.append(places[row[i]])
                if len(out) > 100_000:
                    yield rows(out, of, words, counts)
                    out, of = [], []
            if out:
                yield rows(out, of, words, counts)

    def rows(out: list[bytes], of: list[int], words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in out], pa.string()),
                                "other": pa.array([words[i].decode("latin-1") for i in of], pa.string()), "other_n": pa.array(counts[of])})
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """Staged (word, n, other, other_n): every unordered pair of near words once."""
    spark = words.sparkSession
    sizes = [tuple(r) for r in words.groupBy(F.length("word")).count().collect()]  # one row per word length
    seen = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # letters, at most 90
    letters = np.array(sorted(ord(r["c"]) for r in seen if r["c"]), np.uint8)
    pairs = words.limit(0).select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    for k, shards in enumerate(passes(sizes)):
        filters = Filters(shards)
        lengths = sorted(filters.shards)
        own = words.filter(F.length("word").isin(lengths))
        probed = words.filter(F.length("word").isin(sorted({*lengths, *(n + 1 for n in lengths)})))
        shared = spark.sparkContext.broadcast(filters.built(own))
        found = probed.mapInArrow(_probe(filters, shared, letters), "word string, other string, other_n long")
        found = common.staged(found.join(own, "word").select("word", "n", "other", "other_n"), f"near-{k}")
        shared.destroy()
        pairs = pairs.unionByName(found)
    return pairs


def group_variants(docs: DataFrame, vary: int = 0, least_letters: int = 7, least_n: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    A form needs ``times`` the occurrences, so chains are at most as long as the
    logarithm of the largest count, and doubling ends after a few rounds.
    """
    words = vocabulary(docs, vary, least_letters, least_n)
    pairs = near_pairs(words)
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(near, "word", "left")
    is_form = -F.col("best.least") >= times * F.col("n")
    rows = common.staged(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n")), "forms")
    ends = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round halves what is left of each chain
        step = ends.alias("a").join(ends.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = common.staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))),
run AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
        WHERE len(run) >= 7 GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(k))),
      lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM run, tab),
word AS (SELECT word, sum(n)::BIGINT AS n FROM (
           SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed)
         GROUP BY 1 HAVING len(word) >= 7 AND sum(n) >= 2),
place AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM word)),
shorter AS (SELECT DISTINCT p.word, p.n, o.word AS other, o.n AS other_n FROM place p JOIN word o ON o.word = p.a || p.z),
near AS (SELECT * FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
         UNION ALL SELECT p.word, p.n, o.word, o.n FROM place p JOIN place o ON p.a || '*' || p.z = o.a || '*' || o.z AND p.word <> o.word),
best AS (SELECT word, n, count(*) AS n_near, min((-other_n, other)) AS b FROM near GROUP BY 1, 2),
form AS (SELECT word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * word.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * word.n THEN -b[1] END AS form_n
         FROM word LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM form UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, max_by(root, k) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM form JOIN last USING (word)
"""
