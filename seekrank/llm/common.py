"""Helpers shared by the operators: staged tables in the shared folder and text to word ids."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekrank.session import checkpoint_dir

#: Text handled at once inside a task, in bytes; bounds the memory of a Python worker.
SLICE_BYTES = 6 << 20


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, what: str, batch: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``batch`` bounds the Arrow batches of this one write (``4m``), for rows that
    hold long lists or arrays; the session's own setting is put back.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = scratch(spark, what), spark.conf.get(key)
    if batch:
        spark.conf.set(key, batch)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts hold about ``limit`` bytes (one row at least, 4096 at most)."""
    for b in (whole.slice(lo, 4096) for whole in batches for lo in range(0, whole.num_rows, 4096)):
        size = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


BYTE_CHARS = _byte_chars()


class WordTable:
    """Ids of words met so far; ``encode`` (words -> flat ids, ids per word) sees each word once.

    The table is emptied when it holds ``max_words``; that changes the time, never the ids.
    """

    def __init__(self, encode, max_words: int = 1_000_000):
        self.encode, self.max_words = encode, max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def gather(self, words: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts given as ``counts`` words each, and the number of ids of each text."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        array = np.empty(len(words), object)
        array[:] = words
        codes, uniq = pd.factorize(array)
        if len(self.index) + len(uniq) > self.max_words:
            self._clear()
        new = [w for w in uniq if w not in self.index]
        if new:
            ids, lens = self.encode(new)
            self.index.update(zip(new, range(len(self.lens), len(self.lens) + len(new))))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens) - lens]
            self.lens = np.r_[self.lens, lens]
            self.flat = np.r_[self.flat, ids]
        at = np.fromiter((self.index[w] for w in uniq), np.int64, len(uniq))[codes]
        lens = self.lens[at]
        total = np.cumsum(lens)
        ends = np.r_[0, total][np.cumsum(counts)]
        return self.flat[spread(self.starts[at], lens)], np.diff(np.r_[0, ends])


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + len), one after the other."""
    total = np.cumsum(lens)
    return np.repeat(starts - (total - lens), lens) + np.arange(int(total[-1]) if len(total) else 0)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


# Kinds of bytes: white space, letters and digits, apostrophe, other ASCII punctuation, the rest.
_SPACE, _ALNUM, _QUOTE, _PUNCT, _REST = range(5)
_KIND = np.full(256, _REST, np.uint8)
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _PUNCT
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = _ALNUM
_KIND[list(b"'")] = _QUOTE
_KIND[list(b" \t\n\r\x0b\f")] = _SPACE
_PLAIN = np.where(_KIND == _SPACE, _SPACE, _REST).astype(np.uint8)
#: What a byte adds to the key of its word; ASCII capitals as small letters.
_BYTE_KEY = odd_numbers(256, 1)
_BYTE_KEY[65:91] = _BYTE_KEY[97:123]


class Words:
    """The words of many texts, as runs of one byte buffer, with 64-bit keys.

    Words end at ASCII white space and between ASCII or Latin-1 letters or digits
    and ASCII punctuation other than the apostrophe. The key of a word is the sum
    of byte numbers times place numbers, modulo 2**64; letter case (ASCII,
    Latin-1) doesn't count. Among a million words two share a key with a chance
    below one in a million. With ``plain``, words end at white space only and
    only ASCII case doesn't count.
    """

    def __init__(self, texts: list[bytes], plain: bool = False):
        self.raw = b"\n".join(texts)
        buf = np.frombuffer(self.raw, np.uint8)
        kind = _PLAIN[buf] if plain else _KIND[buf]
        two = np.flatnonzero(buf[:-1] == 0xC3) if not plain else np.zeros(0, np.int64)  # the Latin-1 letters are C3 80 to C3 BF, but for the two signs
        two = two[(buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = _ALNUM
        capital = two[(buf[two + 1] <= 0x9E)] + 1
        inside = kind != _SPACE
        ends = np.r_[True, ~inside, True]
        cut = np.flatnonzero((kind[:-1] == _ALNUM) & (kind[1:] == _PUNCT) | (kind[:-1] == _PUNCT) & (kind[1:] == _ALNUM)) + 1
        first, last = inside & ends[:-2], inside & ends[2:]
        first[cut] = True
        last[cut - 1] = True
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        total = np.cumsum(self.lens)
        begin = total - self.lens
        if capital.size:
            buf = buf.copy()
            buf[capital] += 0x20
        if len(total):
            place = np.arange(int(total[-1])) - np.repeat(begin, self.lens)
            self.keys = np.add.reduceat(_BYTE_KEY[buf[inside]] * odd_numbers(int(self.lens.max()), 2)[place], begin)
            letter = (kind == _ALNUM) & ~((buf >= 48) & (buf <= 57))
            self.letters = np.logical_and.reduceat(letter[inside], begin)
        else:
            self.keys, self.letters = np.zeros(0, np.uint64), np.zeros(0, bool)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))

    def text(self, i: int) -> str:
        return self.raw[self.starts[i]: self.starts[i] + self.lens[i]].decode()


class WordIds:
    """Token ids of whole texts, asking the tokenizers library once per distinct word.

    For tokenizers that drop white space, ignore case and split between letters
    and punctuation, and whose words end in ids marked ``</w>``. Texts that hold
    ``<|`` (a special token may stand there, and those are matched as written)
    are encoded whole. The table of words (sorted keys, about 32 bytes a word) is
    emptied when new ones would make it larger than ``max_words``; that changes
    the time, never the ids.
    """

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``which``, letters first: flat ids and ids per word."""
        n = int(words.letters[which].sum())
        texts = [words.text(i) for i in which]
        lines = self._ask([" ".join(texts[i:min(n, i + 2000)]) for i in range(0, n, 2000)])
        flat = np.concatenate([*lines, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != n or n and ends[-1] != len(flat):
            raise ValueError("this tokenizer does not mark the ends of words")
        rest = self._ask(texts[n:])
        return np.concatenate([flat, *rest]), np.r_[np.diff(np.r_[0, ends]), [len(r) for r in rest]].astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each (null: empty text)."""
        special = [i for i, t in enumerate(texts) if t and "<|" in t]
        words = Words([b"" if not t or "<|" in t else t.encode() for t in texts])
        codes, uniq = pd.factorize(words.keys)
        place = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        missing = self.keys[place] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if missing.any():
            if len(self.keys) + int(missing.sum()) > self.max_words:
                self._clear()
                missing[:] = True
            seen = np.empty(len(uniq), np.int64)
            seen[codes[::-1]] = np.arange(len(codes))[::-1]
            which = seen[missing]
            which = which[np.argsort(~words.letters[which], kind="stable")]
            ids, lens = self._new(words, which)
            keys = np.r_[self.keys, words.keys[which]]
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.r_[self.at, len(self.flat) + np.cumsum(lens) - lens][order]
            self.lens = np.r_[self.lens, lens.astype(np.int32)][order]
            self.flat = np.r_[self.flat, ids]
            place = np.searchsorted(self.keys, uniq)
        at = place[codes]
        lens = self.lens[at].astype(np.int64)
        ends = np.r_[0, np.cumsum(lens)][np.cumsum(words.counts)]
        flat, sizes = self.flat[spread(self.at[at], lens)], np.diff(np.r_[0, ends])
        if special:
            whole = self._ask([texts[i] for i in special])
            cuts = np.r_[0, ends[special]]
            flat = np.concatenate([x for a, b, w in zip(cuts[:-1], cuts[1:], whole) for x in (flat[a:b], w)] + [flat[cuts[-1]:]])
            sizes[special] = [len(w) for w in whole]
        return flat, sizes


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table per Python worker and tokenizer file."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def with_end(ids: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the id ``end`` after each run."""
    out = np.insert(ids, np.cumsum(lens), np.uint32(end)) if len(lens) else ids
    return out.astype(np.uint32, copy=False), lens + 1


class Marks:
    """A fixed-size set of 64-bit keys that may hold more than was put in, never less.

    ``BITS`` bits whatever the number of keys, as lines of ``WORDS`` 64-bit
    words: small enough to send to every task, as a filter in front of an exact
    join. Lines are made and tested by column functions; a key meets its line in
    an equi-join.
    """

    BITS, WORDS = 1 << 25, 16

    def __init__(self, keys: DataFrame):
        """``keys``: one long column."""
        line, word, mask = self._place(F.col(keys.columns[0]))
        parts = [F.coalesce(F.bit_or(F.when(F.col("__word") == k, F.col("__mask"))), F.lit(0).cast("long")) for k in range(self.WORDS)]
        rows = keys.select(line.alias("__line"), word.alias("__word"), mask.alias("__mask")).groupBy("__line").agg(F.array(*parts).alias("__marks"))
        self.lines = staged(rows, "marks")  # at most BITS / 64 / WORDS rows of WORDS numbers

    def _place(self, key: Column) -> tuple[Column, Column, Column]:
        """The line of a key, its word there and the bit in the word."""
        bit = F.pmod(F.xxhash64(key), F.lit(self.BITS).cast("long"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64).cast("long")).cast("int"))
        word = F.shiftright(bit, 6)
        return F.call_function("div", word, F.lit(self.WORDS).cast("long")), F.pmod(word, F.lit(self.WORDS).cast("long")).cast("int"), one

    def filter(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` whose long column ``key`` may be in the set.

        The exact join that follows must be an inner one (on distinct keys): Spark
        moves a semi join below this one, and then all of ``df`` is exchanged.
        """
        line, word, mask = self._place(F.col(key))
        found = F.get("__marks", word).bitwiseAND(mask) != 0
        return df.withColumn("__line", line).join(F.broadcast(self.lines), "__line").filter(F.col(key).isNotNull() & found).select(*df.columns)
