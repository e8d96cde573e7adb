"""Byte-level BPE by batched numpy merge rounds.

The words of many texts are merged together: all symbols stand in one flat
array; each round looks up every adjacent pair by binary search in the sorted
pair keys, finds the lowest rank of each word, and joins that pair everywhere
in the word (left to right, without overlaps). Words without a known pair leave
the array. Decoding gathers the bytes of all ids from one flat byte table.

Rules for odd input: null counts as the empty text (no ids, decoded empty);
special tokens are matched as written, before anything else; ids beyond the
vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD; further
columns are ignored. Texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekrank.llm import common

#: The word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """Vocabulary, sorted pair keys and byte table from a tokenizer file (vocab, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = np.int64(max([*vocab.values(), *added.values()]) + 1)
        self.base = np.array([vocab[c] for c in common.BYTE_CHARS], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.ranks = order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        byte = {c: b for b, c in enumerate(common.BYTE_CHARS)}
        pieces = [b""] * int(self.size)
        for t, i in vocab.items():
            pieces[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        for t, i in added.items():
            pieces[i] = t.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = regex.compile(PATTERN)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.table = common.WordTable(self.merge)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (special tokens stand as ``(token,)``): flat ids and ids per word."""
        raw = [b"" if isinstance(w, tuple) else w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], self.size), self.size)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(low < self.size, sizes)
            hit = live & (rank == np.repeat(low, sizes))
            # in a run of hits (one symbol repeated) every other one joins
            idx = np.flatnonzero(hit)
            first = np.r_[True, (np.diff(idx) > 1) | (word[idx[1:]] != word[idx[:-1]])] if len(idx) else np.zeros(0, bool)
            in_run = np.arange(len(idx)) - np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))
            idx = idx[in_run % 2 == 0]
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym[idx] = self.joined[at[idx]]
            live[idx + 1] = False
            sym, word = sym[live], word[live]
        for i, w in enumerate(words):
            if isinstance(w, tuple):
                done_sym.append(np.array([self.added[w[0]]]))
                done_word.append(np.array([i]))
        if not done_sym:
            return np.zeros(0, np.uint32), lens
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")  # the symbols of a word leave in one round
        return np.concatenate(done_sym)[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _split(self, text: str) -> list:
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out = []
        for k, piece in enumerate(self.special.split(text)):
            out += [(piece,)] if k % 2 else self.words.findall(piece)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per text."""
        words: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = self._split(t)
                counts[i] = len(own)
                words += own
        return self.table.gather(words, counts)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of the id runs."""
        inside = ids < self.size
        ids_in = np.where(inside, ids, 0).astype(np.int64)
        sizes = np.where(inside, self.piece_len[ids_in], 0)
        raw = self.piece_bytes[common.spread(self.piece_at[ids_in], sizes)].tobytes()
        cuts = np.r_[0, np.r_[0, np.cumsum(sizes)][np.cumsum(lens)]]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One table per Python worker and tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int> of every text; a map over the input, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in common.slices(batches):
            ids, lens = bpe.encode(b.column("text").to_pylist())
            offsets = pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of every id array (null: empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            rows = [np.array(x or [], np.int64) for x in b.column("ids").to_pylist()]
            texts = bpe.decode(np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(x) for x in rows], np.int64))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in common.slices(batches):
            ids, lens = bpe.encode(b.column("text").to_pylist())
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(lens)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "n_tokens": pa.array(lens),
                "ids_sha256": [hashlib.sha256(raw[e - 4 * n: e]).hexdigest() for e, n in zip(ends, lens)],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, lens)]})
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
