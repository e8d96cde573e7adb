"""op1, op2, op10: token files, packing and the BPE codec against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from seekrank.llm import bpe, common, packing, token_files
from tests.llm.conftest import ODD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


def ids_of(tokenizer, text, *end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + list(end)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZ é́ßÀ!.,≠ \t\n\x0b\x1c1½İΣ|< 日"), max_size=40), max_size=6))
def test_word_ids_and_bpe_equal_the_library(texts):
    for made, path in ((common.word_ids(WORD), WORD), (bpe.load(BYTE), BYTE)):
        tokenizer = Tokenizer.from_file(path) if path not in CACHE else CACHE[path]
        CACHE[path] = tokenizer
        ids, lens = made.encode(texts)
        cuts = np.r_[0, np.cumsum(lens)]
        for i, t in enumerate(texts):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == ids_of(tokenizer, t)


CACHE = {}


def test_word_table_may_be_emptied(library):
    small = common.WordIds(WORD, max_words=3)
    for t in ("a b c d", "d c b a", "e f"):
        assert small.encode([t])[0].tolist() == ids_of(library[0], t)


def test_token_files_query(spark, sf, texts, library):
    got = sorted(tuple(r) for r in entry.queries()["op1_token_files"](spark, sf).collect())
    want, start = [], 0
    for d in sorted(texts):
        ids = ids_of(library[0], texts[d], 2)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_odd_rows(spark, odd, empty, library, scratch):
    token_files.write_token_files(odd, f"{scratch}/odd", WORD)
    rows = sorted((tuple(r) for r in token_files.read_token_files(spark, f"{scratch}/odd").collect()), key=lambda r: r[1])
    assert [r[0] is not None for r in rows] == sorted(r[0] is not None for r in rows)  # null ids first
    ids = [r[0] for r in rows if r[0] is not None]
    assert ids == sorted(ids)
    assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()
    want = sorted((d is not None, d or 0, len(i), crc(i)) for d, t in ODD for i in [ids_of(library[0], t, 2)])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in rows) == want
    token_files.write_token_files(empty, f"{scratch}/empty", WORD)
    assert token_files.read_token_files(spark, f"{scratch}/empty").count() == 0


def test_documents_longer_than_a_block(spark, scratch, library):
    text = "ab cd " * 50_000
    rows = spark.createDataFrame([(1, "x"), (2, text), (3, None)], "doc_id long, text string")
    token_files.write_token_files(rows, scratch + "/long", WORD)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, scratch + "/long").collect())
    ids = ids_of(library[0], text, 2)
    assert len(ids) > token_files.BLOCK
    assert got[1] == (2, got[0][2], len(ids), crc(ids))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000), st.integers(0, 3))
def test_blocks_round_trip(values, repeat):
    ids = np.array(values * (1 + 9 * repeat), np.uint32)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    model = token_files.Model(used, token_files.scale_counts(counts[used]))
    assert int(model.freq[:-1].sum()) == 1 << token_files.PROB_BITS
    payloads = model.encode([ids, ids[:1]])
    back = model.decode(payloads)
    assert (back[0] == ids).all() and (back[1] == ids[:1]).all()
    broken = bytearray(payloads[0])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        model.decode([bytes(broken)])


def test_crc32_of_joined_strings():
    a, b = b"some bytes" * 9, b"others" * 1000
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_ranges_of_doc_ids(spark):
    """Ranges follow doc_id, hot ids (one, and none) are spread, and no row is lost."""
    ids = [None] * 4000 + [7] * 4000 + list(range(-2000, 2000))
    docs = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows = token_files.by_doc_id(docs, 12).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(int(r["text"]) for r in rows) == list(range(len(ids)))
    parts = {}
    for r in rows:
        parts.setdefault(r["p"], []).append(-1e9 if r["doc_id"] is None else r["doc_id"])
    assert all(own == sorted(own) for own in parts.values()) and len(parts) == 12 and max(map(len, parts.values())) < 3 * len(ids) / 12
    assert all(max(parts[p]) <= min(parts[p + 1]) for p in range(11))
    assert token_files.by_doc_id(docs.limit(0), 12).count() == 0 and token_files.by_doc_id(docs, 1).count() == len(ids)


def check_packing(rows, want, capacity):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces(rows, tokenizer, capacity):
    return [(d is None, d or 0, p, s, len(i[s:s + capacity]), crc(i[s:s + capacity]))
            for d, t in rows for i in [ids_of(tokenizer, t, 0)] for p, s in enumerate(range(0, len(i), capacity))]


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_packing_query(spark, sf, texts, library):
    rows = entry.queries()["op2_best_fit_packing"](spark, sf).collect()
    want = pieces(texts.items(), library[0], 2048)
    n = check_packing(rows, want, 2048)
    assert n <= best_fit([w[4] for w in want], 2048) * 1.01 + 1


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_odd_rows(odd, empty, library, capacity):
    rows = packing.pack_documents(odd, WORD, capacity=capacity, keep_ids=True).collect()
    want = pieces(ODD, library[0], capacity)
    n = check_packing(rows, want, capacity)
    assert n <= best_fit([w[4] for w in want], capacity) + 2
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(empty, WORD, capacity=capacity).count() == 0


@pytest.mark.parametrize("range_rows", [100, 200_000])
@pytest.mark.parametrize("lengths", [[600] * 500, [300] * 500, [257] * 500, [129] * 500, [1] * 5000,
                                     [513 + 37 * i % 512 for i in range(800)], [1 + 7 * i % 16 for i in range(3000)]],
                         ids=["600", "300", "257", "129", "1", "513-1024", "1-16"])
def test_lengths_of_one_class(spark, monkeypatch, lengths, range_rows):
    """Lengths that gather in one class need no more sequences than best fit, in few ranges or many."""
    monkeypatch.setattr(packing, "RANGE_ROWS", range_rows)
    table = spark.createDataFrame([(i, i, 0, n) for i, n in enumerate(lengths)], "rid long, doc_id long, piece int, length long")
    rows = packing.pack(common.staged(table, "test-pieces")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    for own in by.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    least = best_fit(lengths, 2048)
    assert len(by) <= (least if len(set(lengths)) == 1 else least * 1.01 + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.lists(st.integers(1, 9), max_size=12), st.integers(1, 4))
def test_sweep_in_ranges_is_one_sweep(slots, items, cut):
    """Matching range by range and then by the ranges' counts gives every item its best free slot, as one sweep does."""
    rows = sorted([(-s, 0, i) for i, s in enumerate(slots)] + [(-s, 1, i) for i, s in enumerate(items)])
    sizes, kinds = np.array([-r[0] for r in rows], np.int64), np.array([r[1] == 1 for r in rows], bool)
    taken, given_, alone, _ = packing.match_range(sizes, kinds)
    whole = dict(zip(taken.tolist(), given_.tolist()))
    bounds = [len(rows) * k // cut for k in range(cut + 1)]
    found, counts, left_items, left_slots = {}, [], {}, {}
    for p, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        t, g, i, s = packing.match_range(sizes[lo:hi], kinds[lo:hi])
        found.update(zip((t + lo).tolist(), (g + lo).tolist()))
        left_items[p], left_slots[p] = i + lo, s + lo
        counts.append((p, len(i), len(s)))
    for p, lo, hi, q, first in packing.meet(counts):
        for k in range(lo, hi):
            found[int(left_items[p][k])] = int(left_slots[q][first + k - lo])
    assert found == whole
    assert all(sizes[s] >= sizes[i] for i, s in found.items()) and len(set(found.values())) == len(found)


def test_bpe_query(spark, sf, texts, library):
    got = {r["doc_id"]: tuple(r) for r in entry.queries()["op10_bpe_codec"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = ids_of(library[1], t)
        back = library[1].decode(ids, skip_special_tokens=False)
        assert got[d] == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_odd_rows(odd, empty, library):
    encoded = bpe.encode_documents(odd, BYTE)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in encoded.collect())
    assert got == sorted((d is None, d or 0, ids_of(library[1], t)) for d, t in ODD)
    back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in bpe.decode_documents(encoded, BYTE).collect())
    assert back == sorted((d is None, d or 0, t or "") for d, t in ODD)
    assert bpe.round_trip_digests(empty, BYTE).count() == bpe.encode_documents(empty, BYTE).count() == 0
    assert bpe.load(BYTE).decode(np.array([10 ** 6, 220, 162]), np.array([2, 1, 0])) == [" ", "�", ""]


def test_known_words_are_not_asked_again(monkeypatch):
    """A text whose words are all known doesn't empty the table, and new words do only where they don't fit."""
    table = common.WordIds(WORD, max_words=15)
    ids, lens = table.encode(["alpha beta gamma delta epsilon zeta eta theta iota kappa"])
    asked = []
    ask = table._ask
    monkeypatch.setattr(table, "_ask", lambda texts: asked.extend(texts) or ask(texts))
    again, _ = table.encode(["alpha beta gamma delta epsilon zeta eta theta iota kappa"])
    assert not asked and again.tolist() == ids.tolist()
    other = "lambda mu nu xi omicron pi rho sigma 1 tau"
    got, _ = table.encode([other, "alpha"])
    assert len(table.keys) == 11 and got.tolist() == ids_of(Tokenizer.from_file(WORD), other) + ids_of(Tokenizer.from_file(WORD), "alpha")
