"""Token files: static range asymmetric numeral system (rANS) blocks with checkpoints and checksums.

``write_token_files`` turns documents into token ids, orders them by doc_id and
writes one table of independent compressed blocks; ``read_token_files`` decodes
every block on its own and returns a digest per document.

File format. A folder holds three Parquet tables (Spark's commit protocol keeps
them whole when executors are lost):

``model``   one row per token: token, freq. Frequencies are scaled to sum 2**PROB_BITS;
            every block shares them (the static model).
``parts``   one row per range of documents: part, n (ids in it).
``blocks``  part, pos (ids of the part before the block), n, payload, and the runs of
            documents in the block: doc_id, doc_pos (ids of the part before the
            document), doc_len, run_from (ids of the document before the run), run_len.

A payload is little-endian: ``RANS``, n, words, crc32 of the ids (unsigned 32-bit
ids), checkpoint count, then per checkpoint its first word and LANES 64-bit
states, then the 32-bit words. Id ``i`` of a block belongs to lane ``i % LANES``.
The checkpoints, every CHECK_STEPS steps, let readers decode stretches of one
block at the same time; all stretches of many blocks are decoded in step.

Rules for odd input: a null or empty text holds the end id alone; rows with one
doc_id stand next to each other, inside a range by hash and text; null doc_ids come first; an empty table
gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.llm import common

PROB_BITS = 20
LANES = 64
BLOCK = 1 << 16
CHECK_STEPS = 256
#: Blocks coded side by side in one task; bounds memory, not the result.
ABREAST = 48
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<4sIIII")


def scale_counts(counts: np.ndarray, bits: int = PROB_BITS) -> np.ndarray:
    """Integer frequencies with sum 2**bits, at least 1 where the count is positive; ties by position."""
    counts = counts.astype(np.float64)
    used = counts > 0
    if used.sum() > 1 << bits:
        raise ValueError("more distinct ids than the model can hold")
    if not used.any():
        return np.zeros(len(counts), np.int64)
    freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))), 0).astype(np.int64)
    rest = (1 << bits) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # take from the largest, never below 1
        spare = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -rest // (1 << bits)))
        spare = np.maximum(spare, 0)
        cut = np.minimum(np.cumsum(spare), -rest)
        freq[order] -= np.diff(np.r_[0, cut])
        rest = (1 << bits) - int(freq.sum())
    return freq


class Model:
    """Shared frequency table: encoder and decoder lookups."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray):
        self.tokens = tokens.astype(np.uint32)
        self.freq = np.r_[freq, 1 << PROB_BITS].astype(np.uint64)  # the last one pads: coding it changes nothing
        self.cum = np.r_[np.cumsum(freq) - freq, 0].astype(np.uint64)
        self.rank = np.zeros(int(self.tokens.max(initial=0)) + 1, np.int64)
        self.rank[self.tokens] = np.arange(len(tokens))
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """One payload per run of ids (each of BLOCK ids at most)."""
        steps = -(-max(map(len, blocks)) // LANES)
        grid = np.full((len(blocks), steps * LANES), len(self.tokens), np.int64)
        for row, ids in zip(grid, blocks):
            row[: len(ids)] = self.rank[ids]
        grid = np.ascontiguousarray(grid.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
        state = np.full((len(blocks), LANES), _LOW, np.uint64)
        words, out = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
        bits, top = np.uint64(PROB_BITS), np.uint64(63 - PROB_BITS)
        marks = {}
        for s in range(steps - 1, -1, -1):
            freq, cum = self.freq[grid[s]], self.cum[grid[s]]
            full = state >= freq << top
            words[s], out[s] = state.astype(np.uint32), full
            state = np.where(full, state >> _32, state)
            div = state // freq
            state = (div << bits) + (state - div * freq) + cum
            if s % CHECK_STEPS == 0:
                marks[s] = state
        got = []
        for b, ids in enumerate(blocks):
            emit = out[:, b]
            before = np.r_[0, np.cumsum(emit.sum(1))]
            own = [s for s in sorted(marks) if s * LANES < len(ids)]
            data = words[:, b][emit].astype("<u4").tobytes()
            head = _HEAD.pack(b"RANS", len(ids), len(data) // 4, zlib.crc32(ids.astype("<u4").tobytes()), len(own))
            got.append(head + b"".join(struct.pack("<I", before[s]) + marks[s][b].astype("<u8").tobytes() for s in own) + data)
        return got

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of each payload; raises when a payload or its checksum is broken."""
        heads, units, streams, at = [], [], [], 0
        for k, p in enumerate(payloads):
            magic, n, n_words, crc, n_marks = _HEAD.unpack_from(p)
            size = 4 + 8 * LANES
            if magic != b"RANS" or len(p) != _HEAD.size + n_marks * size + 4 * n_words:
                raise ValueError("not a whole token block")
            heads.append((n, crc))
            for j in range(n_marks):
                o = _HEAD.size + j * size
                units.append((k, j, at + struct.unpack_from("<I", p, o)[0], np.frombuffer(p, "<u8", LANES, o + 4), n - j * CHECK_STEPS * LANES))
            streams.append(np.frombuffer(p, "<u4", n_words, _HEAD.size + n_marks * size))
            at += n_words
        stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
        state = np.array([u[3] for u in units], np.uint64).reshape(-1, LANES)
        word = np.array([u[2] for u in units], np.int64)
        left = np.array([min(u[4], CHECK_STEPS * LANES) for u in units], np.int64)
        steps = -(-int(left.max(initial=0)) // LANES)
        ids = np.zeros((len(units), steps * LANES), np.uint32)
        lane, mask, bits = np.arange(LANES), np.uint64((1 << PROB_BITS) - 1), np.uint64(PROB_BITS)
        for s in range(steps):
            live = (s * LANES + lane)[None, :] < left[:, None]
            low = state & mask
            sym = self.slot[low]
            new = self.freq[sym] * (state >> bits) + low - self.cum[sym]
            need = live & (new < _LOW)
            at = np.minimum(word[:, None] + np.cumsum(need, 1) - 1, len(stream) - 1)
            new = np.where(need, (new << _32) | stream[at], new)
            word += need.sum(1)
            state = np.where(live, new, state)
            ids[:, s * LANES : (s + 1) * LANES] = self.tokens[sym]
        by_block: list[list[np.ndarray]] = [[] for _ in payloads]
        for u, row, n, end in zip(units, ids, left, state):
            by_block[u[0]].append(row[:n])
            if u[4] <= CHECK_STEPS * LANES and (end != _LOW).any():  # where the encoder began
                raise ValueError("a token block does not end as it began")
        got = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in by_block]
        for x, (n, crc) in zip(got, heads):
            if len(x) != n or zlib.crc32(x.astype("<u4").tobytes()) != crc:
                raise ValueError("a token block does not match its checksum")
        return got


_TOKENS = "part int, doc_id long, pos long, ids binary, counts binary"
_BLOCKS = ("part int, pos long, n int, payload binary, "
           "runs array<struct<doc_id:long,doc_pos:long,doc_len:long,run_from:long,run_len:int>>")


def _tokenize(path: str, end: int):
    """A row of ids per document; the last row of a task has no ids, but the number of them and the count of each (ids, then counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, table = TaskContext.get().partitionId(), 0, common.word_ids(path)
        total = np.zeros(0, np.int64)
        for b in common.slices(batches):
            ids, lens = common.with_end(*table.encode(b.column("text").to_pylist()), end)
            own = np.bincount(ids)
            total = np.r_[total, np.zeros(max(0, len(own) - len(total)), np.int64)]
            total[: len(own)] += own
            ends = np.cumsum(lens)
            raw = ids.astype("<u4").tobytes()
            yield pa.record_batch({
                "part": pa.array(np.full(len(lens), part, np.int32)), "doc_id": b.column("doc_id"),
                "pos": pa.array(pos + ends - lens),
                "ids": pa.array([raw[4 * (e - n): 4 * e] for e, n in zip(ends, lens)], pa.binary()),
                "counts": pa.nulls(len(lens), pa.binary())})
            pos += int(ends[-1])
        if pos:
            used = np.flatnonzero(total)
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "pos": pa.array([pos]), "ids": pa.nulls(1, pa.binary()),
                                   "counts": pa.array([used.astype("<i8").tobytes() + total[used].astype("<i8").tobytes()], pa.binary())})
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all ranges that a task reads, summed."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column("counts").to_pylist():
            token, n = np.frombuffer(raw, "<i8").reshape(2, -1)
            total = np.r_[total, np.zeros(max(0, int(token[-1]) + 1 - len(total)), np.int64)]
            total[token] += n
    used = np.flatnonzero(total)
    yield pa.record_batch({"token": pa.array(used), "n": pa.array(total[used])})


def by_doc_id(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) in ``n`` ranges of ascending doc_id, sorted; nulls first.

    The bounds come from the doc_id column alone. An id of more rows than two
    ranges hold is spread over its ranges, so that no task gets them all.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(key, shares, min(1_000_000, max(10_000, 100 * n))).alias("b")).first()["b"] if shares else None
    if not found:
        return docs.repartition(1).sortWithinPartitions("doc_id", "text")
    bounds = F.lit([int(x) for x in found]).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range((n - 1).bit_length() - 1, -1, -1)))

    def passed(test):  # the number of bounds for which the test holds, by doubling steps downwards
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(test(F.get(bounds, at + step - 1)), at + step).otherwise(at))
    below, upto = passed(lambda b: b < key), passed(lambda b: b <= key)
    salt = F.pmod(F.monotonically_increasing_id(), upto - below + 1).cast("int")
    part = F.when(upto - below > 1, below + salt).otherwise(upto)
    return docs.withColumn("part", part).repartitionById(n, "part").sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("doc_id", "text")


def _encode(model: Model):
    def flush(ready: list[dict]) -> pa.RecordBatch:
        payloads = model.encode([r["ids"] for r in ready])
        rows = [{"part": r["part"], "pos": r["pos"], "n": len(r["ids"]), "payload": p, "runs": r["runs"]} for r, p in zip(ready, payloads)]
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, now, ids, n = [], None, [], 0
        for b in batches:
            for part, doc, pos, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "pos", "ids"))):
                own, done = np.frombuffer(raw, "<u4"), 0
                while done < len(own):
                    if now and (now["part"] != part or now["pos"] + n != pos + done or n == BLOCK):
                        ready.append(now | {"ids": np.concatenate(ids)})
                        now = None
                        if len(ready) == ABREAST:
                            yield flush(ready)
                            ready = []
                    if not now:
                        now, ids, n = {"part": part, "pos": pos + done, "runs": []}, [], 0
                    take = min(BLOCK - n, len(own) - done)
                    now["runs"].append({"doc_id": doc, "doc_pos": pos, "doc_len": len(own), "run_from": done, "run_len": take})
                    ids.append(own[done: done + take])
                    n, done = n + take, done + take
        if now:
            ready.append(now | {"ids": np.concatenate(ids)})
        if ready:
            yield flush(ready)
    return run


_ARROW = pa.schema([
    ("part", pa.int32()), ("pos", pa.int64()), ("n", pa.int32()), ("payload", pa.binary()),
    ("runs", pa.list_(pa.struct([("doc_id", pa.int64()), ("doc_pos", pa.int64()), ("doc_len", pa.int64()),
                                 ("run_from", pa.int64()), ("run_len", pa.int32())])))])


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ABREAST):
                part = b.slice(lo, ABREAST)
                cols = {k: [] for k in ("part", "doc_id", "doc_pos", "doc_len", "run_from", "run_len", "crc")}
                for p, runs, ids in zip(part.column("part").to_pylist(), part.column("runs").to_pylist(),
                                        model.decode(part.column("payload").to_pylist())):
                    raw, at = ids.astype("<u4").tobytes(), 0
                    for r in runs:
                        cols["part"].append(p)
                        for k, v in r.items():
                            cols[k].append(v)
                        cols["crc"].append(zlib.crc32(raw[at: at + 4 * r["run_len"]]))
                        at += 4 * r["run_len"]
                yield pa.record_batch({k: pa.array(v, pa.int32() if k in ("part", "run_len") else pa.int64()) for k, v in cols.items()})
    return run


def _crc_times(matrix: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v, i = v >> 1, i + 1
    return out


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings put together, from their crc32s and the second one's length."""
    odd = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit, as a matrix over GF(2)
    for _ in range(3):  # one zero byte
        odd = [_crc_times(odd, c) for c in odd]
    while length:
        if length & 1:
            first = _crc_times(odd, first)
        odd, length = [_crc_times(odd, c) for c in odd], length >> 1
    return first ^ second


@F.pandas_udf(T.LongType())
def _join_crcs(runs: pd.Series) -> pd.Series:
    def one(x):
        crc = int(x[0]["crc"])
        for r in x[1:]:
            crc = crc32_join(crc, int(r["crc"]), 4 * int(r["run_len"]))
        return crc
    return runs.map(one)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into the folder ``path``.

    One shuffle, of the texts by range of doc_id. The ids are written once
    beside the blocks, with the counts that the model needs.
    """
    spark = docs.sparkSession
    ordered = by_doc_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), common.partitions(spark))
    tokens = common.staged(ordered.mapInArrow(_tokenize(tokenizer, end_id), _TOKENS), "token-ids")
    ends = tokens.filter(F.col("counts").isNotNull())  # one row per range
    counts = ends.select("counts").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = counts.orderBy("token").toPandas()  # one row per id of the vocabulary at most
    table["freq"] = scale_counts(table["n"].to_numpy(np.int64))
    spark.createDataFrame(table[["token", "freq"]].astype("int64"), "token long, freq long").coalesce(1).write.parquet(f"{path}/model")
    ends.select("part", F.col("pos").alias("n")).write.parquet(f"{path}/parts")
    model = Model(table["token"].to_numpy(np.int64), table["freq"].to_numpy(np.int64))
    rows = tokens.filter(F.col("ids").isNotNull()).select("part", "doc_id", "pos", "ids")
    rows.mapInArrow(_encode(model), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_model(spark: SparkSession, path: str) -> Model:
    table = spark.read.schema("token long, freq long").parquet(f"{path}/model").orderBy("token").toPandas()
    return Model(table["token"].to_numpy(np.int64), table["freq"].to_numpy(np.int64))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start (ids of all parts before it); one row per written range of documents."""
    rows = sorted(tuple(r) for r in spark.read.schema("part int, n long").parquet(f"{path}/parts").collect())
    starts = np.cumsum([0, *(n for _, n in rows)])
    return spark.createDataFrame([(p, int(s)) for (p, _), s in zip(rows, starts)], "part int, part_start long")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks: doc_id, start, n_tokens, ids_crc32 per document, checksums verified."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    runs = blocks.select("part", "payload", "runs").mapInArrow(
        _decode(read_model(spark, path)),
        "part int, doc_id long, doc_pos long, doc_len long, run_from long, run_len int, crc long")
    whole = (runs.groupBy("part", "doc_pos")
             .agg(F.first("doc_id").alias("doc_id"), F.first("doc_len").alias("n_tokens"),
                  F.array_sort(F.collect_list(F.struct("run_from", "run_len", "crc"))).alias("runs")))
    return whole.join(F.broadcast(part_starts(spark, path)), "part").select(
        "doc_id", (F.col("part_start") + F.col("doc_pos")).alias("start"), "n_tokens",
        F.when(F.size("runs") == 1, F.col("runs")[0]["crc"]).otherwise(_join_crcs("runs")).alias("ids_crc32"))
