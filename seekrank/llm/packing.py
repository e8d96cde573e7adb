"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut). Pieces are taken by size classes, large ones first. A round sorts
the pieces of the class and the gaps of the open sequences together by range
and matches them in one descending sweep: a piece takes the smallest gap left
that holds it, which is the last one passed and not yet taken, so matching is
bracket matching. Every range matches inside itself; what it leaves over is two
counts, and the ranges' counts decide which ranges' leftovers meet, by rank.
Gaps shrink, and the class is swept again while its pieces find gaps. When none
does, the largest pieces left open as many sequences as the pieces left need at
the least, and the rest is swept into their gaps; so on until none is left.

State is narrow (ids and sizes), written to the shared folder every round; the
driver knows how many pieces and gaps of each size there are, a row per size. A
gap that could hold several pieces offers several slots, up to its share of the
pieces. Every opening with its sweeps places about half of a class's tokens or
more, so the number of rounds grows with the logarithm of the number of rows at
worst; pieces of one length take one opening.

Rules for odd input: a null or empty text is the end id alone; repeated rows
and equal doc_ids are packed each; a null doc_id stays null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekrank.llm import common

CAPACITY = 2048
#: Rows of one range of a sweep, about; a range is matched in memory as three integer columns.
RANGE_ROWS = 200_000
#: Lower ends of the size classes, as parts of the capacity (0: no end). Fewer classes take fewer rounds; on mixed
#: lengths these three gave as few sequences as halving classes, in half the rounds.
CLASSES = (2, 8, 0)
_PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_SWEPT = "kind int, item long, length long, seq long, slot int, part int, pos long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Staged pieces: rid (unique), doc_id, piece, start, length, ids_crc32, ids (null unless kept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rid = common.word_ids(tokenizer), TaskContext.get().partitionId() << 40
        for b in common.slices(batches):
            ids, lens = common.with_end(*table.encode(b.column("text").to_pylist()), end_id)
            n = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(capacity, lens[doc] - piece * capacity)
            at = (np.cumsum(lens) - lens)[doc] + piece * capacity
            raw = ids.astype("<u4").tobytes()
            cuts = [raw[4 * a: 4 * (a + s)] for a, s in zip(at, size)]
            yield pa.record_batch({
                "rid": pa.array(rid + np.arange(len(doc))), "doc_id": b.column("doc_id").take(pa.array(doc)),
                "piece": pa.array(piece.astype(np.int32)), "start": pa.array(piece * capacity), "length": pa.array(size),
                "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                "ids": pa.array(cuts if keep_ids else [None] * len(cuts), pa.binary())})
            rid += len(doc)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)
    return common.staged(rows if keep_ids else rows.drop("ids"), "pieces")


def match_range(sizes: np.ndarray, is_item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One descending sweep over sorted rows: (items, their slots, items left over, slots left over from the smallest)."""
    step = np.where(is_item, -1, 1)
    height = np.cumsum(step)
    floor = np.minimum.accumulate(np.minimum(height, 0))
    alone = floor < np.r_[0, floor[:-1]]  # items that find the stack of slots empty
    level = height - floor + is_item
    rows = np.flatnonzero(~alone)
    rows = rows[np.argsort(level[rows], kind="stable")]  # on one level slots and items take turns
    items = np.flatnonzero(is_item[rows])
    taken, given = rows[items], rows[items - 1] if len(items) else rows[:0]
    free = ~is_item
    free[given] = False
    return taken, given, np.flatnonzero(alone), np.flatnonzero(free)[::-1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    size, kind, ident, slot = (t.column(c).to_numpy() for c in ("size", "kind", "id", "slot"))
    taken, given, items, slots = match_range(size, kind == 1)
    part = TaskContext.get().partitionId()
    for k, i, s in ((0, taken, given), (1, items, None), (2, None, slots)):
        n = len(i if i is not None else s)
        none = np.zeros(n, np.int64)
        yield pa.record_batch({
            "kind": pa.array(np.full(n, k, np.int32)), "item": pa.array(ident[i] if i is not None else none),
            "length": pa.array(size[i] if i is not None else none), "seq": pa.array(ident[s] if s is not None else none),
            "slot": pa.array((slot[s] if s is not None else none).astype(np.int32)),
            "part": pa.array(np.full(n, part, np.int32)), "pos": pa.array(np.arange(n))})


def meet(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which leftovers of different ranges meet: (item part, from, to, slot part, first slot).

    ``counts``: (part, items left, slots left) in sweep order. The items of a part
    take the slots of the parts before it, the nearest part first.
    """
    stack: list[list[int]] = []  # part, slots used, slots left
    out = []
    for part, items, slots in counts:
        done = 0
        while done < items and stack:
            top = stack[-1]
            n = min(items - done, top[2])
            out.append((part, done, done + n, top[0], top[1]))
            done, top[1], top[2] = done + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if slots:
            stack.append([part, 0, slots])
    return out


Sizes = dict[int, int]


def count_sizes(**frames: DataFrame) -> dict[str, Sizes]:
    """How many rows of each size (their only column) the frames have, in one job: a row per frame and size comes back."""
    rows = [df.toDF("size").select(F.lit(name).alias("of"), "size") for name, df in frames.items()]
    out: dict[str, Sizes] = {name: {} for name in frames}
    for name, size, n in reduce(DataFrame.unionByName, rows).groupBy("of", "size").count().collect():
        out[name][size] = n
    return out


class Packing:
    """The state of one packing job: open gaps and the placements made so far."""

    def __init__(self, spark: SparkSession, capacity: int):
        self.spark, self.capacity = spark, capacity
        self.gaps, self.gap_sizes = spark.createDataFrame([], "seq long, gap long"), {}
        self.placed: list[DataFrame] = []

    def _range(self, rows: int) -> int:
        return max(2, -(-rows // RANGE_ROWS))

    def sweep(self, pending: DataFrame, sizes: Sizes) -> tuple[DataFrame, Sizes]:
        """Match ``pending`` (rid, length) with the gaps once; returns what is left."""
        low, high, n = min(sizes), max(sizes), sum(sizes.values())
        n_wide = sum(c for gap, c in self.gap_sizes.items() if gap >= low)
        if not n_wide:
            return pending, sizes
        share = -(-n // n_wide)  # no more slots than the pieces can take, a gap's share rounded up
        n_slots = F.greatest(F.lit(1), F.least(F.lit(share), F.floor(F.col("gap") / high))).cast("int")
        slots = (self.gaps.filter(F.col("gap") >= low).withColumn("n", n_slots).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
                 .select(F.when(F.col("slot") < F.col("n"), F.lit(high).cast("long")).otherwise(F.col("gap") - (F.col("n") - 1) * high).alias("size"),
                         F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot"))
        events = slots.unionByName(pending.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("rid").alias("id"), F.lit(0).alias("slot")))
        order = [F.col("size").desc(), "kind", "id", "slot"]
        swept = common.staged(events.repartitionByRange(self._range(2 * n + n_wide), *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "swept")
        left = swept.filter("kind > 0").groupBy("part").agg(F.count_if(F.col("kind") == 1), F.count_if(F.col("kind") == 2)).collect()
        pairs = F.broadcast(self.spark.createDataFrame(meet(sorted(tuple(r) for r in left)), "part int, lo long, hi long, slot_part int, first long"))
        items, free = swept.filter("kind = 1").alias("i"), swept.filter("kind = 2").select("part", "pos", "seq", "slot")
        meets = (F.col("i.part") == F.col("p.part")) & (F.col("i.pos") >= F.col("p.lo")) & (F.col("i.pos") < F.col("p.hi"))
        across = (items.join(pairs.alias("p"), meets)
                  .select("item", "length", F.col("slot_part").alias("part"), (F.col("first") + F.col("i.pos") - F.col("lo")).alias("pos")).join(free, ["part", "pos"]))
        cols = ["item", "length", "seq", "slot"]
        matched = swept.filter("kind = 0").select(*cols).unionByName(across.select(*cols)).withColumn("gap", F.lit(None).cast("long"))
        known = self.gaps.select(F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("length"), "seq", F.lit(0).alias("slot"), "gap")
        by = Window.partitionBy("seq")  # one gap and the pieces that it takes
        before = F.sum("length").over(by.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        state = common.staged(matched.unionByName(known).select(
            F.col("item").alias("rid"), "seq", "length", (self.capacity - F.max("gap").over(by) + before).alias("offset"),
            (F.col("gap") - F.sum("length").over(by)).alias("gap")), "state")
        self.placed.append(state.filter("rid is not null").drop("gap"))
        self.gaps = state.filter("rid is null and gap > 0").select("seq", "gap")
        pending = items.join(pairs.alias("p"), meets, "left_anti").select(F.col("item").alias("rid"), "length")
        found = count_sizes(gaps=self.gaps.select("gap"), pieces=pending.select("length"))
        self.gap_sizes = found["gaps"]
        return pending, found["pieces"]

    def open(self, pending: DataFrame, sizes: Sizes) -> tuple[DataFrame, Sizes]:
        """New sequences, as many as ``pending`` needs at the least, with the largest pieces; returns the other pieces.

        No gap holds a piece of ``pending``. Each new sequence takes as many
        pieces as always fit, by falling size.
        """
        n, tokens = sum(sizes.values()), sum(size * c for size, c in sizes.items())
        k = self.capacity // max(sizes)
        need = max(-(-tokens // self.capacity), -(-n // (self.capacity // min(sizes))))
        if need == n:
            new = pending.select("rid", F.col("rid").alias("seq"), "length", F.lit(0).cast("long").alias("offset"))
            self.placed.append(new)
            self.gaps = self.gaps.unionByName(new.select("seq", (self.capacity - F.col("length")).alias("gap")))
            for size, c in sizes.items():
                self.gap_sizes[self.capacity - size] = self.gap_sizes.get(self.capacity - size, 0) + c
            return pending.limit(0), {}

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at = TaskContext.get().partitionId(), 0
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))],
                                                 [*b.schema.names, "part", "at"])
                at += b.num_rows
        order = [F.col("length").desc(), "rid"]
        rows = (pending.select("rid", "length").repartitionByRange(self._range(n), *order).sortWithinPartitions(*order)
                .mapInArrow(number, "rid long, length long, part int, at long"))
        rows = common.staged(rows, "ranked")
        counts = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
        starts = np.cumsum([0, *(c for _, c in counts)])
        first = self.spark.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], "part int, first long")
        ranked = rows.join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("at")).withColumn("group", F.expr(f"rank div {k}"))
        by = Window.partitionBy("group").orderBy("rank")
        new = common.staged(ranked.filter(F.col("group") < need).select(
            "rid", F.first("rid").over(by).alias("seq"), "length",
            F.coalesce(F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), "opened")
        self.placed.append(new)
        fresh = new.groupBy("seq").agg((self.capacity - F.sum("length")).alias("gap")).filter("gap > 0")
        rest = ranked.filter(F.col("group") >= need).select("rid", "length")
        found = count_sizes(gaps=fresh.select("gap"), pieces=rest.select("length"))
        self.gaps = self.gaps.unionByName(fresh)
        for size, c in found["gaps"].items():
            self.gap_sizes[size] = self.gap_sizes.get(size, 0) + c
        return rest, found["pieces"]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (the rid of the sequence's first piece) and offset to staged ``pieces`` (rid, length, ...)."""
    state = Packing(pieces.sparkSession, capacity)
    lengths = count_sizes(pieces=pieces.select("length"))["pieces"]
    high = capacity - 1
    for share in CLASSES:
        low = capacity // share if share else 0
        pending = pieces.filter((F.col("length") > low) & (F.col("length") <= high)).select("rid", "length")
        sizes = {size: n for size, n in lengths.items() if low < size <= high}
        while sizes:
            before = None
            while sizes and sizes != before:
                before = sizes
                pending, sizes = state.sweep(pending, sizes)
            if sizes:
                pending, sizes = state.open(pending, sizes)
        high = low
    place = pieces.filter(F.col("length") == capacity).select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in state.placed:
        place = place.unionByName(p.select("rid", F.col("seq").alias("sequence_id"), "offset"))
    return pieces.join(place, "rid").drop("rid")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, keep_ids), capacity)
