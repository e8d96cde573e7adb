"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to 2**BITS cells of about equal row counts, strings
by their rank among the distinct values; a row gets the Hilbert index of its cell, and the rows sorted by that index are cut
into runs. Rows that are near each other in all dimensions share files, so a
filter on any of the dimensions skips most files.

Only narrow rows are sorted: ids, sizes, checksums and the curve index. The law
is ``rows``: with N rows and S shards, shard s holds the ranks from ceil(s*N/S),
so counts are at most one apart whatever the keys look like.

Rules for odd input: a null text has size 1 and the checksum of the empty text;
nulls in a dimension take its lowest cell; ties on the curve are ordered by
checksum (equal texts stand together), doc_id and size; fully equal rows may
swap places; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.llm import common

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows) with coordinates below 2**bits.

    Works from the highest bit down: turn the lower bits of the axes so that
    each sub-cube is passed in the order and direction the curve needs, then
    read the bits of all axes, Gray-decoded, as one number.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _curve(bits: int):
    @F.pandas_udf(T.LongType())
    def curve(cells: pd.Series) -> pd.Series:
        points = np.stack(cells.to_numpy()) if len(cells) else np.zeros((0, 1), np.int64)
        return pd.Series(hilbert_index(points, bits))
    return curve


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, n) of a sorted part, with the rows counted before each."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        total = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total - n), pa.array(np.full(b.num_rows, part, np.int32))], ["value", "n", "before", "part"])
        before = int(total[-1]) if len(total) else before


def string_bounds(rows: DataFrame, column: str, cells: int) -> list[str]:
    """First values of the cells but the lowest, when the column's distinct values, in order, are cut into cells of about equal row counts.

    Whole strings count, however long a beginning they share: the distinct
    values are counted, sorted by range, and a value's cell comes from the rows
    of the values before it. One value per cell comes back.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange(common.partitions(spark), "value").sortWithinPartitions("value")
    placed = common.staged(ordered.mapInArrow(_running, "value string, n long, before long, part int"), "values")
    parts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect())  # a row per part
    total = sum(n for _, n in parts)
    offsets = np.cumsum([0, *(n for _, n in parts)])
    starts = spark.createDataFrame([(p, int(o)) for (p, _), o in zip(parts, offsets)], "part int, start long")
    cell = F.expr(f"((start + before) * {cells}) div {max(total, 1)}")
    firsts = placed.join(F.broadcast(starts), "part").groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).orderBy("cell").collect()
    return [r["value"] for r in firsts][1:]


def string_cell(column: str, bounds: list[str]) -> Column:
    """The cell of a string (null: the lowest)."""
    return sum(((F.coalesce(F.col(column), F.lit("")) >= F.lit(b)).cast("long") for b in bounds), F.lit(0).cast("long"))


def number_cells(rows: DataFrame, columns: list[str]) -> list[Column]:
    """The cell of each numeric column (null: the lowest): bounds are approximate percentiles, a fixed number per column, from one pass."""
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = rows.agg(*(F.percentile_approx(c, steps, 1000).alias(f"b{i}") for i, c in enumerate(columns))).first()

    def cell(i: int, column: str) -> Column:
        c = F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)).cast("long"))
        return sum(((c >= F.lit(v)).cast("long") for v in sorted(set(found[f"b{i}"] or []))), F.lit(0).cast("long"))
    return [cell(i, c) for i, c in enumerate(columns)]


def assign_shards(rows: DataFrame, cells: list[Column], shards: int, *keep: str) -> DataFrame:
    """``keep`` columns, shard and slot of every row; ``cells`` (below 2**BITS) are expressions over ``rows``.

    The last sort keys are the ``keep`` columns. One shuffle sorts the narrow
    rows by range; ranks are part offsets plus places in the part, taken from
    the written order, so no part is read twice with other bounds.
    """
    spark = rows.sparkSession
    n_parts = common.partitions(spark)
    placed = (rows.select(*keep, _curve(BITS)(F.array(*cells)).alias("__h"))
              .repartitionByRange(n_parts, "__h", *keep).sortWithinPartitions("__h", *keep))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))],
                                             [*b.schema.names, "__part", "__at"])
            at += b.num_rows
    order = common.staged(placed.mapInArrow(number, f"{types}, __part int, __at long"), "curve-order")
    counts = sorted(tuple(r) for r in order.groupBy("__part").count().collect())  # a row per part
    total = sum(n for _, n in counts)
    offsets = np.cumsum([0, *(n for _, n in counts)])
    starts = spark.createDataFrame([(p, int(o)) for (p, _), o in zip(counts, offsets)], "__part int, __start long")
    return (order.join(F.broadcast(starts), "__part")
            .withColumn("__rank", F.col("__start") + F.col("__at"))
            .withColumn("shard", F.expr(f"cast((__rank * {shards}) div {max(total, 1)} as int)"))
            .withColumn("slot", F.expr(f"__rank - (shard * bigint({total}) + {shards} - 1) div {shards}"))
            .select(*keep, "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Dimensions: source, language, size and doc_id (order of arrival).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), "lang", "source")
    cells = [string_cell(c, string_bounds(rows, c, 1 << BITS)) for c in ("source", "lang")] + number_cells(rows, ["size", "doc_id"])
    placed = assign_shards(rows, cells, shards, "text_crc32", "doc_id", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as one folder per shard, in curve order within files."""
    key = docs.withColumn("__key", F.struct(F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c"), F.col("doc_id").cast("long").alias("d")))
    place = shard_documents(docs, shards).select(F.struct(F.col("text_crc32").alias("c"), F.col("doc_id").alias("d")).alias("__key"), "shard", "slot")
    place = place.groupBy("__key").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))  # repeated rows stay together
    same = F.col("k.__key").eqNullSafe(F.col("p.__key"))
    (key.alias("k").join(place.alias("p"), same).drop("__key")
     .repartitionByRange(max(shards, common.partitions(docs.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))
