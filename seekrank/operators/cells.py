"""Exact cell index for cosine top-k (V4): cells of similar vectors, visited by upper bound.

``build_cells`` gives every vector the cell of its nearest centre and writes the
vectors in tiles, ordered by cell, with the least cosine of a cell's members to
its centre. By the triangle inequality on angles no member of a cell scores
above cos(angle(query, centre) - radius).

``cell_topk`` visits cells in rounds: a query's best cell, then its next few,
then all others. After every round the k-th score so far is shared over all
queries' tasks, and a cell whose bound lies below it is never read for that
query. Every cell that could hold a better row is visited, so the result equals
the exhaustive one, whatever the vectors look like; how much is skipped depends
on them. Queries of one nearest cell travel together, so that their cells agree;
a cell scores those of them that want it, and passes on what reaches their k-th score.

Centres are fitted on a bounded sample (``SAMPLE`` rows, at most ``MAX_CELLS``
centres); every vector is indexed. Vectors without direction (norm zero or not
finite) score 0 for every query and form a cell of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekrank.config import DEFAULT, SearchConfig
from seekrank.functions.vectors import l2_norm
from seekrank.operators.retrieval import SURE, _best_of_tiles, _groups, with_norm
from seekrank.session import scratch, staged

#: Rows that the centres are fitted on, centres at most, steps of the fit.
SAMPLE, MAX_CELLS, STEPS = 20_000, 1024, 8
#: Cells visited up to the end of each round.
ROUNDS = (1, 6, MAX_CELLS + 1)
#: Slack of the bounds against rounding.
SLACK = 1e-9
#: Bytes of a tile of queries.
QUERY_BYTES = 256 << 10
NO_CELL = -1


@dataclass
class Cells:
    cells: np.ndarray  # numbers of the cells that have rows
    centres: np.ndarray  # their centres, of length 1
    low: np.ndarray  # least cosine of a member to its centre
    rows: np.ndarray


@dataclass
class CellIndex:
    tiles: DataFrame  # cell, id, vector, norm, type (a tile of rows each), low
    known: Cells


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(np.isfinite(u).all(1, keepdims=True), u, 0.0)


def fit_centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Spherical k-means on a bounded sample, the rows of least hash."""
    rows = vectors.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    u = _unit(_matrix(rows.column(0).combine_chunks()))
    u = np.unique(u[u.any(1)], axis=0)
    if not len(u):
        return np.zeros((0, 1))
    centres = u[np.random.default_rng(0).permutation(len(u))[:cells]]
    for _ in range(STEPS):
        nearest = np.concatenate([(u[lo:lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(u), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, u)
        centres = np.where(np.bincount(nearest, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres[centres.any(1)]


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_matrix(b.column("vector"))) if b.num_rows else np.zeros((0, centres.shape[1]))
            s = u @ centres.T if len(centres) else np.zeros((len(u), 1))
            cell = np.where(u.any(1), s.argmax(1) if len(s) else 0, NO_CELL)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(s.max(1) if len(s) else np.zeros(0))], [*b.schema.names, "cell", "low"])
    return run


def _tiles(limit: int):
    """Tiles of one cell each, from rows sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)] if len(cell) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                step = max(1, limit // (8 * len(b.column("vector")[int(lo)])))
                for at in range(int(lo), int(hi), step):
                    own = b.slice(at, min(step, int(hi) - at))
                    cols = {c: pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c)) for c in ("id", "norm", "type")}
                    yield pa.record_batch({"cell": pa.array([cell[at]], pa.int32()), "id": cols["id"], "vector": pa.array([_matrix(own.column("vector")).tobytes()], pa.binary()),
                                           "norm": cols["norm"], "type": cols["type"], "low": pa.array([pc.min(own.column("low")).as_py()], pa.float64())})
    return run


def build_cells(vectors: DataFrame, path: str | None = None, cells: int | None = None, cfg: SearchConfig = DEFAULT) -> CellIndex:
    """Write the index of ``vectors`` (id, vector, type; norm where stored) to ``path``; about the square root of the rows as cells."""
    spark = vectors.sparkSession
    path = path or scratch(spark, "cells")
    rows = with_norm(vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))).select("id", "vector", "norm", "type")
    centres = fit_centres(rows, min(MAX_CELLS, cells or max(1, int(rows.count() ** 0.5))))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    assigned = rows.mapInArrow(_assign(centres), ", ".join(f"{c} {t}" for c, t in types.items()) + ", cell int, low double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (assigned.repartitionByRange(n, "cell", "id").sortWithinPartitions("cell", "id")
     .mapInArrow(_tiles(cfg.tile_bytes), f"cell int, id array<{types['id']}>, vector binary, norm array<double>, type array<string>, low double")
     .write.parquet(f"{path}/tiles"))
    known = (spark.read.parquet(f"{path}/tiles").groupBy("cell").agg(F.min("low").alias("low"), F.sum(F.size("id")).alias("rows")).collect())  # one row per cell
    found = [(r["cell"], centres[r["cell"]].tolist() if r["cell"] >= 0 else None, r["low"], r["rows"]) for r in sorted(known)]
    spark.createDataFrame(found, "cell int, centre array<double>, low double, rows long").coalesce(1).write.parquet(f"{path}/cells")
    return open_cells(spark, path)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MAX_CELLS and one at most
    dim = max((len(r["centre"]) for r in rows if r["centre"]), default=1)
    known = Cells(np.array([r["cell"] for r in rows], np.int32), np.array([r["centre"] or [0.0] * dim for r in rows]).reshape(len(rows), dim),
                  np.array([r["low"] for r in rows]), np.array([r["rows"] for r in rows], np.int64))
    return CellIndex(spark.read.parquet(f"{path}/tiles"), known)


def upper_bounds(queries: np.ndarray, index: Cells) -> np.ndarray:
    """No row of a cell (column) scores above this for a query (row)."""
    u, some = _unit(queries), index.cells != NO_CELL
    bound = np.full((len(u), len(index.cells)), SLACK)
    if some.any():
        apart = np.arccos(np.clip(u @ index.centres[some].T, -1, 1)) - np.arccos(np.clip(index.low[some], -1, 1))[None, :]
        bound[:, some] = np.cos(np.maximum(0, apart)) + SLACK
    bound[~u.any(1)] = SLACK  # a query without direction scores 0 everywhere
    return bound


def _visits(index: Cells, first: int, last: int):
    """Query tiles with the cells to visit: of each query's cells in order of bound those from ``first`` to ``last`` that reach its k-th score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                step = max(1, QUERY_BYTES // (8 * len(b.column("qvec")[lo])))
                own = b.slice(lo, step)
                lo += step
                q = _matrix(own.column("qvec"))
                bound = upper_bounds(q, index)
                order = np.argsort(-bound, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
                reach = own.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                wanted = (rank >= first) & (rank < last) & (bound >= reach[:, None])
                some = np.flatnonzero(wanted.any(1))
                if not len(some):
                    continue
                own, q = own.take(pa.array(some)), q[some]
                cols = {c: pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), own.column(c)) for c in ("query_id", "qnorm", "k", "types")}
                least = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.array(reach[some] - SURE))
                visited = np.flatnonzero(wanted.any(0))
                who = np.packbits(wanted[np.ix_(some, visited)].T, axis=1)  # of each visited cell the queries that want it
                yield pa.record_batch({"query_id": cols["query_id"], "qvec": pa.array([q.tobytes()], pa.binary()), "qnorm": cols["qnorm"], "k": cols["k"], "types": cols["types"], "least": least,
                                       "cells": pa.array([index.cells[visited].tolist()], pa.list_(pa.int32())), "wanted": pa.array([who.tobytes()], pa.binary())})
    return run


def dealt_tiles(tiles: DataFrame, groups: int) -> DataFrame:
    """Tiles of queries with each group ``g`` of the cells they visit: a tile goes to a group once, however many of its cells it visits."""
    return tiles.withColumn("g", F.explode(F.array_distinct(F.transform("cells", lambda c: F.pmod(c, F.lit(groups))))))


def cell_topk(index: CellIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4 from the index: (query_id, id, score), and the report (round, tiles of queries, cells read for them, cells in all).

    ``queries``: query_id, qvec, k and optionally types.
    """
    spark, known = queries.sparkSession, index.known
    types = F.col("types") if "types" in queries.columns else F.lit(None).cast("array<string>")
    q = queries.select("query_id", "qvec", F.col("k").cast("int").alias("k"), types.alias("types")).filter(F.size("qvec") > 0).withColumn("qnorm", l2_norm("qvec"))
    id_type, query_type = index.tiles.schema["id"].dataType.elementType.simpleString(), q.schema["query_id"].dataType.simpleString()
    names = {"query_id": query_type, "qvec": q.schema["qvec"].dataType.simpleString(), "k": "int", "types": "array<string>", "qnorm": "double"}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = upper_bounds(_matrix(b.column("qvec")), known).argmax(1) if b.num_rows and len(known.cells) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(best, np.int32))], [*b.schema.names, "near"])
    q = staged(q.select(*names).mapInArrow(nearest, ", ".join(f"{c} {t}" for c, t in names.items()) + ", near int"), "cell-queries")
    best = spark.createDataFrame([], f"query_id {query_type}, k int, id {id_type}, score double")
    report, first = [], 0
    groups = _groups(spark)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    for number, last in enumerate(ROUNDS):
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= F.first("k"), F.min("score")).alias("kth"))
        dealt = q.join(kth, "query_id", "left").repartitionByRange("near", "query_id").sortWithinPartitions("near", "query_id")
        tiles = staged(dealt.mapInArrow(_visits(known, first, last), f"query_id array<{query_type}>, qvec binary, qnorm array<double>, k array<int>, types array<array<string>>, least array<double>, cells array<int>, wanted binary"), "visits")
        report.append(tiles.agg(F.lit(number).alias("round"), F.count("*").alias("query_tiles"), F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("cells_read")))
        # merged, as the size that Spark sees of dealt tiles is that of one copy: all copies would go through the driver
        pairs = dealt_tiles(tiles, groups).hint("merge").join(index.tiles.drop("low").withColumn("g", F.pmod("cell", F.lit(groups))), "g").withColumn("at", F.array_position("cells", F.col("cell"))).filter("at > 0")
        wide = F.expr("cast(length(wanted) div size(cells) as int)")
        own = F.substring("wanted", (F.col("at").cast("int") - 1) * wide + 1, wide).alias("wanted")
        scored = pairs.select("id", "vector", "norm", "type", "query_id", "qvec", "qnorm", "k", "types", "least", own).mapInArrow(_best_of_tiles, f"query_id {query_type}, k int, id {id_type}, score double")
        both = best.unionByName(scored).dropDuplicates(["query_id", "id"])
        best = staged(both.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= F.col("k")).drop("rn"), "cell-best")
        first = last
    told = report[0]
    for r in report[1:]:
        told = told.unionByName(r)
    return best.select("query_id", "id", "score"), told.withColumn("cells", F.lit(len(known.cells)))
