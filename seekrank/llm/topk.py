"""Exact top-k search by inner product with a pivot table.

Distances to a few pivot rows are computed once and stored beside every vector.
For a query q and a row x the triangle inequality gives, over all pivots p,
|q - x| >= max |d(q, p) - d(x, p)|, and since <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2
that is an upper bound of the score. Rows are evaluated in the order of their
bounds; a row whose bound lies below the k-th score found so far is never
evaluated, and the search of a batch stops when no bound reaches it.

Queries go over the rows in blocks of bounded size; each task keeps the k best
rows of every query of the block, and only those are shuffled.

Rules for odd input: components become floor(scale * x) as double; vectors that
are null, without id, or hold null or non-finite components take no part;
shorter vectors count as padded with zeros (an empty vector scores 0); rows
with the query's id are never its candidates, and a query id that occurs twice
asks with its least vector; ties go to the smaller id, repeated rows appear
each; scores beyond a long are held at its ends; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.llm import common

PIVOTS = 24
#: Rows from which the pivots are chosen (lowest hash first); pivots only steer the order of work.
PIVOT_SAMPLE = 2048
#: Queries of one pass over the rows.
QUERY_BLOCK = 8192
_ROWS, _ABREAST, _STEP = 4096, 128, 512
_TABLE = "vec_id long, v binary, norm2 double, dist binary"


def _valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, raw: the rows that take part."""
    raw = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(F.col("raw"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), raw.alias("raw")).filter(
        F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of a list column as floor(scale * x), padded with zeros to ``dim``."""
    lens = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2))) if len(pivots) else np.zeros((len(x), 0))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each next one has the largest distance to those chosen."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as int64."""
    most = abs(q).max(initial=0) * abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    top, low = (1 << 63) - 1, -(1 << 63)
    return np.array([[min(max(sum(int(a) * b for a, b in zip(row, col)), low), top) for col in whole] for row in q], np.int64).reshape(len(q), len(x))


class Best:
    """The k best (score, id) of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises and does not overflow
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = place == self.k - 1
        self.floor[q[full]] = s[full].astype(np.float64)


def _search(query: dict, k: int):
    """Map function over the pivot table for one block of queries."""
    def run(batches):
        ids, q, norm2, dist = query["ids"], query["v"], query["norm2"], query["dist"]
        dim = q.shape[1]
        best = [Best(min(_ABREAST, len(ids) - lo), k) for lo in range(0, len(ids), _ABREAST)]
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                b = batch.slice(lo, _ROWS)
                n = b.num_rows
                rid = b.column("vec_id").to_numpy()
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float64).reshape(n, dim)
                rn = b.column("norm2").to_numpy()
                rd = np.frombuffer(b"".join(b.column("dist").to_pylist()), np.float64).reshape(n, -1)
                for g, found in enumerate(best):
                    own = slice(g * _ABREAST, g * _ABREAST + found.n)
                    low = np.zeros((found.n, n))
                    for p in range(rd.shape[1]):
                        np.maximum(low, abs(dist[own, p][:, None] - rd[None, :, p]), out=low)
                    both = norm2[own][:, None] + rn[None, :]
                    # the slack covers rounding, so that no bound lies below its score
                    bound = (both - low * low) / 2 + 1e-9 * both + 1
                    bound[ids[own][:, None] == rid[None, :]] = -np.inf
                    left = np.argsort(-bound.max(0), kind="stable")
                    while len(left):
                        left = left[((bound[:, left] >= found.floor[:, None]) & (bound[:, left] > -np.inf)).any(0)]
                        take, left = left[:_STEP], left[_STEP:]
                        if not len(take):
                            break
                        score = exact_scores(q[own], x[take])
                        qi, xi = np.nonzero((score >= found.floor[:, None]) & (bound[:, take] > -np.inf))
                        found.add(qi, score[qi, xi], rid[take][xi])
        for g, found in enumerate(best):
            yield pa.record_batch({"query_id": pa.array(ids[g * _ABREAST + found.query]), "vec_id": pa.array(found.id), "score": pa.array(found.score)})
    return run


def pivot_table(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> tuple[DataFrame, np.ndarray]:
    """The stored table (vec_id, v, norm2, dist) and its pivots."""
    rows = _valid(vectors, vec_id, vector)
    dim = rows.agg(F.max(F.size("raw"))).first()[0]
    dim = 0 if dim is None else int(dim)
    sample = rows.select("raw").orderBy(F.xxhash64("raw"), "vec_id").limit(PIVOT_SAMPLE).toArrow().column("raw").combine_chunks()
    pivots = choose_pivots(_matrix(sample, dim, scale)) if len(sample) else np.zeros((0, dim))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                b = batch.slice(lo, _ROWS)
                x = _matrix(b.column("raw"), dim, scale)
                yield pa.record_batch({"vec_id": b.column("vec_id"), "v": pa.array([r.tobytes() for r in x], pa.binary()),
                                       "norm2": pa.array((x * x).sum(1)), "dist": pa.array([r.tobytes() for r in _distances(x, pivots)], pa.binary())})
    return common.staged(rows.mapInArrow(run, _TABLE), "pivot-table"), pivots


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row with ``is_query`` (over the column vec_id)."""
    spark = vectors.sparkSession
    table, _ = pivot_table(vectors, vec_id, vector, scale)
    asked = table.filter(is_query)
    blocks = max(1, -(-asked.select("vec_id").distinct().count() // QUERY_BLOCK))
    path = common.scratch(spark, "top-k")
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(path)
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).groupBy("vec_id").agg(
            F.min(F.struct("v", "norm2", "dist")).alias("r")).select("vec_id", "r.*").orderBy("vec_id").toPandas()
        if not len(own):
            continue
        n = len(own)
        query = spark.sparkContext.broadcast({
            "ids": own["vec_id"].to_numpy(np.int64), "norm2": own["norm2"].to_numpy(float),
            "v": np.frombuffer(b"".join(own["v"]), np.float64).reshape(n, -1),
            "dist": np.frombuffer(b"".join(own["dist"]), np.float64).reshape(n, -1)})

        def run(batches, query=query):
            yield from _search(query.value, k)(batches)
        table.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        query.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
