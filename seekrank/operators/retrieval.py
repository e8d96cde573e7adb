"""Vector retrieval: V1 request defaults, V2 candidate budget, V3 type filter, V4 top-k.

Plan shape of :func:`vector_topk`, the same for every size:

1. vectors and queries are packed into tiles of bounded bytes (one flat matrix
   each); every vector tile belongs to one of a fixed number of groups, every
   query tile is dealt to all groups, and the two meet in an equi-join on the
   group – no product node, no broadcast that depends on the number of
   queries, nothing collected; the groups follow the cores that run, not the
   shuffle partitions, so that tiles travel no more often when there are more rows;
2. a pair of tiles is one matrix product, in slices of bounded size; the type
   filter masks it, and the best k rows per query of the tile are selected for
   all queries at once; a task keeps the best rows of its tiles together before
   it passes them on;
3. the same is done first with one row in :data:`FIRST`: a query's k-th score
   among those is reached by all of its best rows, so what stays below it is not
   passed on, and the rows passed on do not grow with the number of tiles;
4. only those narrow rows are shuffled, on ``query_id``, for the final ranking;
5. metadata columns are joined back for the winners only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekrank.config import DEFAULT, SearchConfig
from seekrank.functions.text import ws_trim
from seekrank.functions.vectors import l2_norm

#: Lists in which the requests of a type travel to the rows they allow (V3).
LISTS = 256
#: Scores of a pair of tiles that are held at once, and best rows that a task holds back before it passes them on (V4).
SCORES, HELD = 2 << 20, 2 << 20
#: One row in so many (by its id) bounds the k-th scores before all rows are scored; groups of those rows that a query meets (V4).
FIRST, FIRST_GROUPS = 16, 8
#: Groups of rows for each core, at most: a tile of queries travels once to each group (V4).
GROUPS = 8
#: Scores of one pair differ by less between products of different shapes.
SURE = 1e-9
META_COLS = ("url", "type", "title", "snippet", "updated_at")


# --------------------------------------------------------------------------- V1, V2

def normalise_queries(queries: DataFrame, cfg: SearchConfig = DEFAULT) -> DataFrame:
    """V1: trimmed query (blank + types → types joined by a space), clamped paging."""
    cols = queries.columns
    types = F.col("types") if "types" in cols else F.lit(None).cast("array<string>")
    q = ws_trim(F.coalesce(F.col("query"), F.lit("")))
    from_types = F.concat_ws(" ", types)
    query = F.when((q == "") & (F.coalesce(F.size(types), F.lit(0)) > 0), from_types).otherwise(q)
    pp = F.col("per_page") if "per_page" in cols else F.lit(None)
    pg = F.col("page") if "page" in cols else F.lit(None)
    per_page = F.least(F.greatest(F.coalesce(pp.cast("long"), F.lit(cfg.default_per_page)), F.lit(1)),
                       F.lit(cfg.max_per_page))
    page = F.greatest(F.coalesce(pg.cast("long"), F.lit(1)), F.lit(1))
    tft = F.col("type_filter_text") if "type_filter_text" in cols else F.lit(None).cast("string")
    out = queries.withColumns({"query": query, "types": types, "per_page": per_page, "page": page,
                               "type_filter_text": tft})
    return out.withColumns({"error": F.when(F.col("query") == "", F.lit("query is required")),
                            "k": candidate_k(F.col("per_page"), F.col("page"), cfg)})


def candidate_k(per_page: Column, page: Column, cfg: SearchConfig = DEFAULT) -> Column:
    """V2: min(1000, max(perPage·page·(5 if page = 1 else 3), perPage·5))."""
    mult = F.when(page == 1, F.lit(cfg.first_page_multiplier)).otherwise(F.lit(cfg.later_page_multiplier))
    return F.least(F.lit(cfg.max_top_k).cast("long"),
                   F.greatest(per_page * page * mult, per_page * cfg.first_page_multiplier)).cast("long")


# --------------------------------------------------------------------------- V3

def type_allowed(types: Column, vtype: Column) -> Column:
    """V3: exact, case-sensitive type membership; an empty or missing list allows all."""
    return types.isNull() | (F.size(types) == 0) | F.coalesce(F.array_contains(types, vtype), F.lit(False))


def filter_types(pairs: DataFrame, types_col: str = "types", type_col: str = "type") -> DataFrame:
    return pairs.filter(type_allowed(F.col(types_col), F.col(type_col)))


def allowed_rows(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """V3 for whole tables: every row (``type`` among its columns) with every query (``query_id, types``) that allows it.

    Queries with a list meet the rows in an equi-join on the type, so a table
    laid out by type (:func:`write_by_type`) is read only where a list points;
    the others meet all rows. Rows of a type are dealt to as many groups as
    there are shuffle partitions, and queries to all groups, so that a frequent
    type is spread. Queries travel as lists of ids, which are spread out only
    after the join. The folders are chosen by the types that lists name, few or
    many, before the lists themselves are met.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_g", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(LISTS)))
    some = F.coalesce(F.size("types"), F.lit(0)) > 0

    def lists(asked: DataFrame, *by: str) -> DataFrame:
        packed = asked.groupBy(*by, "_b").agg(F.collect_list(F.struct("query_id")).alias("_q"))
        return packed.select(*by, "_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_g"))

    listed = lists(numbered.filter(some).withColumn("type", F.explode(F.array_distinct("types"))), "type")
    unlisted = lists(numbered.filter(~some))
    # merge joins: the size that Spark sees of dealt lists is that of one copy, and all copies would go through the driver;
    # the pairs are many more than either side, so the groups stay apart
    typed = dealt.join(numbered.filter(some).select(F.explode("types").alias("type")).distinct(), "type", "left_semi")
    met = (listed.hint("merge").join(typed.repartition(n, "type", "_g"), ["type", "_g"]).select("_q", *rows.columns)
           .unionByName(unlisted.hint("merge").join(dealt.repartition(n, "_g"), "_g").select("_q", *rows.columns)))
    return met.select(F.explode("_q").alias("_q"), *rows.columns).select(F.col("_q.query_id").alias("query_id"), *rows.columns)


def write_by_type(vectors: DataFrame, path: str) -> None:
    """Vector records as one folder per type, in which readers skip the types that no list names."""
    vectors.repartition("type", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("type").parquet(path)


def with_norm(vectors: DataFrame, vec_col: str = "vector") -> DataFrame:
    if "norm" in vectors.columns:
        return vectors
    return vectors.withColumn("norm", l2_norm(vec_col))


# --------------------------------------------------------------------------- V4

def vector_topk(vectors: DataFrame, queries: DataFrame, cfg: SearchConfig = DEFAULT, with_meta: bool = True) -> DataFrame:
    """V4: best ``k`` vectors per query by cosine, type filter before ranking.

    ``vectors``: ``id, vector`` plus ``type`` and metadata (and ``norm`` where
    it is stored). ``queries``: ``query_id, qvec, k`` and optionally ``types``;
    ids may have any orderable type. Returns ``query_id, id, score`` (+
    metadata, rows with a null or empty url dropped after the top-k). Ties go
    to the smaller id.
    """
    # a record without a usable vector is not an index entry
    vecs = with_norm(vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)))
    types = F.col("types") if "types" in queries.columns else F.lit(None).cast("array<string>")
    q = queries.select("query_id", "qvec", F.col("k").cast("int").alias("k"), types.alias("types")).filter(F.size("qvec") > 0)
    groups = _groups(vecs.sparkSession)
    rows, asked = vecs.select("id", "vector", "norm", "type"), q.withColumn("qnorm", l2_norm("qvec"))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0).hint("rebalance")  # few full tiles, not a part of one from every partition
    least = _least_scores(_best_of_groups(some, asked, FIRST_GROUPS, max(1, groups // FIRST_GROUPS), cfg))
    scored = _best_of_groups(rows, asked.join(least, "query_id", "left"), groups, 1, cfg)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    top = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("k")).select("query_id", "id", "score")
    return with_metadata(top, vectors) if with_meta else top


def with_metadata(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """Winners (``id`` and any other columns) with their metadata; rows with a null or empty url go."""
    feats = [c for c in vectors.columns if c.startswith("f_")]  # per-document match inputs, if stored
    meta = vectors.select("id", *META_COLS, *feats)
    return meta.join(top, "id", "inner").filter(F.col("url") != "")


def _groups(spark: SparkSession) -> int:
    """Groups that tiles are dealt to: some for every core, no more than there are shuffle partitions."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUPS * spark.sparkContext.defaultParallelism)


def _best_of_groups(rows: DataFrame, asked: DataFrame, row_groups: int, query_groups: int, cfg: SearchConfig) -> DataFrame:
    """query_id, k, id, score: the best rows of each query (those that reach its ``least``, if given) in each group of rows."""
    id_type, query_type = rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    kept = {"query_id": query_type, "qnorm": "double", "k": "int", "types": "array<string>"} | ({"least": "double"} if "least" in asked.columns else {})

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = (_tiles(rows, "vector", cfg.tile_bytes, {"id": id_type, "norm": "double", "type": "string"})
            .withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(row_groups))).withColumn("qg", every(query_groups)))
    right = (_tiles(asked, "qvec", cfg.tile_bytes // 4, kept).withColumnRenamed("tile", "qtile")
             .withColumn("qg", F.pmod(F.xxhash64("qtile"), F.lit(query_groups))).withColumn("g", every(row_groups)))
    # a merge join: the size that Spark sees of dealt tiles is that of one copy, and all copies would go through the driver;
    # a task holds the rows of its group and takes one tile of queries after the other
    return (right.hint("merge").join(left, ["g", "qg"]).select("id", "vector", "norm", "type", "qvec", *kept)
            .mapInArrow(_best_of_task, f"query_id {query_type}, k int, id {id_type}, score double"))


def _least_scores(scored: DataFrame) -> DataFrame:
    """query_id, least: the k-th score of every query that has k rows; rows below it are not among its best, whatever rows are added."""
    of = Window.partitionBy("query_id")
    ranked = scored.withColumns({"_n": F.row_number().over(of.orderBy(F.col("score").desc())), "_k": F.max("k").over(of)})
    return ranked.filter(F.col("_n") == F.col("_k")).select("query_id", (F.col("score") - F.lit(SURE)).alias("least"))


def _tiles(df: DataFrame, vec_col: str, limit: int, keep: dict[str, str]) -> DataFrame:
    """Rows packed by the thousands: ``tile`` (a number), the vectors as one flat matrix, the other columns as arrays."""
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.filter(pc.is_valid(b.column(vec_col)))
            lo = 0
            while lo < b.num_rows:
                dim = len(b.column(vec_col)[lo])
                rows = max(1, limit // (8 * dim))
                tile = b.slice(lo, rows)
                flat = tile.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                lo += rows
                cols = {"tile": pa.array([part << 32 | n], pa.int64()), vec_col: pa.array([flat.tobytes()], pa.binary())}
                for c in keep:
                    values = tile.column(c)
                    cols[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.record_batch(cols)
                n += 1
    schema = f"tile long, {vec_col} binary, " + ", ".join(f"{c} array<{t}>" for c, t in keep.items())
    return df.mapInArrow(run, schema)


def _best_of_task(batches):
    """The k best rows of every query over a task's tiles; passed on early where they would be more than ``HELD``."""
    held, n = [], 0
    for part in _best_of_tiles(batches):
        held.append(part)
        n += part.num_rows
        if n > HELD:
            held = [_best_rows(held)]
            n = held[0].num_rows
            if n > HELD // 2:
                yield held.pop()
                n = 0
    if held:
        yield _best_rows(held)


def _best_rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The k best of each query's rows, ties to the smaller id."""
    t = pa.Table.from_batches(parts).combine_chunks()
    t = t.take(pc.sort_indices(t, sort_keys=[("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]))
    query = t.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.arange(len(query))
    first = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], at, 0))
    return t.filter(pa.array(at - first < t.column("k").to_numpy())).combine_chunks().to_batches()[0]


def _best_of_tiles(batches):
    """For each pair of tiles: the k best allowed rows of every query (of those marked in ``wanted``, if given), ties to the smaller id."""
    for b in batches:
        for r in range(b.num_rows):
            row = {c: b.column(c)[r] for c in b.schema.names}
            ids, queries = row["id"].values, row["query_id"].values
            k = row["k"].values.to_numpy()
            mat = np.frombuffer(row["vector"].as_py(), np.float64).reshape(len(ids), -1)
            qmat = np.frombuffer(row["qvec"].as_py(), np.float64).reshape(len(queries), -1)
            by_id = pc.sort_indices(ids).to_numpy()  # so that the column number breaks ties
            ids, mat = ids.take(pa.array(by_id)), mat[by_id]
            norm = row["norm"].values.to_numpy(zero_copy_only=False)[by_id]
            qnorm = row["qnorm"].values.to_numpy(zero_copy_only=False)
            least = row["least"].values.fill_null(-np.inf).to_numpy(zero_copy_only=False) if "least" in row else np.full(len(queries), -np.inf)
            least = np.maximum(least, np.finfo(np.float64).min)  # above the score of a row that is not allowed
            table, which, kind = _allowed(row["types"].values, row["type"].values.take(pa.array(by_id)))
            if "wanted" in row:
                asked = np.flatnonzero(np.unpackbits(np.frombuffer(row["wanted"].as_py(), np.uint8), count=len(queries)))
                queries, k, qmat, qnorm, least, which = queries.take(pa.array(asked)), k[asked], qmat[asked], qnorm[asked], least[asked], which[asked]
            step = max(1, SCORES // max(1, len(ids)))
            for lo in range(0, len(queries), step):
                own = slice(lo, lo + step)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (qmat[own] @ mat.T) / np.outer(qnorm[own], norm)
                s[~np.isfinite(s)] = 0.0
                if not table.all():
                    s[~table[which[own]][:, kind]] = -np.inf
                most = min(int(k[own].max(initial=0)), len(ids))
                if most < 1:
                    continue
                hit = s >= least[own, None]
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > most)
                if len(many):
                    part = s[many]
                    hit[many] &= part >= np.partition(part, len(ids) - most, axis=1)[:, len(ids) - most, None]
                qi, ci = np.nonzero(hit)
                score = s[qi, ci]
                order = np.lexsort((ci, -score, qi))
                qi, ci, score = qi[order], ci[order], score[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                win = place < k[own][qi]
                qi, ci, score = qi[win], ci[win], score[win]
                yield pa.record_batch({"query_id": queries.take(pa.array(qi + lo)), "k": pa.array(k[own][qi].astype(np.int32)),
                                       "id": ids.take(pa.array(ci)), "score": pa.array(score)})


def _allowed(types: pa.Array, kind: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V3 for a pair of tiles: which type (column) each distinct list (row) allows, each query's list, each row's type."""
    code = kind.dictionary_encode()
    names = code.dictionary.to_pylist()
    rows = code.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = [tuple(t) if t else () for t in types.to_pylist()]
    distinct = {t: i for i, t in enumerate(dict.fromkeys(lists))}
    table = np.zeros((len(distinct), len(names) + 1), bool)
    for t, i in distinct.items():
        table[i] = [not t or n in t for n in names] + [not t]
    return table, np.array([distinct[t] for t in lists], np.int64), rows
