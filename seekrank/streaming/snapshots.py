"""Versioned keyed tables in hash buckets, without MERGE: changed rows per version, merged on read.

A table is a folder with its rows (``data``, one sub-folder per committed
version, every version in ``BUCKETS`` hash buckets of the key) and a tiny
manifest (one row per commit, with the largest id stored so far). It is known
to the session's catalog as a bucketed table, so a join or a window on the key
reads it bucket by bucket: the base is never exchanged. Point lookups
(:func:`find_keys`) read the buckets of their keys only, and the Bloom filters
of the key column let Parquet skip the row groups that can't hold them.

A commit writes only the rows that changed; a read takes the newest full version
and replaces the keys that later versions changed. Every ``COMPACT_EVERY``-th
commit writes a full version, so a small batch costs its own size and reads stay
short.

A replayed batch writes the same version again (overwrite of that version only,
never of one being read). Versions only grow: writing below the newest one is
refused, so a stream that lost its checkpoint stops instead of going back.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT_EVERY = 16
#: Hash buckets of a new table; an existing one keeps its number, which the manifest holds.
BUCKETS = 16
MANIFEST_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()),
                                T.StructField("full", T.BooleanType()), T.StructField("max_id", T.LongType()), T.StructField("buckets", T.IntegerType())])
VERSION = "_table_version"


def _manifest(root: str) -> str:
    return f"{root.rstrip('/')}/_manifest"


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest; None only where there is none. Any other read error is raised: it must not look like an empty table."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(_manifest(root))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def versions(spark: SparkSession, root: str, before: int | None = None) -> list[tuple[int, bool]]:
    """Committed (version, full) pairs from the newest full one on."""
    m = _commits(spark, root)
    if m is None:
        return []
    if before is not None:
        m = m.filter(F.col("version") < before)
    last_full = m.filter("full").agg(F.max("version")).first()[0]
    rows = m.filter(F.col("version") >= last_full).select("version", "full").distinct().collect() if last_full is not None else []
    return sorted((int(r["version"]), bool(r["full"])) for r in rows)  # at most COMPACT_EVERY and replays


def latest_version(spark: SparkSession, root: str) -> int | None:
    found = versions(spark, root)
    return found[-1][0] if found else None


def largest_id(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The largest ``id`` that commits (before ``before``) have stored, from the manifest; 0 without any."""
    m = _commits(spark, root)
    if m is None:
        return 0
    return (m if before is None else m.filter(F.col("version") < before)).agg(F.max("max_id")).first()[0] or 0


def _table(spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int) -> str:
    """The catalog name of the table in ``root``, registered in this session where it isn't yet."""
    name = "versioned_" + hashlib.md5(root.rstrip("/").encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({cols}, `{VERSION}` BIGINT) USING parquet "
                  f"OPTIONS ('path' = '{root.rstrip('/')}/data', 'parquet.bloom.filter.enabled#{key}' = 'true') "
                  f"PARTITIONED BY (`{VERSION}`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS")
    return name


def _buckets(spark: SparkSession, root: str) -> int:
    m = _commits(spark, root)
    return (m.agg(F.max("buckets")).first()[0] if m is not None else None) or BUCKETS


def read_latest(spark: SparkSession, root: str, empty: DataFrame, key: str, before: int | None = None) -> DataFrame:
    """Latest committed state (strictly before version ``before`` if given), else ``empty``."""
    found = versions(spark, root, before)
    if not found:
        return empty
    name = _table(spark, root, empty.schema, key, _buckets(spark, root))
    known = {r[0].split("=")[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    if not all(str(v) in known for v, _ in found):  # committed by another application (or without rows)
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def load(v: int) -> DataFrame:
        return spark.table(name).filter(F.col(VERSION) == v).select(*empty.columns)
    base, changes = load(found[0][0]), None
    for v, _ in found[1:]:
        part = load(v).withColumn("_version", F.lit(v))
        changes = part if changes is None else changes.unionByName(part)
    if changes is None:
        return base
    newest = Window.partitionBy(key).orderBy(F.col("_version").desc())  # a key has one row per version
    changes = changes.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_version")
    return base.join(changes.select(key), key, "left_anti").select(*base.columns).unionByName(changes)


def find_keys(spark: SparkSession, root: str, empty: DataFrame, key: str, keys: list) -> DataFrame:
    """The latest rows of a few keys: their buckets only are read, and of these the row groups that may hold them."""
    return read_latest(spark, root, empty, key).filter(F.col(key).isin(keys))


def commit(spark: SparkSession, root: str, changed: DataFrame, key: str, version: int, batch_id: int) -> None:
    """Commit the changed rows (one per key) as ``version``; full every COMPACT_EVERY-th time and at first."""
    newest = latest_version(spark, root)
    if newest is not None and version < newest:
        raise ValueError(f"version {version} is older than the newest one, {newest}: the stream's checkpoint does not belong to {root}")
    found = versions(spark, root, before=version)
    full = not found or len(found) >= COMPACT_EVERY
    if full and found:
        old = read_latest(spark, root, spark.createDataFrame([], changed.schema), key, before=version)
        changed = old.join(changed.select(key), key, "left_anti").select(*changed.columns).unionByName(changed)
    buckets = _buckets(spark, root)
    name = _table(spark, root, changed.schema, key, buckets)
    mode, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(mode, "dynamic")  # a replay replaces its own version only
    try:
        changed.repartition(buckets, key).withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(name)
    if newest != version:
        stored = spark.table(name).filter(F.col(VERSION) == version)
        top = stored.agg(F.max("id")).first()[0] if dict(changed.dtypes).get("id") == "bigint" else None
        largest = max([x for x in (top, largest_id(spark, root, version)) if x is not None], default=None)
        spark.createDataFrame([(version, batch_id, full, largest, buckets)], MANIFEST_SCHEMA).write.mode("append").parquet(_manifest(root))
