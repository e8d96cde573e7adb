"""S1 upload stream and S2 processing stream (Structured Streaming).

S1: CSV files dropped into a folder are read as byte ranges (I1: any header
order, BOM, quoted newlines), validated (I3) and upserted into the versioned
registry (I4) in ``foreachBatch``. The report of every file, rejected ones
included, is written per batch.

S2: work items (I5 output) arriving as Parquet files go through page lookup,
placeholder, extraction, shaping and embedding (I6–I10), then the vector store
(I12) and the registry (I11) are committed under the batch's version, vectors
first. Per batch one metrics row counts completed, failed and synced rows, and
a problems table lists embedding errors and URLs outside the registry.

Both are replay-safe: batch ``n`` always reads the state *before* version ``n``
and writes version ``n``, changed rows only. A stream's checkpoint must be a
durable folder that outlives the application; there is no default.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.operators.embed import HashedBow, embed
from seekrank.operators.ingest import (apply_results, empty_registry, empty_vectors, extract_fetched, fetch_pages,
                                       shape_content, upload_report, upsert_urls_changes, validate_url_rows,
                                       vector_changes, vector_records)
from seekrank.sources.csv_urls import read_upload_payloads, read_url_csv
from seekrank.streaming import snapshots

WORK_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("type", T.StringType()),
                            T.StructField("row_no", T.LongType())])
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _durable(checkpoint: str | None) -> str:
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder of its own that outlives the application")
    return checkpoint


def store_rows(spark: SparkSession, rows: DataFrame, batch_id: int, registry_root: str, now, report_path: str | None = None) -> None:
    """Rows of a batch of uploads (I1 or I2) → report (I3) → registry (I4), committed as version ``batch_id``."""
    rows = rows.persist()
    current = snapshots.read_latest(spark, registry_root, empty_registry(spark), "url", before=batch_id)
    changed = upsert_urls_changes(current, order_rows(rows.filter(F.col("error").isNull())), now, snapshots.largest_id(spark, registry_root, before=batch_id))
    snapshots.commit(spark, registry_root, changed, "url", batch_id, batch_id)
    if report_path:
        upload_report(rows).write.mode("overwrite").parquet(f"{report_path.rstrip('/')}/batch_id={batch_id}")
    rows.unpersist()


def upload_batch(spark: SparkSession, payloads: DataFrame, batch_id: int, registry_root: str, now,
                 report_path: str | None = None) -> None:
    """One S1 micro-batch of payloads."""
    store_rows(spark, read_upload_payloads(payloads), batch_id, registry_root, now, report_path)


def stream_uploads(spark: SparkSession, in_dir: str, registry_root: str, clock, checkpoint: str | None = None,
                   trigger: dict | None = None, report_path: str | None = None):
    """Start the upload stream; ``clock(batch_id)`` gives the batch's timestamp.

    The stream carries the names of new files; a batch reads its files as byte
    ranges (I1), so one large file is read by many tasks.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(in_dir).select("path")

    def per_batch(batch: DataFrame, batch_id: int):
        paths = [r["path"] for r in batch.collect()]  # the batch's file list, which the driver has made
        if paths:
            store_rows(spark, read_url_csv(spark, paths), batch_id, registry_root, clock(batch_id), report_path)

    return (files.writeStream.foreachBatch(per_batch).option("checkpointLocation", _durable(checkpoint))
                 .trigger(**(trigger or {"availableNow": True})).start())


def order_rows(rows: DataFrame) -> DataFrame:
    """One total row order over the files of a batch: (file, row within file), as dense numbers."""
    from seekrank.operators.numbering import dense_ids
    ordered = dense_ids(rows.withColumnRenamed("row_no", "_in_file"), ["upload_id", "_in_file"], F.lit(0), "row_no")
    return ordered.drop("_in_file")


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, pages: DataFrame, registry_root: str,
                  vectors_root: str, metrics_path: str, now, embedder=HashedBow(64), fallback=None,
                  mode: str = "basic") -> None:
    """One S2 micro-batch: I6–I12 on the queued URLs, then versioned commits (vectors first).

    A URL queued more than once takes the type queued last (``row_no``). A page
    whose embedding fails is completed without a vector, as the rule has it.
    """
    order = F.struct("row_no", "type") if "row_no" in batch.columns else F.struct("type")
    items = batch.groupBy("url").agg(F.max_by("type", order).alias("type"))
    shaped = shape_content(extract_fetched(fetch_pages(items, pages), mode))
    done = (embed(shaped, "embed_text", embedder, fallback).withColumnRenamed("error", "embed_error")
            .withColumn("error", F.lit(None).cast("string")).persist())
    registry = snapshots.read_latest(spark, registry_root, empty_registry(spark), "url", before=batch_id)
    changed = apply_results(registry.join(items.select("url"), "url", "left_semi"), done, now)
    records, missing = vector_records(done, changed)
    snapshots.commit(spark, vectors_root, vector_changes(records), "id", batch_id, batch_id)
    snapshots.commit(spark, registry_root, changed, "url", batch_id, batch_id)
    known = changed.select("url", F.lit(True).alias("_known"))
    m = done.join(known, "url", "left").agg(
        F.count_if(F.col("_known") & F.col("error").isNull()).alias("completed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("_known") & F.col("vector").isNotNull()).alias("vector_synced"))
    (m.select(F.lit(batch_id).cast("long").alias("batch_id"), "*").write.mode("overwrite")
      .parquet(f"{metrics_path.rstrip('/')}/batch_id={batch_id}"))
    problems = (done.filter(F.col("embed_error").isNotNull()).select("url", "provider", F.col("embed_error").alias("problem"))
                .unionByName(done.join(known, "url", "left_anti").select("url", "provider", F.lit("Failed to find URL in database").alias("problem"))))
    problems.write.mode("overwrite").parquet(f"{metrics_path.rstrip('/')}-problems/batch_id={batch_id}")
    done.unpersist()


def stream_process(spark: SparkSession, work_dir: str, pages: DataFrame, registry_root: str, vectors_root: str,
                   metrics_path: str, clock, embedder=HashedBow(64), checkpoint: str | None = None,
                   trigger: dict | None = None, fallback=None, mode: str = "basic"):
    """Process queued work items per micro-batch; keyed upserts make replays harmless."""
    work = spark.readStream.schema(WORK_SCHEMA).parquet(work_dir)

    def per_batch(batch: DataFrame, batch_id: int):
        process_batch(spark, batch, batch_id, pages, registry_root, vectors_root, metrics_path,
                      clock(batch_id), embedder, fallback, mode)

    return (work.writeStream.foreachBatch(per_batch).option("checkpointLocation", _durable(checkpoint))
                .trigger(**(trigger or {"availableNow": True})).start())


def encode_csv(text: str) -> str:
    return base64.b64encode(text.encode("utf-8")).decode("ascii")


__all__ = ["stream_uploads", "stream_process", "upload_batch", "process_batch", "encode_csv", "validate_url_rows"]
