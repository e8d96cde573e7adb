"""Aggregates and facets over the registry: A1–A5.

All are single-pass aggregations with map-side partial aggregation; the
outputs are tiny (one row, or one row per distinct type / upload).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekrank.config import STATUS_COMPLETED, STATUS_FAILED, STATUS_PENDING
from seekrank.operators.ingest import validate_url_rows


def status_counts(registry: DataFrame) -> DataFrame:
    """A1: pending, completed, failed (0 if absent) and the total over all statuses."""
    s = F.col("status")
    return registry.agg(
        F.count_if(s == STATUS_PENDING).alias("pending"),
        F.count_if(s == STATUS_COMPLETED).alias("completed"),
        F.count_if(s == STATUS_FAILED).alias("failed"),
        F.count(F.lit(1)).alias("total"))


def distinct_types(registry: DataFrame) -> DataFrame:
    """A2: distinct types, ascending."""
    return registry.select("type").distinct().orderBy("type")


def suggest_types(types: DataFrame, texts: DataFrame, n: int = 20) -> DataFrame:
    """A3: per text, the first ``n`` types (ascending) that contain it, case-insensitively.

    ``types`` is the (small, distinct) A2 output; ``texts`` has ``text_id, text``.
    """
    j = texts.join(types, F.lower(F.col("type")).contains(F.lower(F.col("text"))), "inner")
    w = Window.partitionBy("text_id").orderBy("type")
    return j.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def recent_urls(registry: DataFrame, n: int = 10) -> DataFrame:
    """A4: newest completed rows by created_at (nulls last, then id)."""
    return (registry.filter(F.col("status") == STATUS_COMPLETED)
                    .orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))
                    .limit(n)
                    .select("id", "url", "title", "type", F.col("updated_at").alias("updated_at")))


def ingest_progress(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """A5: per upload — uploaded rows, completed/failed/pending URLs, percent, done."""
    valid = validate_url_rows(rows)
    uploaded = valid.groupBy("upload_id").agg(F.count(F.lit(1)).alias("uploaded"))
    urls = valid.select("upload_id", "url").distinct()
    st = urls.join(registry.select("url", "status"), "url", "left").groupBy("upload_id").agg(
        F.count_if(F.col("status") == STATUS_COMPLETED).alias("completed"),
        F.count_if(F.col("status") == STATUS_FAILED).alias("failed"),
        F.count_if(F.col("status") == STATUS_PENDING).alias("pending"))
    j = uploaded.join(st, "upload_id", "left")
    pct = F.when(F.col("uploaded") > 0,
                 F.least(F.lit(100.0), F.col("completed").cast("double") / F.col("uploaded") * F.lit(100.0))) \
        .otherwise(F.lit(0.0))
    return j.select("upload_id", "uploaded", "completed", "failed", "pending",
                    pct.alias("percent"), (F.col("pending") == 0).alias("done"))
