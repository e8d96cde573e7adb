"""Dense numbers in a total order, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.session import checkpoint_dir


def dense_ids(df: DataFrame, order_cols: list[str], base: Column, out_col: str = "id") -> DataFrame:
    """Number rows 1.. in the order of ``order_cols``, plus ``base`` (an expression over ``df``).

    ``order_cols`` must be unique together and should be narrow, as ``df``
    should be: the rows are range-partitioned, sorted and written once with
    ``checkpoint()`` together with their partition number and place. Counts and
    numbers are both taken from those written rows, so no partition is planned
    or sampled a second time, whatever the size or the adaptive settings.
    """
    checkpoint_dir(df.sparkSession)
    ordered = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
                 .drop("_mid").checkpoint())
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    return (ordered.join(F.broadcast(offsets), "_pid")
                   .withColumn(out_col, base + F.col("_off") + F.col("_local") + 1)
                   .drop("_pid", "_local", "_off"))
