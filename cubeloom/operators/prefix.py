"""Running numbers and sums over whole tables, without a window that gathers them in one task.

Rows are sorted by ranges; each partition is numbered and summed by itself, and
what stands before it is a sum over one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in order, written once so that every reader sees the same partitions."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def _parts(rows: DataFrame, *sums) -> DataFrame:
    return rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *sums)


def _before(size: str):
    """What the partitions before this one have; the window is over one row for each partition."""
    return F.coalesce(F.sum(size).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")


def numbered(df: DataFrame, order: list[str], into: str, start: int = 1) -> DataFrame:
    """``df`` with the place of each row in the order, from ``start``; ties by nothing but chance, and once."""
    rows = _sorted(df, order)
    parts = _parts(rows).select("_part", "_first", _before("_n"))
    return rows.join(parts, "_part").withColumn(into, (F.lit(start) + F.col("_at") - F.col("_first") + F.col("_offset")).cast("long")).drop("_part", "_at", "_first", "_offset")


def sum_before(df: DataFrame, order: list[str], size: str, into: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before each row in the order."""
    rows = _sorted(df, order)
    parts = _parts(rows, F.sum(size).alias("_sum")).select("_part", _before("_sum"))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(parts, "_part").withColumn(into, F.col("_own") + F.col("_offset")).drop("_part", "_at", "_own", "_offset")
