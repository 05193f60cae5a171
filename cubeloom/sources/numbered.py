"""Line numbers of large text files.

A file is cut into splits, which are read by different tasks.  A line's number
is its place in its split, and the number of lines in the splits before it; the
latter is a sum over one row for each split.  So the numbers are the same
however the file is cut, and no task sees more than its splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """``path, line, value`` of text files, lines counted from 1 in each file, or ``across`` all files in the order of their paths."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("path", "start") if across else Window.partitionBy("path").orderBy("start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.withColumn("before", before), ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")
