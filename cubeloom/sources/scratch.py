"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a local folder in local mode only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="cubeloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/cubeloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table that was written and is read again; its lineage ends there."""
    spark = df.sparkSession
    path = path or fresh_path(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
