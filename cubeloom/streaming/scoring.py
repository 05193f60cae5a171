"""Scoring executions as they arrive.

Executions come as a stream of files.  Each is scored against its gold answer
once, whatever is delivered twice and however often the stream is restarted:
the checkpoint says which files were read, and state keyed by execution, kept
as long as the watermark allows, says which executions were scored.  Scores
are appended to a table of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cube import no_error

EXECUTIONS = "execution_id long, config_id long, query_id string, model string, prediction string, error string, created_at timestamp"


def execution_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(EXECUTIONS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def scored(executions: DataFrame, gold: DataFrame, score: Callable[[Column, Column], Column], scorer: str, delay: str = "1 day") -> DataFrame:
    """``execution_id, scorer, score, created_at``; an execution with an error scores 0, and one without gold has no score.

    On a stream, an execution that comes again within ``delay`` of the first is
    left out, and so is one that comes later than that; in batch, equal ids
    count once.
    """
    once = executions.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["execution_id"]) if executions.isStreaming else executions.dropDuplicates(["execution_id"])
    value = F.when(~no_error(), F.lit(0.0)).otherwise(score(F.col("prediction"), F.col("gold")))
    return once.join(gold.select("query_id", "gold"), "query_id", "left").select("execution_id", F.lit(scorer).alias("scorer"), value.alias("score"), "created_at")


def run_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Score what has arrived, append it to ``out``, and stop; the next call goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
