"""Running experiments: only what is not cached is asked, and only what is not scored is scored.

Model calls are an injected ``responder``; nothing here reaches a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cube import no_error
from .store import CubeStore, OnConflict

ERROR_CHARS = 500


def pending(plan: DataFrame, executions: DataFrame) -> DataFrame:
    """Plan rows (config_id, query_id, model) without an execution."""
    keys = ["config_id", "query_id", "model"]
    return plan.dropDuplicates(keys).join(executions.select(*keys), keys, "left_anti")


def respond(plan: DataFrame, responder: Callable[[dict], dict], parse: Callable[[str], str] | None = None) -> DataFrame:
    """Responses of a plan's rows, in batches on the executors; an exception becomes an error text."""
    names = plan.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                try:
                    said = responder(row)
                    raw = said.get("text")
                    out.append([*(row[n] for n in names), raw, parse(raw) if parse else raw, float(said.get("latency_ms", 0.0)), None])
                except Exception as e:  # noqa: BLE001  a failed call is a result
                    out.append([*(row[n] for n in names), None, None, None, str(e)[:ERROR_CHARS]])
            yield pd.DataFrame(out, columns=[*names, "raw_response", "prediction", "latency_ms", "error"])

    return plan.mapInPandas(run, f"{fields}, raw_response string, prediction string, latency_ms double, error string")


def run_plan(store: CubeStore, plan: DataFrame, responder, parse=None, phase: str | None = None) -> None:
    """Ask for what is missing and append it, tagged with the phase."""
    rows = respond(pending(plan, store.table("execution")), responder, parse)
    rows = rows.withColumn("phase_ids", F.array(F.lit(phase)) if phase else F.array().cast("array<string>")).withColumn("created_at", F.current_timestamp())
    store.merge("execution", store.next_ids("execution", "execution_id", rows, "query_id"), OnConflict.SKIP)


def evaluate(store: CubeStore, scorer: str, score, gold: DataFrame) -> None:
    """Score what the scorer has not seen; an execution with an error scores 0.  ``score`` makes a Column of (prediction, gold)."""
    seen = store.table("evaluation").where(F.col("scorer") == scorer)
    rows = store.table("execution").join(seen, "execution_id", "left_anti").join(gold, "query_id", "left")
    value = F.when(~no_error(), F.lit(0.0)).otherwise(score(F.col("prediction"), F.col("gold")))
    rows = rows.select("execution_id", F.lit(scorer).alias("scorer"), value.alias("score"), F.lit("{}").alias("metrics"), F.current_timestamp().alias("created_at"))
    store.merge("evaluation", store.next_ids("evaluation", "eval_id", rows, "execution_id"), OnConflict.SKIP)


def loop(store: CubeStore, first: DataFrame, responder, scorer: str, score, gold: DataFrame, analyze, iterations: int = 3) -> int:
    """Plan, run, evaluate, analyze; ``analyze(store)`` gives the next plan or None.  Returns the iterations done."""
    plan = first
    for i in range(iterations):
        run_plan(store, plan, responder, phase=f"iteration-{i}")
        evaluate(store, scorer, score, gold)
        plan = analyze(store)
        if plan is None:
            return i + 1
    return iterations
