"""Paired comparison of configurations on the queries that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cube import Cube


def _arm(cube: Cube, config_id: int, model: str, scorer: str) -> DataFrame:
    return cube.query_scores(model, scorer).where(F.col("config_id") == config_id).select("query_id", "score")


def score_diff(cube: Cube, config_a: int, config_b: int, model: str, scorer: str) -> DataFrame:
    """One row: sizes, means and mean difference over shared queries, and the numbers of flips.

    Both arms come from one scan and one aggregation by query, not from a
    self-join.
    """
    rows = cube.query_scores(model, scorer).where(F.col("config_id").isin(config_a, config_b))
    pairs = rows.groupBy("query_id").agg(F.max(F.when(F.col("config_id") == config_a, F.col("score"))).alias("a"), F.max(F.when(F.col("config_id") == config_b, F.col("score"))).alias("b"))
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.agg(
        F.count("a").alias("n_a"),
        F.count("b").alias("n_b"),
        F.count_if(shared).alias("n_shared"),
        zero(F.avg(F.when(shared, F.col("a")))).alias("avg_a"),
        zero(F.avg(F.when(shared, F.col("b")))).alias("avg_b"),
        zero(F.avg(F.when(shared, F.col("b") - F.col("a")))).alias("avg_delta"),
        F.count_if(shared & (F.col("b") > F.col("a"))).alias("n_up"),
        F.count_if(shared & (F.col("b") < F.col("a"))).alias("n_down"),
        F.count_if(shared & (F.col("b") == F.col("a"))).alias("n_agree"),
    )


def flips(cube: Cube, base: int, targets: list[int], model: str, scorer: str) -> DataFrame:
    """Queries whose score differs from the base, for many targets in one join; direction up or down."""
    rows = cube.query_scores(model, scorer)
    a = rows.where(F.col("config_id") == base).select("query_id", F.col("score").alias("base_score"))
    b = rows.where(F.col("config_id").isin(targets)).select("query_id", F.col("config_id").alias("target_config_id"), F.col("score").alias("target_score"))
    both = a.join(b, "query_id").where("base_score <> target_score")
    return both.select("target_config_id", "query_id", "base_score", "target_score", F.when(F.col("target_score") > F.col("base_score"), "up").otherwise("down").alias("direction"))


def flip_rows(cube: Cube, base: int, target: int, model: str, scorer: str, direction: str | None = None) -> DataFrame:
    """Flips with the text of the query and both predictions."""
    out = flips(cube, base, [target], model, scorer)
    if direction is not None:
        out = out.where(F.col("direction") == direction)
    said = cube.execution.where((F.col("model") == model) & F.col("config_id").isin(base, target)).groupBy("query_id").agg(
        F.max(F.when(F.col("config_id") == base, F.col("prediction"))).alias("base_prediction"), F.max(F.when(F.col("config_id") == target, F.col("prediction"))).alias("target_prediction")
    )
    return out.join(said, "query_id").join(cube.query.select("query_id", "dataset"), "query_id", "left")


def harm_cases(cube: Cube, base: int, target: int, model: str, scorer: str) -> DataFrame:
    return flip_rows(cube, base, target, model, scorer, "down")


def help_cases(cube: Cube, base: int, target: int, model: str, scorer: str) -> DataFrame:
    return flip_rows(cube, base, target, model, scorer, "up")


def add_one_deltas(cube: Cube, base: int, model: str, scorer: str, candidates: list[int] | None = None, exclude: tuple[int, ...] = (), kind: str | None = "add_one_feature") -> DataFrame:
    """Mean paired difference of every candidate from the base; candidates without a shared query have 0 of 0."""
    who = cube.config.where(F.col("config_id") != base)
    if candidates is not None:
        who = who.where(F.col("config_id").isin(candidates))
    elif kind is not None:
        who = who.where(F.col("kind") == kind)
    who = who.where(~F.col("config_id").isin(list(exclude))) if exclude else who
    rows = cube.query_scores(model, scorer)
    a = rows.where(F.col("config_id") == base).select("query_id", F.col("score").alias("base_score"))
    paired = rows.join(who.select("config_id"), "config_id").join(a, "query_id").withColumn("delta", F.col("score") - F.col("base_score"))
    found = paired.groupBy("config_id").agg(F.count("*").alias("n_shared"), F.avg("delta").alias("avg_delta"), F.count_if(F.col("delta") > 0).alias("n_up"), F.count_if(F.col("delta") < 0).alias("n_down"))
    out = who.select("config_id", "canonical_id").join(found, "config_id", "left")
    return out.select("config_id", "canonical_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_shared", "avg_delta", "n_up", "n_down"))).orderBy(F.desc("avg_delta"), "config_id")


def feature_effect_ranking(cube: Cube, model: str, scorer: str, task: str | None = None) -> DataFrame:
    rows = cube.feature_effect().where((F.col("model") == model) & (F.col("scorer") == scorer))
    if task is not None:
        rows = rows.where(F.col("task") == task)
    return rows.groupBy("canonical_id").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n")).orderBy(F.desc("avg_score"), "canonical_id")


def predicate_slice(cube: Cube, model: str, scorer: str, predicate: str, config_ids: list[int] | None = None) -> DataFrame:
    out = cube.per_config_predicate_means(model, scorer, predicate)
    return out.where(F.col("config_id").isin(config_ids)) if config_ids else out


def write_flips(found: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Write flips as JSON lines or CSV, a file a partition."""
    if fmt not in ("jsonl", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    (found.write.mode("overwrite").json(path) if fmt == "jsonl" else found.write.mode("overwrite").option("header", True).csv(path))
