"""What a cube holds: counts, lists and histograms, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube, no_error


def scores_by_config(cube: Cube, model: str, scorer: str, dataset: str = "", query_ids: list[str] | None = None) -> DataFrame:
    """n, mean, least and greatest score of each configuration; zeros of errors count."""
    rows = cube.all_scores(model, scorer).select("config_id", "query_id", "score")
    if query_ids is not None:
        rows = rows.where(F.col("query_id").isin(query_ids)) if query_ids else rows.limit(0)
    if dataset:
        rows = rows.join(cube.query.where(F.col("dataset") == dataset).select("query_id"), "query_id", "left_semi")
    return rows.groupBy("config_id").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def stats(cube: Cube) -> DataFrame:
    names = {"func": cube.func, "query": cube.query, "config": cube.config, "execution": cube.execution, "evaluation": cube.evaluation, "predicate": cube.predicate}
    out = None
    for name, frame in names.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def config_progress(cube: Cube, model: str) -> DataFrame:
    """done, total and remaining queries of every configuration."""
    done = cube.execution.where(F.col("model") == model).groupBy("config_id").agg(F.count_distinct("query_id").alias("done"))
    total = cube.query.agg(F.count("*").alias("total"))
    both = cube.config.select("config_id").join(done, "config_id", "left").join(F.broadcast(total))
    return both.select("config_id", F.coalesce("done", F.lit(0)).alias("done"), "total", (F.col("total") - F.coalesce("done", F.lit(0))).alias("remaining"))


def list_models(cube: Cube) -> DataFrame:
    return cube.execution.groupBy("model").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def list_scorers(cube: Cube) -> DataFrame:
    return cube.evaluation.groupBy("scorer").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def list_phases(cube: Cube) -> DataFrame:
    tags = cube.execution.select(F.explode("phase_ids").alias("phase"), "created_at", "model")
    return tags.groupBy("phase").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.array_sort(F.collect_set("model")).alias("models"))


def list_datasets(cube: Cube) -> DataFrame:
    """Queries of each dataset, in total and by split."""
    by_split = cube.query.groupBy("dataset", F.coalesce("split", F.lit("")).alias("split")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("split", "n")))
    return by_split.groupBy("dataset").agg(F.sum("n").alias("n_queries"), F.map_from_entries(pairs).alias("splits"))


def list_predicates(cube: Cube) -> DataFrame:
    return cube.predicate.groupBy("name").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("query_id").alias("n_queries"))


def list_features(cube: Cube, task: str | None = None) -> DataFrame:
    out = cube.feature if task is None else cube.feature.where(F.col("task") == task)
    return out.select("feature_id", "canonical_id", "task", "func_ids")


def list_configs(cube: Cube) -> DataFrame:
    return cube.config.select("config_id", "kind", "canonical_id", "func_ids", F.size("func_ids").alias("n_funcs"))


def list_configs_with_features(cube: Cube) -> DataFrame:
    """Configurations with their features' names, in the order that they are listed in."""
    at = cube.config.select("config_id", F.posexplode_outer("feature_ids").alias("at", "feature_id"))
    named = at.join(cube.feature.select("feature_id", "canonical_id"), "feature_id", "left")
    name = F.coalesce("canonical_id", F.when(F.col("feature_id").isNotNull(), F.concat(F.lit("<unknown:"), "feature_id", F.lit(">"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("feature_id").isNotNull(), F.struct("at", name.alias("name")))))
    return named.groupBy("config_id").agg(F.transform(listed, lambda x: x["name"]).alias("features"))


def list_configs_with_func_types(cube: Cube) -> DataFrame:
    """How many funcs of each type a configuration has."""
    each = cube.config.select("config_id", F.explode("func_ids").alias("func_id")).join(cube.func.select("func_id", "func_type"), "func_id")
    return each.groupBy("config_id", "func_type").agg(F.count("*").alias("n"))


def summary(cube: Cube) -> dict[str, DataFrame]:
    return {"stats": stats(cube), "models": list_models(cube), "scorers": list_scorers(cube), "phases": list_phases(cube), "datasets": list_datasets(cube), "predicates": list_predicates(cube)}


def uncached(cube: Cube, config_id: int, model: str) -> DataFrame:
    """Queries that a configuration has not been run on yet."""
    done = cube.execution.where((F.col("config_id") == config_id) & (F.col("model") == model)).select("query_id")
    return cube.query.select("query_id").join(done, "query_id", "left_anti")


def unevaluated(cube: Cube, scorer: str) -> DataFrame:
    """Executions that a scorer has not seen."""
    return cube.execution.join(cube.evaluation.where(F.col("scorer") == scorer), "execution_id", "left_anti").select("execution_id", "config_id", "query_id", "model")


def progress_by_config(cube: Cube, scorer: str, total: int) -> DataFrame:
    """done, share, errors and mean score of each configuration and model."""
    scores = cube.evaluation.where(F.col("scorer") == scorer).select("execution_id", "score")
    rows = cube.execution.join(scores, "execution_id", "left")
    return rows.groupBy("config_id", "model").agg(
        F.count("*").alias("done"), F.try_divide(100.0 * F.count("*"), F.lit(total)).alias("pct"), F.count_if(~no_error()).alias("errors"), F.avg("score").alias("avg_score")
    )


def per_query_scores(cube: Cube, config_id: int, predicate: str, model: str, scorer: str) -> DataFrame:
    """``predicate_value, query_id, score`` of one configuration: what a paired comparison is made of.

    One row for each query and value; of several scores the one of the latest execution counts.
    """
    rows = cube.all_scores(model, scorer).where((F.col("config_id") == config_id) & F.col("score").isNotNull() & (F.coalesce("error", F.lit("")) == ""))
    values = cube.predicate.where(F.col("name") == predicate).select("query_id", F.col("value").alias("predicate_value"))
    return rows.join(values, "query_id").groupBy("predicate_value", "query_id").agg(F.max_by("score", "execution_id").alias("score"))


def samples_per_group(rows: DataFrame, group_by: list[str], n: int, order: str) -> DataFrame:
    """The first n rows of each group, with ``group_key`` and ``place``; empty values are 'unknown', and without fields all rows are one group."""
    parts = [F.concat(F.lit(f"{g}="), F.coalesce(F.nullif(F.col(f"`{g}`").cast("string"), F.lit("")), F.lit("unknown"))) for g in group_by]
    keyed = rows.withColumn("group_key", F.concat_ws("__", *parts) if parts else F.lit("all"))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("group_key").orderBy(order))).where(F.col("place") <= n)
