"""Adaptive experiments: deltas by predicate, classification of edits, and the next queries to run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube
from .prefix import sum_before


def predicate_table(cube: Cube, names: list[str], dataset: str | None = None) -> DataFrame:
    """One row a query, predicates as columns, '' where missing."""
    rows = cube.query if dataset is None else cube.query.where(F.col("dataset") == dataset)
    wide = cube.predicate.where(F.col("name").isin(names)).groupBy("query_id").pivot("name", names).agg(F.first("value"))
    return rows.select("query_id").join(wide, "query_id", "left").select("query_id", *(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names))


def build_delta_table(cube: Cube, base: int, model: str, scorer: str, names: list[str]) -> DataFrame:
    """Every other configuration's score against the base's on the same query; zeros of errors count."""
    first = Window.partitionBy("config_id", "query_id").orderBy("execution_id")
    rows = cube.all_scores(model, scorer).where(F.col("score").isNotNull()).select("execution_id", "config_id", "query_id", "score").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    held = cube.config.where(F.col("config_id") == base).select(F.col("func_ids").alias("bf"))
    wider = cube.config.where(F.col("config_id") != base).join(F.broadcast(held)).where(F.size(F.array_except("bf", "func_ids")) == 0)
    primitives = wider.select("config_id", F.array_join(F.array_sort(F.array_except("func_ids", "bf")), "+").alias("primitive_id"))
    b = rows.where(F.col("config_id") == base).select("query_id", F.col("score").alias("baseline_score"))
    out = rows.join(primitives, "config_id").join(b, "query_id").select("query_id", "primitive_id", "config_id", "baseline_score", F.col("score").alias("primitive_score"), (F.col("score") - F.col("baseline_score")).alias("delta"))
    return out.join(predicate_table(cube, names), "query_id", "left") if names else out


def predicate_types(deltas: DataFrame, names: list[str]) -> DataFrame:
    """numerical: over eight distinct values, all numbers."""
    long = deltas.select("query_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("name", "value")).where("value <> ''")
    number = F.bool_and(F.expr("try_cast(value AS DOUBLE)").isNotNull())
    return long.groupBy("name").agg(F.when((F.count_distinct("value") > 8) & number, "numerical").otherwise("categorical").alias("type"))


def summarize_cells(deltas: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation, standard error and coverage of each (primitive, predicate, value) cell."""
    long = deltas.select("primitive_id", "query_id", "delta", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("predicate_name", "predicate_value")).where("predicate_value <> ''")
    totals = deltas.groupBy("primitive_id").agg(F.count("*").alias("n_total"))
    cells = long.groupBy("primitive_id", "predicate_name", "predicate_value").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("std"))
    se = F.when(F.col("n") > 1, F.col("std") / F.sqrt("n")).otherwise(F.lit(math.inf))
    return cells.join(totals, "primitive_id").select("primitive_id", "predicate_name", "predicate_value", "n", "mean", "std", se.alias("se"), (F.col("n") / F.col("n_total")).alias("coverage"))


def regressions(deltas: DataFrame, name: str, compat: bool = False) -> DataFrame:
    """OLS of delta on a numeric predicate for each primitive with ten rows or more.

    ``compat`` measures residuals around a line through the mean of x on both
    axes, as one published implementation does; the default uses the mean of y.
    """
    x = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    rows = deltas.select("primitive_id", x.alias("x"), F.col("delta").alias("y")).where("x is not null")
    sums = rows.groupBy("primitive_id").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy")
    )
    slope = F.try_divide("sxy", "sxx")
    shift = (F.col("my") - F.col("mx")) if compat else F.lit(0.0)
    residual = F.col("syy") - 2 * slope * F.col("sxy") + slope * slope * F.col("sxx") + F.col("n") * shift * shift
    return sums.where("n >= 10 and sxx > 0").select("primitive_id", "n", slope.alias("slope"), F.sqrt(F.greatest(residual, F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")).alias("se"))


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value by the Abramowitz-Stegun series (no erf in SQL); error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def classify_primitives(deltas: DataFrame, cells: DataFrame, slopes: DataFrame | None = None, min_n: int = 30, effect: float = 0.02, gated_min_n: int = 50, slope_p: float = 0.05) -> DataFrame:
    """always_on, always_off, gated or undetermined.

    Under ``min_n`` rows an edit is undetermined.  It is gated when cells of
    ``gated_min_n`` rows or more lie beyond the effect on both sides, or when
    a slope (of ``regressions``) is significant; else its mean over all rows
    decides.
    """
    whole = deltas.groupBy("primitive_id").agg(F.avg("delta").alias("global_mean"), F.count("delta").alias("global_n"))
    sure = F.col("n") >= gated_min_n
    signs = cells.groupBy("primitive_id").agg((F.bool_or(sure & (F.col("mean") > effect)) & F.bool_or(sure & (F.col("mean") < -effect))).alias("_split"))
    out = whole.join(signs, "primitive_id", "left")
    sloped = F.lit(False)
    if slopes is not None:
        bent = slopes.groupBy("primitive_id").agg(F.min(normal_p(F.try_divide("slope", "se"))).alias("_p"))
        out, sloped = out.join(bent, "primitive_id", "left"), F.coalesce(F.col("_p") < slope_p, F.lit(False))
    kind = (
        F.when(F.col("global_n") < min_n, "undetermined")
        .when(F.coalesce("_split", F.lit(False)) | sloped, "gated")
        .when(F.col("global_mean") > effect, "always_on")
        .when(F.col("global_mean") < -effect, "always_off")
        .otherwise("undetermined")
    )
    return out.select("primitive_id", "global_mean", "global_n", kind.alias("kind"))


def pick_target_cells(cells: DataFrame, top_k: int = 10, weight: float = 1.0, unseen_bonus: float = 2.0, min_priority: float = 0.01) -> DataFrame:
    """The cells most worth running: large mean, uncertain mean (1 where no deviation is known), or unseen."""
    # edits, and values of predicates: both short lists of an experiment's design
    grid = cells.select("primitive_id").distinct().join(cells.select("predicate_name", "predicate_value").distinct())
    stats = grid.join(cells, ["primitive_id", "predicate_name", "predicate_value"], "left")
    known = F.coalesce(F.when(F.col("se") < math.inf, F.col("se")), F.lit(1.0))
    priority = F.when(F.col("n").isNull(), F.lit(unseen_bonus)).otherwise(F.abs("mean") + weight * known)
    scored = stats.select("primitive_id", "predicate_name", "predicate_value", F.coalesce("n", F.lit(0)).alias("n"), priority.alias("priority"))
    return scored.where(F.col("priority") >= min_priority).orderBy(F.desc("priority"), "primitive_id", "predicate_name", "predicate_value").limit(top_k)


def seeded_order(seed: int, *columns: str) -> Column:
    """A reproducible random order: a hash of the seed and the row's key."""
    return F.xxhash64(F.lit(seed), *columns)


def portable_order(seed: int, column: str) -> Column:
    """The same, by md5, for engines that share no other hash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column)))


def stratified_sample(frame: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Proportional shares of ``n`` rows, at least one of each stratum, in seeded order; n is a row count asked for."""
    sizes = frame.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = frame.agg(F.count("*").alias("_total"))
    quota = sizes.join(F.broadcast(total)).withColumn("_quota", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_size") / F.col("_total"))))
    order = Window.partitionBy(stratum).orderBy(portable_order(seed, key), key)
    return frame.join(quota.select(stratum, "_quota"), stratum).withColumn("_r", F.row_number().over(order)).where("_r <= _quota").drop("_quota", "_r")


def targeted_plan(cube: Cube, cells: DataFrame, model: str, configs: DataFrame, per_cell: int, seed: int = 0) -> DataFrame:
    """Unexecuted queries of each target cell, at most ``per_cell`` of them in seeded order."""
    members = cube.predicate.select("query_id", F.col("name").alias("predicate_name"), F.col("value").alias("predicate_value"))
    wanted = cells.join(configs, "primitive_id").join(members, ["predicate_name", "predicate_value"])
    done = cube.execution.where(F.col("model") == model).select("config_id", "query_id")
    left = wanted.join(done, ["config_id", "query_id"], "left_anti")
    order = Window.partitionBy("primitive_id", "predicate_name", "predicate_value").orderBy(portable_order(seed, "query_id"), "query_id")
    return left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_cell).select("primitive_id", "config_id", "predicate_name", "predicate_value", "query_id")


def trim_plan(plan: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """Entries in order until their sizes reach the budget; the last is clipped."""
    summed = sum_before(plan, [order], size, "_before")
    return summed.where(F.col("_before") < budget).withColumn("granted", F.least(F.col(size), F.lit(budget) - F.col("_before"))).drop("_before")


def cross_plan(configs: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Every configuration on every query of its cohort."""
    return configs.join(cohorts, "cohort")


def cohorts(cube: Cube, names: list[str], min_size: int = 1, max_queries: int | None = None, seed: int = 0) -> DataFrame:
    """(cohort, query_id): queries by their joined predicate values; those without one of them are left out."""
    wide = predicate_table(cube, names)
    for n in names:
        wide = wide.where(F.col(n) != "")
    rows = wide.select(F.concat_ws("|", *names).alias("cohort"), "query_id")
    sizes = rows.groupBy("cohort").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size).select("cohort")
    rows = rows.join(sizes, "cohort", "left_semi")
    if max_queries is None:
        return rows
    order = Window.partitionBy("cohort").orderBy(portable_order(seed, "query_id"), "query_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_queries).drop("_r")


def seed_plan(cube: Cube, configs: DataFrame, stratum: str, per_config: int, seed: int = 0) -> DataFrame:
    """(config_id, query_id): the same stratified sample of queries for every configuration."""
    sample = stratified_sample(cube.query.select("query_id", stratum), stratum, "query_id", per_config, seed)
    return configs.select("config_id").join(sample.select("query_id"))


def make_analyzer(base: int, model: str, scorer: str, names: list[str], configs: DataFrame, per_cell: int = 20, top_k: int = 10, seed: int = 0):
    """A function of a cube: deltas, cells, slopes, classes, targets, and the next plan, or None for the plan when all is run.

    Predicates with many numbers are not cut into cells but have a slope for
    each edit, which may gate it.
    """

    def analyze(cube: Cube) -> dict[str, DataFrame | None]:
        deltas = build_delta_table(cube, base, model, scorer, names)
        kinds = {r["name"]: r["type"] for r in predicate_types(deltas, names).collect()}
        numeric = [n for n in names if kinds.get(n) == "numerical"]
        cells = summarize_cells(deltas, [n for n in names if n not in numeric] or names)
        slopes = None
        for n in numeric:
            one = regressions(deltas, n).withColumn("predicate_name", F.lit(n))
            slopes = one if slopes is None else slopes.unionByName(one)
        targets = pick_target_cells(cells, top_k)
        plan = targeted_plan(cube, targets, model, configs, per_cell, seed)
        return {"deltas": deltas, "cells": cells, "slopes": slopes, "classes": classify_primitives(deltas, cells, slopes), "targets": targets, "plan": None if plan.isEmpty() else plan}

    return analyze


def insights(classes: DataFrame) -> list[str]:
    """A sentence for each classified edit."""
    said = {"always_on": "helps wherever it was measured", "always_off": "harms and never helps", "gated": "helps only for some queries", "undetermined": "needs more runs"}
    return [f"{r['primitive_id']} {said[r['kind']]}." for r in classes.orderBy("primitive_id").collect()]
