"""Lift of features by predicate value, and difference in differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube

KEYS = ("canonical_id", "predicate_name", "predicate_value")


def lift_simple(cube: Cube, base: int, model: str, scorer: str, configs: DataFrame | None = None, predicate: str | None = None) -> DataFrame:
    """Mean under a feature's add-one configuration less the mean under the base, each over its own rows.

    ``configs`` maps config_id to canonical_id; by default the add-one
    configurations.  The means are aggregated once; a window puts the base
    beside the targets.
    """
    if configs is None:
        configs = cube.config.where(F.col("kind") == "add_one_feature").select("config_id", "canonical_id")
    means = cube.per_config_predicate_means(model, scorer, predicate)
    value = Window.partitionBy("predicate_name", "predicate_value")
    is_base = F.col("config_id") == base
    means = means.withColumn("base_mean", F.max(F.when(is_base, F.col("avg_score"))).over(value)).withColumn("base_n", F.max(F.when(is_base, F.col("n"))).over(value))
    out = means.where(~is_base).join(configs, "config_id")
    return out.select(*KEYS, F.col("avg_score").alias("target_mean"), "base_mean", (F.col("avg_score") - F.col("base_mean")).alias("lift"), F.col("n").alias("n_target"), F.coalesce("base_n", F.lit(0)).alias("n_base"))


def lift_marginal(cube: Cube, model: str, scorer: str, predicate: str | None = None) -> DataFrame:
    """Mean of configuration means with a feature less that without it."""
    means = cube.per_config_predicate_means(model, scorer, predicate)
    features = cube.feature.select("feature_id", "canonical_id")
    # configurations and features are small tables; every pair says whether it holds
    members = cube.config.select("config_id", "feature_ids").join(features).select("config_id", "canonical_id", F.array_contains("feature_ids", F.col("feature_id")).alias("has"))
    rows = means.join(members, "config_id")
    out = rows.groupBy(*KEYS).agg(
        F.avg(F.when(F.col("has"), F.col("avg_score"))).alias("target_mean"),
        F.avg(F.when(~F.col("has"), F.col("avg_score"))).alias("base_mean"),
        F.count_if(F.col("has")).alias("n_target"),
        F.count_if(~F.col("has")).alias("n_base"),
    )
    return out.where("n_target > 0 and n_base > 0").withColumn("lift", F.col("target_mean") - F.col("base_mean"))


def default_reference(effects: DataFrame) -> DataFrame:
    """The lesser of a predicate's values when it has exactly two."""
    values = effects.groupBy("predicate_name").agg(F.count_distinct("predicate_value").alias("k"), F.min("predicate_value").alias("reference"))
    return values.where("k = 2").select("predicate_name", "reference")


def did(effects: DataFrame, references: dict[str, str] | None = None) -> DataFrame:
    """``effects`` with the reference value and did = lift - lift at the reference; null without a reference."""
    chosen = default_reference(effects)
    if references:
        given = effects.sparkSession.createDataFrame(list(references.items()), "predicate_name string, reference string")
        chosen = given.unionByName(chosen.join(given, "predicate_name", "left_anti"))
    rows = effects.join(chosen, "predicate_name", "left")
    pair = Window.partitionBy("canonical_id", "predicate_name")
    at = F.max(F.when(F.col("predicate_value") == F.col("reference"), F.col("lift"))).over(pair)
    return rows.withColumn("did", F.col("lift") - at)


def rank(
    effects: DataFrame, sort_by: str | None = None, top_k: int | None = None, confidence_min: float | None = None, min_effect: float | None = None, min_lift_in_pair: float | None = None,
    require_sign: str | None = None, metric: str = "lift", descending: bool = True, sort_secondary: str | list | None = None,
) -> DataFrame:
    """Gates in order (confidence, pair maximum, size, sign), then sort, then the first k; undefined values come last.

    ``sort_secondary`` breaks ties: columns, each falling unless it is given as (column, True).
    """
    second = [(x, False) if isinstance(x, str) else tuple(x) for x in ([sort_secondary] if isinstance(sort_secondary, str) else sort_secondary or [])]
    if lost := [c for c, _ in second if c not in effects.columns]:
        raise ValueError(f"cannot sort by {lost[0]!r}")
    if require_sign not in (None, "positive", "negative"):
        raise ValueError("require_sign is positive or negative")
    if top_k is not None and top_k < 0:
        raise ValueError("top_k is negative")
    if metric not in effects.columns:
        raise ValueError(f"no column {metric!r}")
    if confidence_min is not None and "p_gt_zero" not in effects.columns:
        raise ValueError("confidence_min needs confidence columns")
    if confidence_min is not None and not 0 <= confidence_min <= 1:
        raise ValueError("confidence_min is a probability")
    if sort_by is not None and sort_by not in effects.columns:
        raise ValueError(f"cannot sort by {sort_by!r}")
    out = effects
    if confidence_min is not None:
        out = out.where(F.col("p_gt_zero") >= confidence_min)
    if min_lift_in_pair is not None:
        pair = Window.partitionBy("canonical_id", "predicate_name")
        out = out.withColumn("_top", F.max("lift").over(pair)).where(F.col("_top") > min_lift_in_pair).drop("_top")
    if min_effect is not None:
        out = out.where(F.abs(metric) >= min_effect)
    if require_sign is not None:
        out = out.where(F.col(metric) > 0 if require_sign == "positive" else F.col(metric) < 0)
    if sort_by is None:
        out = out.orderBy(*KEYS)
    else:
        out = out.orderBy(F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last(), *(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in second), *KEYS)
    return out if top_k is None else out.limit(top_k)


def feature_profile(effects: DataFrame, threshold: float = 0.01, confidence_threshold: float = 0.8) -> DataFrame:
    """One row a feature: the strongest did of each predicate (did_<predicate>, and p_gt_zero_<predicate> where known), and a label.

    A did counts from ``threshold`` on.  Without one the label is ``null``,
    with both signs ``mixed``, else ``selective`` up to two predicates and
    ``broad`` beyond.
    """
    known = "p_gt_zero" in effects.columns
    order = F.struct(-F.coalesce(F.abs("did"), F.lit(0.0)), F.col("did").isNull(), "predicate_value")
    strongest = F.min_by(F.struct("did", *(["p_gt_zero"] if known else [])), order)
    slots = effects.groupBy("canonical_id", "predicate_name").agg(strongest.alias("s")).select("canonical_id", "predicate_name", "s.*")
    names = sorted(r[0] for r in slots.select("predicate_name").distinct().collect())  # the names of a cube's predicates
    did, big = F.col("did"), F.coalesce(F.abs("did") >= threshold, F.lit(False))
    at = lambda n, c: F.max(F.when(F.col("predicate_name") == n, F.col(c)))
    wide = [at(n, "did").alias(f"did_{n}") for n in names] + [at(n, "p_gt_zero").alias(f"p_gt_zero_{n}") for n in names if known]
    found = F.count_if(F.col("p_gt_zero") >= confidence_threshold) if known else F.lit(0).cast("bigint")
    counts = [found.alias("n_sig_slices"), F.max(F.abs(did)).alias("max_abs_did"), F.avg(did).alias("breadth_mean"), F.count_if(big & (did > 0)).alias("_up"), F.count_if(big & (did < 0)).alias("_down")]
    label = F.when(F.col("_up") + F.col("_down") == 0, "null").when((F.col("_up") > 0) & (F.col("_down") > 0), "mixed").when(F.col("_up") + F.col("_down") <= 2, "selective").otherwise("broad")
    return slots.groupBy("canonical_id").agg(*wide, *counts).withColumn("classification", label).drop("_up", "_down")


def predicate_overlap(cube: Cube, threshold: float = 0.95) -> DataFrame:
    """Pairs of (predicate, value) slots of different predicates whose query sets are alike, by Jaccard index."""
    slots = cube.predicate.select("query_id", F.col("name").alias("n"), F.col("value").alias("v")).distinct()
    sizes = slots.groupBy("n", "v").agg(F.count("*").alias("size"))
    a, b = (slots.select("query_id", F.col("n").alias(f"name_{s}"), F.col("v").alias(f"value_{s}")) for s in "ab")
    shared = a.join(b, "query_id").where("name_a < name_b").groupBy("name_a", "value_a", "name_b", "value_b").agg(F.count("*").alias("n_shared"))
    for s in "ab":
        shared = shared.join(sizes.select(F.col("n").alias(f"name_{s}"), F.col("v").alias(f"value_{s}"), F.col("size").alias(f"size_{s}")), [f"name_{s}", f"value_{s}"])
    out = shared.withColumn("jaccard", F.col("n_shared") / (F.col("size_a") + F.col("size_b") - F.col("n_shared")))
    return out.where(F.col("jaccard") >= threshold).select("name_a", "value_a", "name_b", "value_b", "n_shared", "jaccard")


def predicate_kinds(cube: Cube) -> DataFrame:
    """numeric when every value of a predicate is a number, else categorical."""
    number = F.bool_and(F.expr("try_cast(value AS DOUBLE)").isNotNull())
    return cube.predicate.groupBy("name").agg(F.when(number, "numeric").otherwise("categorical").alias("kind"), F.count_distinct("value").alias("n_values"))
