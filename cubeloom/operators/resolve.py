"""Matching configurations and features by the sets of funcs and features that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube
from ..plans.schema import config_key


def find_config_by_features(cube: Cube, canonical_ids: list[str]) -> DataFrame:
    """The configurations whose features are exactly these."""
    ids = cube.feature.where(F.col("canonical_id").isin(canonical_ids)).agg(F.array_sort(F.collect_set("feature_id")).alias("wanted"))
    return cube.config.join(F.broadcast(ids), F.array_sort("feature_ids") == F.col("wanted")).select("config_id")


def configs_containing_features(cube: Cube) -> DataFrame:
    """(canonical_id, config_id) where all of a feature's funcs are among the configuration's: containment by counting matches."""
    wanted = cube.feature.select("canonical_id", F.size("func_ids").alias("size"), F.explode("func_ids").alias("func_id"))
    held = cube.config.select("config_id", F.explode(F.array_distinct("func_ids")).alias("func_id"))
    return wanted.join(held, "func_id").groupBy("canonical_id", "config_id", "size").agg(F.count("*").alias("n")).where("n = size").select("canonical_id", "config_id")


def base_funcs(cube: Cube, base: int) -> DataFrame:
    return cube.config.where(F.col("config_id") == base).select(F.explode("func_ids").alias("func_id"))


def base_like_features(cube: Cube, base: int) -> DataFrame:
    """Features whose funcs the base already has."""
    funcs = cube.config.where(F.col("config_id") == base).select(F.col("func_ids").alias("base_funcs"))
    return cube.feature.join(F.broadcast(funcs)).where(F.size(F.array_except("func_ids", "base_funcs")) == 0).select("canonical_id")


def simple_effect_configs(cube: Cube, base: int) -> DataFrame:
    """(canonical_id, config_id): each feature's add-one configuration.

    Three ways in order: the linked feature ids are the base's plus this one;
    the configuration is named after the feature; its funcs beyond the base
    are the feature's beyond the base.  The first way, then the least
    configuration, wins.
    """
    b = cube.config.where(F.col("config_id") == base).select(F.col("func_ids").alias("bf"), F.col("feature_ids").alias("bi"))
    others = cube.config.where(F.col("config_id") != base).join(F.broadcast(b))
    features = cube.feature.join(F.broadcast(b)).select("canonical_id", "feature_id", F.to_json(F.array_sort(F.array_except("func_ids", "bf"))).alias("extra"), F.to_json(F.array_sort(F.array_union(F.array("feature_id"), "bi"))).alias("ids"))
    strict = others.withColumn("ids", F.to_json(F.array_sort("feature_ids"))).join(features.select("canonical_id", "ids"), "ids").select(features["canonical_id"], "config_id", F.lit(1).alias("way"))
    named = others.where(F.col("kind") == "add_one_feature").join(features.select(F.col("canonical_id").alias("c")), F.col("canonical_id") == F.col("c")).select(F.col("c").alias("canonical_id"), "config_id", F.lit(2).alias("way"))
    delta = others.drop("canonical_id").withColumn("extra", F.to_json(F.array_sort(F.array_except("func_ids", "bf")))).join(features.where("extra <> '[]'").select("canonical_id", "extra"), "extra").select("canonical_id", "config_id", F.lit(3).alias("way"))
    best = Window.partitionBy("canonical_id").orderBy("way", "config_id")
    return strict.unionByName(named).unionByName(delta).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("canonical_id", "config_id", "way")


def same_funcs(cube: Cube) -> DataFrame:
    """Groups of configurations with equal func multisets."""
    return cube.config.groupBy(config_key(F.col("func_ids")).alias("key")).agg(F.count("*").alias("n"), F.min("config_id").alias("first_config"))


def near_configs(cube: Cube, canonical_ids: list[str], k: int = 3) -> DataFrame:
    """``config_id, missing, extra, rank``: the configurations whose features differ least from these, by wanted features that they lack and others that they have.

    Only configurations that share a feature with the wanted ones are compared.
    """
    ids = cube.feature.where(F.col("canonical_id").isin(canonical_ids)).select("feature_id")
    sizes = cube.config_feature.select("config_id", "feature_id").distinct()
    shared = sizes.join(ids, "feature_id", "left_semi").groupBy("config_id").agg(F.count("*").alias("shared"))
    both = sizes.join(shared.select("config_id"), "config_id", "left_semi").groupBy("config_id").agg(F.count("*").alias("held")).join(shared, "config_id")
    differ = both.select("config_id", (F.lit(len(set(canonical_ids))) - F.col("shared")).alias("missing"), (F.col("held") - F.col("shared")).alias("extra"))
    nearest = differ.orderBy(F.col("missing") + F.col("extra"), "config_id").limit(k)
    return nearest.withColumn("rank", F.row_number().over(Window.orderBy(F.col("missing") + F.col("extra"), "config_id")))


def config_by_features(cube: Cube, canonical_ids: list[str]) -> int:
    """The least configuration with exactly these features; else an error that names unknown features or the nearest configurations."""
    known = {r["canonical_id"] for r in cube.feature.where(F.col("canonical_id").isin(canonical_ids)).select("canonical_id").collect()}
    if unknown := sorted(set(canonical_ids) - known):
        raise ValueError(f"no such feature: {', '.join(unknown)}")
    found = find_config_by_features(cube, canonical_ids).agg(F.min("config_id").alias("c")).first()["c"]
    if found is None:
        near = "; ".join(f"{r['config_id']} lacks {r['missing']} and has {r['extra']} more" for r in near_configs(cube, canonical_ids).orderBy("rank").collect())
        raise ValueError("no configuration has exactly these features" + (f"; nearest: {near}" if near else ""))
    return found
