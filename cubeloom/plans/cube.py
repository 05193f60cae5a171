"""The cube: its tables as lazy DataFrames, and the views over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection


def no_error(error="error"):
    return F.coalesce(F.col(error), F.lit("")) == ""


@dataclass(frozen=True)
class Cube:
    """Fact and dimension tables.

    ``execution`` has one row for each (config, query, model), ``evaluation``
    one for each (execution, scorer).  Two populations of scores exist and
    every operator says which it reads: ``query_scores`` leaves out errors and
    missing scores, ``all_scores`` has the zeros that errors were given.
    """

    func: DataFrame
    query: DataFrame
    config: DataFrame
    execution: DataFrame
    evaluation: DataFrame
    predicate: DataFrame
    feature: DataFrame
    config_feature: DataFrame
    label_membership: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.execution.sparkSession

    # -- views ---------------------------------------------------------------

    def node_view(self, node_type: str, *fields: str) -> DataFrame:
        """Inserted prompt nodes of a type, payload fields as columns."""
        path = lambda p: F.get_json_object("params", f"$.{p}")
        out = self.func.where((F.col("func_type") == "insert_node") & (path("node_type") == node_type))
        return out.select("func_id", path("parent_id").alias("parent_id"), *(path(f"payload.{f}").alias(f) for f in fields))

    def section_view(self) -> DataFrame:
        return self.node_view("section", "title", "ordinal", "is_system", "min_rules", "max_rules", "kind")

    def rule_view(self) -> DataFrame:
        return self.node_view("rule", "content", "ordinal")

    def input_field_view(self) -> DataFrame:
        return self.node_view("input_field", "name", "description")

    def output_field_view(self) -> DataFrame:
        return self.node_view("output_field", "name", "description")

    def all_scores(self, model: str | None = None, scorer: str | None = None) -> DataFrame:
        """Evaluations with their executions, errors included."""
        e, v = self.execution, self.evaluation
        if model is not None:
            e = e.where(F.col("model") == model)
        if scorer is not None:
            v = v.where(F.col("scorer") == scorer)
        return v.select("execution_id", "scorer", "score", "metrics").join(e, "execution_id")

    def query_scores(self, model: str | None = None, scorer: str | None = None) -> DataFrame:
        """Scores of executions without an error; the narrow columns only."""
        clean = self.all_scores(model, scorer).where(no_error() & F.col("score").isNotNull())
        return clean.select("config_id", "query_id", "model", "scorer", "score")

    def scored_executions(self, model: str | None = None, scorer: str | None = None, predicate: str | None = None) -> DataFrame:
        """``query_scores`` by predicate: a row for each predicate of the query."""
        p = self.predicate if predicate is None else self.predicate.where(F.col("name") == predicate)
        p = p.select("query_id", F.col("name").alias("predicate_name"), F.col("value").alias("predicate_value"))
        return self.query_scores(model, scorer).join(p, "query_id")

    def per_config_predicate_means(self, model: str | None = None, scorer: str | None = None, predicate: str | None = None) -> DataFrame:
        keys = ["config_id", "model", "scorer", "predicate_name", "predicate_value"]
        return self.scored_executions(model, scorer, predicate).groupBy(*keys).agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))

    def feature_effect(self) -> DataFrame:
        """Evaluations by the features that their configuration names; errors included."""
        named = self.config.select("config_id", F.explode("feature_ids").alias("feature_id"))
        features = self.feature.select("feature_id", "canonical_id", "task")
        q = self.query.select("query_id", "dataset")
        rows = self.all_scores().select("config_id", "query_id", "model", "scorer", "score")
        return rows.join(named, "config_id").join(features, "feature_id").join(q, "query_id")

    def feature_label_effect(self) -> DataFrame:
        """Evaluations by the labels of the features in the link table; errors included."""
        star = self.config_feature.select("config_id", "feature_id").join(self.feature.select("feature_id", "canonical_id"), "feature_id").join(self.label_membership, "feature_id")
        q = self.query.select("query_id", "dataset", "qtype")
        return self.all_scores().select("config_id", "query_id", "model", "scorer", "score").join(star, "config_id").join(q, "query_id")

    def feature_label_predicate_effect(self) -> DataFrame:
        p = self.predicate.select("query_id", F.col("name").alias("predicate_name"), F.col("value").alias("predicate_value"))
        return self.feature_label_effect().join(p, "query_id")

    def register(self, prefix: str = "") -> None:
        """Temporary views of the tables and the views, for SQL."""
        for name in ("func", "query", "config", "execution", "evaluation", "predicate", "feature", "config_feature", "label_membership"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        for name in ("section_view", "rule_view", "input_field_view", "output_field_view", "feature_effect", "feature_label_effect", "feature_label_predicate_effect", "query_scores", "scored_executions", "per_config_predicate_means"):
            getattr(self, name)().createOrReplaceTempView(prefix + "v_" + name)


def projected(spark: SparkSession, sf_dir: str) -> Cube:
    """The cube over the test tables."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    frames = {}
    for name in projection.ORDER:
        sql = projection.text(name, "{documents}", "{labels}")
        if name == "funcs":
            frames[name] = spark.createDataFrame(_func_rows(), "func_id string, func_type string, params string")
        else:
            safe = sql.replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}").replace("{{labels}}", "{labels}")
            frames[name] = spark.sql(safe, **{k: v for k, v in {"documents": docs, "labels": labels}.items() if "{" + k + "}" in sql})
    config, feature = _with_sets(frames)
    return Cube(
        func=frames["funcs"],
        query=frames["queries"],
        config=config,
        execution=frames["executions"].withColumn("phase_ids", F.split("phases", ",")).drop("phases", "doc_id"),
        evaluation=frames["evaluations"],
        predicate=frames["predicates"],
        feature=feature,
        config_feature=frames["config_features"].withColumn("role", F.lit("feature")),
        label_membership=frames["features"].select("feature_id", "label_id", F.lit("implements").alias("role")),
    )


def _with_sets(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Configurations and features with their sets of ids as arrays."""
    feature_ids = frames["config_features"].groupBy("config_id").agg(F.array_sort(F.collect_list("feature_id")).alias("feature_ids"))
    config = frames["configs"].withColumn("func_ids", F.split("funcs", ",")).join(feature_ids, "config_id", "left").withColumn("feature_ids", F.coalesce("feature_ids", F.array().cast("array<string>"))).drop("funcs")
    return config, frames["features"].withColumn("func_ids", F.split("funcs", ",")).drop("funcs", "label_id")


def designed(spark: SparkSession, sf_dir: str) -> Cube:
    """The cube with many edits, features and configurations instead of a handful; its executions don't belong to them."""
    frames = {}
    for name, sql in projection.DESIGN.items():
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in projection.DESIGN_TABLES[name]}
        safe = sql.replace("{", "{{").replace("}", "}}")
        for t in given:
            safe = safe.replace(f"@{t}", f"{{{t}}}")
        frames[name] = spark.sql(safe, **given)
    config, feature = _with_sets(frames)
    return replace(
        projected(spark, sf_dir), func=frames["funcs"], config=config, feature=feature, config_feature=frames["config_features"].withColumn("role", F.lit("feature")),
        label_membership=frames["features"].select("feature_id", "label_id", F.lit("implements").alias("role")),
    )


def _func_rows() -> list[tuple[str, str, str]]:
    import re

    return [tuple(m) for m in re.findall(r"\('(\w+)', '(\w+)', '(\{.*\})'\)", projection.FUNCS)]
