"""Routing: a regression tree for each edit predicts where it helps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


@dataclass
class RoutingModel:
    trees: dict[str, PipelineModel]
    names: list[str]

    def predict(self, queries: DataFrame) -> DataFrame:
        """``queries`` with one predicted delta a primitive."""
        out = queries
        for primitive, tree in self.trees.items():
            scored = tree.transform(out)
            out = scored.select(*out.columns, F.col("_prediction").alias(f"gain_{primitive}"))
        return out

    def route(self, queries: DataFrame, least: float = 0.0) -> DataFrame:
        """The primitive with the largest predicted gain, or base when none passes ``least``."""
        out = self.predict(queries)
        gains = [F.struct(F.col(f"gain_{p}").alias("gain"), F.lit(p).alias("primitive")) for p in self.trees]
        best = F.array_max(F.array(*gains))
        return out.select(*queries.columns, F.when(best["gain"] > least, best["primitive"]).otherwise("base").alias("route"), best["gain"].alias("predicted_gain"))

    def describe(self) -> dict[str, str]:
        return {p: t.stages[-1].toDebugString for p, t in self.trees.items()}


def fit_routing(deltas: DataFrame, categorical: list[str], numeric: list[str] = (), depth: int = 3, leaf: int = 50) -> RoutingModel:
    """One tree a primitive over one-hot categories and numbers; the deltas are written once, not found anew by each pass of each tree."""
    trees, deltas = {}, scratch.written(deltas.select("primitive_id", "delta", *categorical, *numeric))
    for primitive in sorted(r["primitive_id"] for r in deltas.select("primitive_id").distinct().collect()):
        rows = deltas.where(F.col("primitive_id") == primitive)
        rows = rows.select("delta", *categorical, *numeric)
        index = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical]
        hot = [OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", handleInvalid="keep") for c in categorical]
        number = [SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(try_cast(`{n}` AS DOUBLE), 0) AS `_n_{n}`" for n in numeric) + " FROM __THIS__")] if numeric else []
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="delta", predictionCol="_prediction", maxDepth=depth, minInstancesPerNode=leaf, seed=0)
        trees[primitive] = Pipeline(stages=[*number, *index, *hot, VectorAssembler(inputCols=[*(f"_h_{c}" for c in categorical), *(f"_n_{n}" for n in numeric)], outputCol="_x"), tree]).fit(rows)
    return RoutingModel(trees, [*categorical, *numeric])


def oracle_gain(deltas: DataFrame) -> DataFrame:
    """Mean over queries of the best delta, at least 0: the most that routing can gain."""
    best = deltas.groupBy("query_id").agg(F.max("delta").alias("best"))
    return best.agg(F.avg(F.greatest(F.lit(0.0), F.col("best"))).alias("oracle_gain"), F.count("*").alias("n_queries"))


def evaluate_routes(routes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Gain by routes (query_id, route; a null route is the base), the oracle's gain, their ratio, and how many queries go to an edit and to the base.

    A query that was not run with its route gains nothing.
    """
    got = routes.join(deltas.select("query_id", F.col("primitive_id").alias("route"), "delta"), ["query_id", "route"], "left")
    routed = got.agg(F.avg(F.coalesce("delta", F.lit(0.0))).alias("routing_gain"), F.count("route").alias("n_routed"), F.count_if(F.col("route").isNull()).alias("n_base"))
    return routed.join(oracle_gain(deltas)).withColumn("ratio", F.try_divide("routing_gain", "oracle_gain"))


def selections(routes: DataFrame) -> DataFrame:
    """How many queries each edit gets; null is the base."""
    return routes.groupBy("route").agg(F.count("*").alias("n_queries"))


def evaluate_routing(model: RoutingModel, deltas: DataFrame) -> DataFrame:
    """``evaluate_routes`` of a model's routes."""
    queries = deltas.select("query_id", *model.names).dropDuplicates(["query_id"])
    return evaluate_routes(model.route(queries).select("query_id", "route"), deltas)


def folds(deltas: DataFrame, k: int) -> DataFrame:
    return deltas.withColumn("fold", F.pmod(F.xxhash64("query_id"), F.lit(k)).cast("int"))


def cross_validate(deltas: DataFrame, categorical: list[str], k: int = 3, **options) -> DataFrame:
    """Routing gain of each fold under a model of the other folds; folds are by query."""
    dealt, out = folds(deltas, k), None
    for fold in range(k):
        model = fit_routing(dealt.where(F.col("fold") != fold), categorical, **options)
        one = evaluate_routing(model, dealt.where(F.col("fold") == fold)).withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out


def transfer(source: DataFrame, target: DataFrame, categorical: list[str], **options) -> DataFrame:
    """Gain on the target of a model of the source, beside one of its own."""
    theirs = evaluate_routing(fit_routing(source, categorical, **options), target).withColumn("model", F.lit("source"))
    return theirs.unionByName(evaluate_routing(fit_routing(target, categorical, **options), target).withColumn("model", F.lit("target")))
