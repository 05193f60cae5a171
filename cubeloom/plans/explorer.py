"""Explorer operators: field filters, slices, examples, diagnostics; one namespace of fields for all of them."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, preview, response_pattern
from .cube import Cube, no_error


#: Longer names of the plain fields.
ALIASES = {
    "query.dataset": "dataset", "query.split": "split", "benchmark.split": "split", "query.query_id": "query_id", "config.config_id": "config_id", "ev.score": "score", "evaluation.score": "score",
    "execution.error": "error",
}


@dataclass(frozen=True)
class Field:
    """dataset, split, qtype, query_id, config_id, score, error, ``query.meta.<path>`` or ``predicate.<name>``."""

    name: str

    PLAIN = ("dataset", "split", "qtype", "lang", "query_id", "config_id", "model", "scorer", "score", "error")

    @property
    def predicate(self) -> str | None:
        return self.name.removeprefix("predicate.") if self.name.startswith("predicate.") else None

    @property
    def meta(self) -> str | None:
        """The path below the query's meta, keys joined by dots."""
        return self.name.removeprefix("query.meta.") if self.name.startswith("query.meta.") else None

    @property
    def column_name(self) -> str:
        if self.predicate:
            return f"_p_{self.predicate}"
        return f"_m_{self.meta}" if self.meta else ALIASES.get(self.name, self.name)

    @property
    def column(self) -> Column:
        if not self.predicate and not self.meta and self.column_name not in self.PLAIN:
            raise ValueError(f"unknown field {self.name!r}")
        return F.col("`" + self.column_name.replace("`", "``") + "`")


def meta_path(keys: list[str]) -> str:
    """A JSON path; keys that are no identifiers are quoted, by a mark that they don't hold."""
    out = "$"
    for k in keys:
        if not k or ("'" in k and '"' in k):
            raise ValueError(f"no path leads to the key {k!r}")
        mark = '"' if "'" in k else "'"
        out += f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else f"[{mark}{k}{mark}]"
    return out


def meta_value(meta: Column, path: str, kind: str = "string") -> Column:
    """What a JSON text has at a path that is chosen at run time; a JSON null and a missing key are both null, but for kind ``variant``."""
    return F.try_variant_get(F.try_parse_json(meta), meta_path(path.split(".")), kind)


# Where a reference answer is looked for, first among the raw item's keys, then among the meta's own.
RAW_GOLD = ("answers", "answer", "gold", "gold_answer")
META_GOLD = ("gold_answer", "gold_answers", "answer", "answers", "label")


def gold_answer(meta: Column) -> Column:
    """The reference answer as text: the first key that is *there*, even if its value is null."""
    v = F.try_parse_json(meta)
    at = lambda path: F.try_variant_get(v, path, "variant")
    is_object = F.coalesce(F.schema_of_variant(at("$._raw")).startswith("OBJECT"), F.lit(False))
    chain = None
    for path, allowed in [(f"$._raw.{k}", is_object) for k in RAW_GOLD] + [(f"$.{k}", F.lit(True)) for k in META_GOLD]:
        there = allowed & at(path).isNotNull()
        chain = F.when(there, at(path).cast("string")) if chain is None else chain.when(there, at(path).cast("string"))
    return chain


def compact_meta(meta: Column) -> Column:
    """The meta as JSON text without the raw item; '{}' where it is no object."""
    fields = F.try_variant_get(F.try_parse_json(meta), "$", "map<string,variant>")
    return F.coalesce(F.to_json(F.map_filter(fields, lambda k, v: k != "_raw")), F.lit("{}"))


def _equal(field: str, c: Column, value) -> Column:
    """Values below meta are text: truth values by their names, numbers by their value."""
    if not Field(field).meta:
        return c == value
    if isinstance(value, bool):
        return c == str(value).lower()
    return c.try_cast("double") == float(value) if isinstance(value, (int, float)) else c == value


def filter_column(field: str, op: str, value=None) -> Column:
    """One filter; comparisons with a number read the field as a number and drop what is none."""
    c = Field(field).column
    if op in ("=", "eq"):
        return _equal(field, c, value)
    if op in ("!=", "ne"):
        return ~_equal(field, c, value)
    if op == "in":
        return functools.reduce(lambda a, b: a | b, (_equal(field, c, v) for v in value)) if value else F.lit(False)
    if op == "is_empty":
        return F.coalesce(c.cast("string"), F.lit("")) == ""
    if op == "is_not_empty":
        return F.coalesce(c.cast("string"), F.lit("")) != ""
    if op in ("<", "<=", ">", ">="):
        number = c.cast("string").try_cast("double")
        return {"<": number < value, "<=": number <= value, ">": number > value, ">=": number >= value}[op]
    raise ValueError(f"unknown operator {op!r}")


def dimension(field: str) -> Column:
    c = Field(field).column
    return F.when(F.coalesce(c, F.lit("")) == "", "(no split)").otherwise(c) if Field(field).column_name == "split" else c


def query_columns(cube: Cube, fields: list[str]) -> DataFrame:
    """The queries' plain fields, and a column for each meta path that the fields name."""
    paths = sorted({Field(f).meta for f in fields if Field(f).meta})
    return cube.query.select("query_id", "dataset", "split", "qtype", "lang", *(meta_value(F.col("meta"), p).alias(f"_m_{p}") for p in paths))


def with_predicates(rows: DataFrame, cube: Cube, fields: list[str]) -> DataFrame:
    """``rows`` with a column for each predicate that the fields name, by one pivot and one left join."""
    names = sorted({Field(f).predicate for f in fields if Field(f).predicate})
    if not names:
        return rows
    wide = cube.predicate.where(F.col("name").isin(names)).groupBy("query_id").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_p_{n}") for n in names))
    return rows.join(wide, "query_id", "left")


def scored(cube: Cube, model: str, scorer: str, filters=(), fields=(), clean: bool = True) -> DataFrame:
    """Score rows with their query's fields, filtered."""
    rows = cube.all_scores(model, scorer)
    if clean:
        rows = rows.where(no_error() & F.col("score").isNotNull())
    named = [*fields, *(f for f, *_ in filters)]
    rows = with_predicates(rows.join(query_columns(cube, named), "query_id"), cube, named)
    for f in filters:
        rows = rows.where(filter_column(*f))
    return rows


def slice_scores(cube: Cube, model: str, scorer: str, group_by: list[str], filters=(), config_ids: list[int] | None = None, base: int | None = None, limit: int | None = 500) -> DataFrame:
    """n, mean, ones and zeros of each configuration and group, and the difference from the base in the same group."""
    rows = scored(cube, model, scorer, filters, group_by)
    names = [re.sub(r"\W", "_", f) for f in group_by]
    if config_ids is not None:
        rows = rows.where(F.col("config_id").isin([*config_ids, *([base] if base is not None else [])]))
    out = rows.groupBy("config_id", *(dimension(f).alias(n) for f, n in zip(group_by, names))).agg(
        F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.count_if(F.col("score") == 1).alias("n_correct"), F.count_if(F.col("score") == 0).alias("n_wrong")
    )
    if base is not None:
        at = F.max(F.when(F.col("config_id") == base, F.col("avg_score"))).over(Window.partitionBy(*names) if names else Window.partitionBy(F.lit(1)))
        out = out.withColumn("delta", F.col("avg_score") - at)
    if config_ids is not None:
        out = out.where(F.col("config_id").isin(config_ids))
    return out if limit is None else out.orderBy("config_id", *names).limit(limit)


def label_analysis(cube: Cube, model: str, scorer: str, base: int) -> DataFrame:
    """Score of each label over distinct (label, configuration, query), beside the base's mean on the same predicate-free whole."""
    rows = cube.feature_label_effect().where((F.col("model") == model) & (F.col("scorer") == scorer)).dropDuplicates(["label_id", "role", "config_id", "query_id"])
    mean = cube.all_scores(model, scorer).where(F.col("config_id") == base).agg(F.avg("score").alias("base_avg"))
    out = rows.groupBy("label_id", "role").agg(F.count_distinct("config_id").alias("n_configs"), F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n"), F.avg("score").alias("avg_score"))
    return out.join(F.broadcast(mean)).withColumn("delta", F.col("avg_score") - F.col("base_avg"))


def compare_configs(cube: Cube, base: int, target: int, model: str, scorer: str, filters=()) -> DataFrame:
    """Paired rows (query, both scores, direction) under the filters."""
    rows = scored(cube, model, scorer, filters).where(F.col("config_id").isin(base, target))
    pairs = rows.groupBy("query_id", "dataset").agg(F.max(F.when(F.col("config_id") == base, F.col("score"))).alias("base_score"), F.max(F.when(F.col("config_id") == target, F.col("score"))).alias("target_score"))
    both = pairs.where("base_score is not null and target_score is not null")
    return both.withColumn("direction", F.when(F.col("target_score") > F.col("base_score"), "up").when(F.col("target_score") < F.col("base_score"), "down").otherwise("same"))


def comparison_examples(cube: Cube, base: int, target: int, model: str, scorer: str, direction: str, limit: int = 50, compat: bool = False) -> DataFrame:
    """The first pairs of a direction; ``compat`` limits before it filters."""
    rows = compare_configs(cube, base, target, model, scorer)
    if compat:
        return rows.orderBy("query_id").limit(limit).where(F.col("direction") == direction)
    return rows.where(F.col("direction") == direction).orderBy("query_id").limit(limit)


def examples(cube: Cube, model: str, scorer: str, filters=(), ascending: bool = True, limit: int = 50) -> DataFrame:
    """Lowest or highest scores with what was asked and said; errors included."""
    rows = scored(cube, model, scorer, filters, clean=False)
    order = F.col("score").asc_nulls_first() if ascending else F.col("score").desc_nulls_last()
    return rows.select("config_id", "query_id", "score", "prediction", preview(F.col("raw_response"), 80).alias("response")).orderBy(order, "config_id", "query_id").limit(limit)


def execution_artifact(cube: Cube, execution_id: int) -> DataFrame:
    """One execution with its query and its first evaluation."""
    e = cube.execution.where(F.col("execution_id") == execution_id)
    v = cube.evaluation.where(F.col("execution_id") == execution_id).groupBy("execution_id").agg(F.min_by(F.struct("scorer", "score", "metrics"), "eval_id").alias("v"))
    return e.join(v, "execution_id", "left").join(cube.query.select("query_id", "dataset", "content"), "query_id").select("execution_id", "config_id", "query_id", "model", "dataset", "prediction", "error", "v.scorer", "v.score")


def diagnostics(cube: Cube, model: str, scorer: str, config_id: int | None = None) -> DataFrame:
    """Histograms of metrics, output mode, error and response pattern, with mean scores, in one pass."""
    rows = cube.all_scores(model, scorer)
    if config_id is not None:
        rows = rows.where(F.col("config_id") == config_id)
    ecr, mode = F.get_json_object("metrics", "$['ECR@1']"), F.get_json_object("metrics", "$.output_mode")
    state = F.when(no_error(), "ok").otherwise("error")
    pairs = F.array(*(F.struct(F.lit(k).alias("histogram"), bucket(c).alias("bucket")) for k, c in {"ecr": ecr, "output_mode": mode, "error_state": state, "response_pattern": response_pattern(preview(F.col("raw_response")), F.col("error"), F.col("prediction"))}.items()))
    return rows.select("score", F.explode(pairs).alias("x")).groupBy("x.histogram", "x.bucket").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def list_configs_detailed(cube: Cube, scorer: str) -> DataFrame:
    """Every configuration with its runs, scores and features, each side aggregated before the join."""
    runs = cube.execution.groupBy("config_id").agg(F.count("*").alias("n_executions"), F.count_distinct("query_id").alias("n_queries"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    scores = cube.all_scores(scorer=scorer).groupBy("config_id").agg(F.avg("score").alias("avg_score"))
    named = cube.config_feature.join(cube.feature.select("feature_id", "canonical_id"), "feature_id").groupBy("config_id").agg(F.array_join(F.array_sort(F.collect_set("canonical_id")), ",").alias("features"))
    out = cube.config.select("config_id", "kind").join(runs, "config_id", "left").join(scores, "config_id", "left").join(named, "config_id", "left")
    return out.withColumn("label", F.coalesce(F.nullif("features", F.lit("")), "kind")).withColumn("n_executions", F.coalesce("n_executions", F.lit(0)))


def predicate_fields(cube: Cube) -> DataFrame:
    """Predicates with counts and their first eight values."""
    return cube.predicate.groupBy("name").agg(F.count_distinct("query_id").alias("n_queries"), F.count_distinct("value").alias("n_values"), F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 8), "|").alias("samples"))


def meta_fields(rows: DataFrame, column: str) -> DataFrame:
    """Keys of a JSON column, how many rows have each, and up to eight sample values."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n_rows"), F.slice(F.array_sort(F.collect_set(F.left("value", F.lit(80)))), 1, 8).alias("samples"))


def dataset_scope(cube: Cube, only_with_results: bool = False, model: str | None = None, scorer: str | None = None, compat: bool = False) -> DataFrame:
    """Queries by dataset and split; optionally those with a score.  ``compat`` counts a row for each score as well, as ``n_rows``."""
    q = cube.query
    if only_with_results:
        scores = cube.query_scores(model, scorer).select("query_id")
        q = q.join(scores, "query_id") if compat else q.join(scores, "query_id", "left_semi")
    by = q.groupBy("dataset", dimension("split").alias("split"))
    return by.agg(F.count("*").alias("n_rows"), F.count_distinct("query_id").alias("n_queries")) if compat else by.agg(F.count("*").alias("n_queries"))


def base_means(cube: Cube, model: str, scorer: str, base: int, field: str) -> DataFrame:
    """``value, n, avg_score`` of the base by a field's value, and over all as the value '(all)'."""
    rows = scored(cube, model, scorer, fields=[field]).where(F.col("config_id") == base).select(F.coalesce(dimension(field).cast("string"), F.lit("(none)")).alias("value"), "score")
    return rows.rollup("value").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")).select(F.coalesce("value", F.lit("(all)")).alias("value"), "n", "avg_score")


def _to_delete(cube: Cube, models: list[str] = (), config_ids: list[int] = (), filters=()) -> DataFrame:
    if not (models or config_ids or filters):
        raise ValueError("a deletion needs a filter")
    named = [f for f, *_ in filters]
    rows = with_predicates(cube.execution.join(query_columns(cube, named), "query_id"), cube, named)
    if models:
        rows = rows.where(F.col("model").isin(list(models)))
    if config_ids:
        rows = rows.where(F.col("config_id").isin(list(config_ids)))
    for f in filters:
        rows = rows.where(filter_column(*f))
    return rows


def plan_delete(cube: Cube, models: list[str] = (), config_ids: list[int] = (), filters=()) -> DataFrame:
    """What a deletion would take; nothing is deleted, and at least one filter is required."""
    rows = _to_delete(cube, models, config_ids, filters).select("execution_id", "query_id")
    both = rows.join(cube.evaluation.select("execution_id", "eval_id"), "execution_id", "left")
    return both.agg(F.count_distinct("execution_id").alias("n_executions"), F.count("eval_id").alias("n_evaluations"), F.count_distinct("query_id").alias("n_queries"))


def plan_delete_preview(cube: Cube, models: list[str] = (), config_ids: list[int] = (), filters=(), limit: int = 20) -> DataFrame:
    """The first executions that a deletion would take."""
    return _to_delete(cube, models, config_ids, filters).select("execution_id", "config_id", "query_id", "model", "error").orderBy("execution_id").limit(limit)


def recent(cube: Cube, n: int = 20) -> DataFrame:
    return cube.execution.orderBy(F.desc("created_at"), F.desc("execution_id")).select("execution_id", "config_id", "query_id", "model").limit(n)


def errors(cube: Cube, n: int = 20) -> DataFrame:
    return cube.execution.where(~no_error()).orderBy(F.desc("created_at"), F.desc("execution_id")).select("execution_id", "config_id", "query_id", "model", "error").limit(n)
