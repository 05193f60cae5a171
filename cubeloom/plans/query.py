"""Chainable execution queries: an immutable set of filters that compiles to one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cube import Cube, no_error

_OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
#: Lists of values beyond this length become a join.
_INLINE = 200


def _order(text: str) -> Column:
    expression, _, way = text.strip().rpartition(" ")
    if way.lower() not in ("asc", "desc"):
        return F.expr(text).asc_nulls_first()
    return F.expr(expression).asc_nulls_first() if way.lower() == "asc" else F.expr(expression).desc_nulls_last()


@dataclass(frozen=True)
class ExecutionQuery:
    """Nothing runs before a terminal: count, rows, df, agg."""

    cube: Cube
    in_lists: tuple[tuple[str, tuple], ...] = ()
    tags: tuple[str, ...] = ()
    scorer_name: str | None = None
    with_all: tuple[tuple[str, tuple], ...] = ()
    with_any: tuple[tuple[str, tuple], ...] = ()
    predicates: tuple[tuple[str, str | None], ...] = ()
    score_tests: tuple[tuple[str, float], ...] = ()
    errors: bool | None = None
    shown: tuple[str, ...] = ()
    ordering: tuple[str, ...] = ()
    most: int | None = None
    _: None = field(default=None, repr=False)

    def _also(self, name: str, *values) -> ExecutionQuery:
        return replace(self, **{name: getattr(self, name) + values})

    def _in(self, column: str, values) -> ExecutionQuery:
        values = tuple(values)
        return self._also("in_lists", (column, values)) if values else self

    def phase(self, tag: str) -> ExecutionQuery:
        return self._also("tags", tag)

    def phases(self, tags) -> ExecutionQuery:
        return self._also("tags", *tags)

    def config(self, config_id: int) -> ExecutionQuery:
        return self._in("config_id", [config_id])

    def configs(self, ids) -> ExecutionQuery:
        return self._in("config_id", ids)

    def model(self, model: str) -> ExecutionQuery:
        return self._in("model", [model])

    def models(self, models) -> ExecutionQuery:
        return self._in("model", models)

    def query(self, query_id: str) -> ExecutionQuery:
        return self._in("query_id", [query_id])

    def queries(self, ids) -> ExecutionQuery:
        return self._in("query_id", ids)

    def scorer(self, name: str) -> ExecutionQuery:
        return replace(self, scorer_name=name)

    def has_func(self, func_id: str) -> ExecutionQuery:
        return self._also("with_all", ("func_ids", (func_id,)))

    def has_all_funcs(self, ids) -> ExecutionQuery:
        return self._also("with_all", ("func_ids", tuple(ids)))

    def has_any_func(self, ids) -> ExecutionQuery:
        return self._also("with_any", ("func_ids", tuple(ids)))

    def has_feature(self, canonical_id: str) -> ExecutionQuery:
        return self._also("with_all", ("canonical_ids", (canonical_id,)))

    def has_all_features(self, ids) -> ExecutionQuery:
        return self._also("with_all", ("canonical_ids", tuple(ids)))

    def has_any_feature(self, ids) -> ExecutionQuery:
        return self._also("with_any", ("canonical_ids", tuple(ids)))

    def predicate(self, name: str, value: str | None = None) -> ExecutionQuery:
        return self._also("predicates", (name, value))

    def where_score(self, op: str, value: float) -> ExecutionQuery:
        if op not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        return self._also("score_tests", (op, value))

    def with_error(self) -> ExecutionQuery:
        return replace(self, errors=True)

    def without_error(self) -> ExecutionQuery:
        return replace(self, errors=False)

    def columns(self, names) -> ExecutionQuery:
        return replace(self, shown=tuple(names))

    def order_by(self, *expressions: str) -> ExecutionQuery:
        return replace(self, ordering=expressions)

    def limit(self, n: int) -> ExecutionQuery:
        return replace(self, most=n)

    # -- compilation ---------------------------------------------------------

    def _filtered(self, with_scores: bool) -> DataFrame:
        cube, out = self.cube, self.cube.execution
        merged: dict[str, set] = {}
        for column, values in self.in_lists:
            merged.setdefault(column, set()).update(values)
        for column, values in merged.items():
            if len(values) <= _INLINE:
                out = out.where(F.col(column).isin(sorted(values)))
            else:
                kind = out.schema[column].dataType.simpleString()
                out = out.join(cube.spark.createDataFrame([(v,) for v in sorted(values)], f"{column} {kind}"), column, "left_semi")
        if self.tags:
            out = out.where(F.arrays_overlap("phase_ids", F.array(*map(F.lit, self.tags))))
        if self.errors is not None:
            out = out.where(~no_error() if self.errors else no_error())
        if self.with_all or self.with_any:
            out = out.join(self._configs(), "config_id", "left_semi")
        for name, value in self.predicates:
            p = cube.predicate.where(F.col("name") == name)
            out = out.join(p if value is None else p.where(F.col("value") == value), "query_id", "left_semi")
        if with_scores or self.scorer_name is not None or self.score_tests:
            scores = cube.evaluation if self.scorer_name is None else cube.evaluation.where(F.col("scorer") == self.scorer_name)
            # the scorer belongs to the join: executions without a score stay
            out = out.join(scores.select("execution_id", "eval_id", "scorer", "score", "metrics"), "execution_id", "left")
        for op, value in self.score_tests:
            out = out.where(getattr(F.col("score"), _OPS[op])(value))
        return out

    def _configs(self) -> DataFrame:
        config = self.cube.config.select("config_id", "func_ids", "feature_ids")
        if any(c == "canonical_ids" for c, _ in self.with_all + self.with_any):
            named = config.select("config_id", F.explode("feature_ids").alias("feature_id")).join(self.cube.feature.select("feature_id", "canonical_id"), "feature_id")
            config = config.join(named.groupBy("config_id").agg(F.collect_set("canonical_id").alias("canonical_ids")), "config_id")
        for column, ids in self.with_all:
            config = config.where(F.size(F.array_except(F.array(*map(F.lit, ids)), column)) == 0)
        for column, ids in self.with_any:
            config = config.where(F.arrays_overlap(column, F.array(*map(F.lit, ids))))
        return config.select("config_id")

    def df(self) -> DataFrame:
        """The selected rows, lazily."""
        out = self._filtered(any(c in ("score", "metrics", "scorer", "eval_id") for c in self.shown))
        if self.ordering:
            out = out.orderBy(*map(_order, self.ordering))
        if self.most is not None:
            out = out.limit(self.most)
        return out.selectExpr(*self.shown) if self.shown else out

    def count_df(self) -> DataFrame:
        return self._filtered(False).agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.count_df().first()["n"]

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df().collect()]

    def agg(self, by=("config_id",), fn: str = "avg", metric: str = "score") -> DataFrame:
        if fn not in _AGGREGATES:
            raise ValueError(f"unknown aggregate {fn!r}")
        value: Column = F.lit(1) if metric == "*" else F.col(metric)
        rows = self._filtered(metric == "score")
        aggregates = [_AGGREGATES[fn](value).alias(f"{fn}_{'all' if metric == '*' else metric}"), F.count("*").alias("n")]
        return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)

    def explain(self) -> str:
        return self.df()._jdf.queryExecution().toString()
