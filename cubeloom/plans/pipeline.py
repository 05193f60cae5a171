"""The analysis pipeline: source, scope, effect, confidence, filter, rank, render; immutable, with stages cached by hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confidence as ci
from ..operators import effect, resolve
from . import report
from .cube import Cube

STAGES = ("source", "scope", "effect", "confidence", "filter", "rank", "render")


def stage_hash(stage: str, params: dict, upstream: str) -> str:
    return hashlib.sha1(json.dumps([stage, params, upstream], sort_keys=True, default=str).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Pipeline:
    """Each method returns a new pipeline; ``run`` gives the last stage's result."""

    cube: Cube
    params: tuple[tuple[str, tuple], ...] = ()
    cache: dict = field(default_factory=dict)

    def _with(self, stage: str, **params) -> Pipeline:
        kept = dict(self.params)
        kept[stage] = tuple(sorted(params.items()))
        return replace(self, params=tuple(kept.items()))

    def source(self, model: str, scorer: str) -> Pipeline:
        return self._with("source", model=model, scorer=scorer)

    def scope(self, base: int, predicates: tuple[str, ...] | None = None, features: tuple[str, ...] | None = None, numeric: bool = False) -> Pipeline:
        return self._with("scope", base=base, predicates=predicates, features=features, numeric=numeric)

    def effect(self, method: str = "simple", references: tuple = ()) -> Pipeline:
        if method not in ("simple", "marginal"):
            raise ValueError("method is simple or marginal")
        return self._with("effect", method=method, references=references)

    def confidence(self, level: float = 0.95, resamples: int = ci.RESAMPLES, seed: int = ci.SEED) -> Pipeline:
        return self._with("confidence", level=level, resamples=resamples, seed=seed)

    def filter(self, **gates) -> Pipeline:
        return self._with("filter", **gates)

    def rank(self, sort_by: str = "lift", top_k: int | None = None) -> Pipeline:
        return self._with("rank", sort_by=sort_by, top_k=top_k)

    def render(self, fmt: str = "markdown") -> Pipeline:
        return self._with("render", fmt=fmt)

    def stages(self) -> list[str]:
        return [s for s in STAGES if s in dict(self.params)]

    def hashes(self) -> dict[str, str]:
        out, upstream = {}, ""
        for stage in self.stages():
            out[stage] = upstream = stage_hash(stage, dict(dict(self.params)[stage]), upstream)
        return out

    def run(self):
        value = None
        for stage, key in self.hashes().items():
            if key not in self.cache:
                self.cache[key] = getattr(self, f"_{stage}")(value, **dict(dict(self.params)[stage]))
            value = self.cache[key]
        return value

    def _source(self, _, model, scorer):
        return {"model": model, "scorer": scorer}

    def _scope(self, source, base, predicates, features, numeric):
        return {**source, "base": base, "predicates": predicates, "features": features, "numeric": numeric}

    def _effect(self, scope, method, references) -> DataFrame:
        cube, base = self.cube, scope["base"]
        if method == "simple":
            rows = effect.lift_simple(cube, base, scope["model"], scope["scorer"], resolve.simple_effect_configs(cube, base).select("config_id", "canonical_id"))
        else:
            rows = effect.lift_marginal(cube, scope["model"], scope["scorer"])
        rows = rows.join(resolve.base_like_features(cube, base), "canonical_id", "left_anti")
        if scope["predicates"]:
            rows = rows.where(F.col("predicate_name").isin(list(scope["predicates"])))
        if scope["features"]:
            rows = rows.where(F.col("canonical_id").isin(list(scope["features"])))
        if not scope["numeric"]:
            numbers = effect.predicate_kinds(cube).where("kind = 'numeric' and n_values > 8").select(F.col("name").alias("predicate_name"))
            rows = rows.join(numbers, "predicate_name", "left_anti")
        return effect.did(rows, dict(references)).withColumn("_scope", F.lit(json.dumps({k: scope[k] for k in ("model", "scorer", "base")})))

    def _confidence(self, rows, level, resamples, seed) -> DataFrame:
        scope = dict(dict(self.params)["source"]) | dict(dict(self.params)["scope"])
        return ci.attach_ci(rows, self.cube, scope["base"], scope["model"], scope["scorer"], level, resamples, seed, dict(dict(self.params)["effect"])["method"])

    def _filter(self, rows, **gates) -> DataFrame:
        return effect.rank(rows, **gates)

    def _rank(self, rows, sort_by, top_k) -> DataFrame:
        return effect.rank(rows, sort_by=sort_by, top_k=top_k)

    def _render(self, rows, fmt) -> str:
        return report.render([r.asDict() for r in rows.drop("_scope").collect()], fmt)


def feature_predicate_table(
    cube: Cube, model: str, scorer: str, method: str = "simple", metric: str = "lift", base: int | None = None, predicates: tuple[str, ...] | None = None, references: dict[str, str] | None = None, task: str | None = None,
    include_unmatched: bool = False, confidence: bool = False, resamples: int = ci.RESAMPLES, seed: int = ci.SEED, sort_by: str | None = None, top_k: int | None = None, confidence_min: float | None = None,
    min_effect: float | None = None, min_lift_in_pair: float | None = None, skip_numeric: bool = True,
) -> DataFrame:
    """Features by predicate values, in one call of the pipeline's stages: effects, their confidence, gates, order.

    ``include_unmatched`` adds a row without an effect for each feature of the
    task that has none.
    """
    if method not in ("simple", "marginal"):
        raise ValueError("method is simple or marginal")
    if metric not in ("lift", "did"):
        raise ValueError("metric is lift or did")
    if method == "simple" and base is None:
        raise ValueError("the simple method needs a base configuration")
    features = cube.feature if task is None else cube.feature.where(F.col("task") == task)
    staged = Pipeline(cube).source(model, scorer).scope(-1 if base is None else base, predicates, None, not skip_numeric).effect(method, tuple(sorted((references or {}).items())))
    staged = staged.confidence(resamples=resamples, seed=seed) if confidence else staged
    rows = staged.run().join(features.select("canonical_id"), "canonical_id", "left_semi")
    rows = effect.rank(rows, sort_by=sort_by, top_k=top_k, confidence_min=confidence_min, min_effect=min_effect, min_lift_in_pair=min_lift_in_pair, metric=metric).drop("_scope")
    if include_unmatched:
        rows = rows.unionByName(features.select("canonical_id").distinct().join(rows.select("canonical_id"), "canonical_id", "left_anti"), allowMissingColumns=True)
    return rows
