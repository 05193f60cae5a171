"""Experiment designs: which configurations to make, made on the driver and returned as a DataFrame."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Design = list[tuple[str, tuple[str, ...]]]
GENERATORS: dict[str, Callable[..., Design]] = {}


def generator(name: str):
    def add(f):
        GENERATORS[name] = f
        return f

    return add


def generate(name: str, **options) -> Design:
    if name not in GENERATORS:
        raise ValueError(f"unknown design {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](**options)


def _config(base: Iterable[str], extra: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({*base, *extra}))


@generator("base_only")
def base_only(base: list[str]) -> Design:
    return [("base", _config(base, ()))]


@generator("add_one")
def add_one(base: list[str], items: list[str]) -> Design:
    return [("base", _config(base, ())), *((f"add:{i}", _config(base, [i])) for i in items if i not in base)]


@generator("leave_one_out")
def leave_one_out(base: list[str], items: list[str]) -> Design:
    return [("all", _config(base, items)), *((f"without:{i}", _config(base, [x for x in items if x != i])) for i in items)]


@generator("coalition")
def coalition(base: list[str], items: list[str], n: int, seed: int = 0, least: int = 2, conflicts: dict[str, set[str]] | None = None) -> Design:
    """``n`` distinct subsets of at least ``least`` items without a conflict: all of them when n reaches their number, else seeded draws."""
    conflicts = conflicts or {}
    allowed = lambda s: not any(b in conflicts.get(a, ()) or a in conflicts.get(b, ()) for a, b in itertools.combinations(s, 2))
    possible = sum(math.comb(len(items), k) for k in range(least, len(items) + 1))
    rng = random.Random(seed)
    if possible <= 100_000:
        every = [s for k in range(least, len(items) + 1) for s in itertools.combinations(sorted(items), k) if allowed(s)]
        if n < len(every):
            rng.shuffle(every)
            every = sorted(every[:n])
    else:
        seen: set[tuple[str, ...]] = set()
        for _ in range(200 * n):  # a bound, should conflicts leave too few
            s = tuple(sorted(rng.sample(items, rng.randint(least, len(items)))))
            if allowed(s):
                seen.add(s)
            if len(seen) == n:
                break
        every = sorted(seen)
    return [("+".join(s), _config(base, s)) for s in every]


@generator("explicit")
def explicit(base: list[str], coalitions: dict[str, list[str]]) -> Design:
    return [(label, _config(base, items)) for label, items in coalitions.items()]


def resolve_conflicts(items: Iterable[str], conflicts: dict[str, set[str]]) -> list[str]:
    """Of two items in conflict the lesser name stays; an item that has gone removes no other."""
    kept: list[str] = []
    for item in sorted(items):
        if not any(item in conflicts.get(k, ()) or k in conflicts.get(item, ()) for k in kept):
            kept.append(item)
    return kept


@generator("leave_one_out_feature")
def leave_one_out_feature(base: list[str], bundles: dict[str, list[str]], conflicts: dict[str, set[str]] | None = None) -> Design:
    names = resolve_conflicts(bundles, conflicts or {})
    funcs = lambda keep: [f for n in keep for f in bundles[n]]
    return [("all", _config(base, funcs(names))), *((f"without:{n}", _config(base, funcs([m for m in names if m != n]))) for n in names)]


@generator("add_one_feature")
def add_one_feature(base: list[str], bundles: dict[str, list[str]]) -> Design:
    return [("base", _config(base, ())), *((f"add:{n}", _config(base, bundles[n])) for n in sorted(bundles) if not set(bundles[n]) <= set(base))]


@generator("coalition_feature")
def coalition_feature(base: list[str], bundles: dict[str, list[str]], n: int, seed: int = 0, conflicts: dict[str, set[str]] | None = None) -> Design:
    return [(label, _config(base, [f for name in label.split("+") for f in bundles[name]])) for label, _ in coalition([], sorted(bundles), n, seed, 2, conflicts)]


def to_frame(spark: SparkSession, design: Design, first_id: int = 1) -> DataFrame:
    """(config_id, label, func_ids); equal configurations are one."""
    seen: dict[tuple[str, ...], str] = {}
    for label, funcs in design:
        seen.setdefault(funcs, label)
    return spark.createDataFrame([(first_id + i, label, list(funcs)) for i, (funcs, label) in enumerate(seen.items())], "config_id bigint, label string, func_ids array<string>")


def validate_features(names: list[str], specs: dict[str, dict], task: str | None = None) -> None:
    """Every feature is known, of this task, with what it requires and without what it excludes."""
    for name in names:
        if name not in specs:
            raise ValueError(f"unknown feature {name!r}")
        spec = specs[name]
        if task and spec.get("task") not in (None, task):
            raise ValueError(f"{name!r} belongs to task {spec['task']!r}")
        for need in spec.get("requires", []):
            if need not in names:
                raise ValueError(f"{name!r} requires {need!r}")
        for other in spec.get("conflicts_with", []):
            if other in names:
                raise ValueError(f"{name!r} conflicts with {other!r}")


def materialize_features(names: list[str], specs: dict[str, dict]) -> dict[str, list[dict]]:
    """The edits of each feature, in order."""
    return {n: list(specs[n].get("primitive_edits", [])) for n in names}
