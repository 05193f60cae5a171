"""Bootstrap confidence of effects, as replicates that merge.

A resample of n rows gives each row a count that is nearly Poisson with mean 1
and nearly independent of the other rows' counts.  So each row adds its value,
times Poisson weights drawn from a hash of (unit, resample), to a vector with
one sum and one weight a resample.  Vectors of parts of a group add up to the
group's: tasks send one vector for each group that they meet, and no group's
rows ever come together.  The same hash in SQL gives the same replicates, so
results don't depend on partitions or retries.

Rows of one unit in both arms get the same weights (a paired resample); arms of
an unpaired group are hashed apart.  Both kinds may be in one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cube import Cube

SEED, RESAMPLES = 42, 1000
#: Cells of one block of weights, and sums that a task holds before it sends them on.
CELLS = 4_000_000
#: How many tasks first merge the vectors of one group.
SALTS = 32


def bounds(level: float) -> tuple[float, float]:
    if not 0 < level < 1:
        raise ValueError("a confidence level lies between 0 and 1")
    return 50 * (1 - level), 50 * (1 + level)


def interval(lifts: np.ndarray, level: float) -> tuple[float, float, float]:
    lo, hi = np.percentile(lifts, bounds(level))
    return float(lo), float(hi), float((lifts > 0).mean())


# -- weights -------------------------------------------------------------------


def poisson_steps() -> list[int]:
    """The 32-bit numbers from which on a weight is at least 1, 2, 3, ... under a Poisson law of mean 1."""
    steps, p, total, k = [], np.exp(-1.0), 0.0, 0
    while (total := total + p) < 1 - 2.0**-33:
        steps.append(int(total * 2**32))
        k += 1
        p /= k
    return steps


_STEPS = np.array(poisson_steps(), np.uint64)
_GOLDEN, _M1, _M2, _LOW = (np.uint64(x) for x in (2654435761, 2146121005, 2221713035, 0xFFFFFFFF))


def weights(units: np.ndarray, resamples: int, seed: int = SEED) -> np.ndarray:
    """Poisson weights of each unit's 32-bit hash in each resample."""
    at = (np.arange(resamples, dtype=np.uint64) + np.uint64(seed)) * _GOLDEN & _LOW
    x = units.astype(np.uint64)[:, None] ^ at
    x = ((x ^ (x >> np.uint64(16))) * _M1) & _LOW
    x = ((x ^ (x >> np.uint64(15))) * _M2) & _LOW
    x ^= x >> np.uint64(16)
    return np.searchsorted(_STEPS, x.ravel(), side="right").reshape(x.shape)


def weight_sql(unit: str, resample: str, seed: int = SEED) -> str:
    """The weight in SQL with unsigned 64-bit numbers, for an oracle."""
    x = f"xor({unit}, (({resample} + {seed}) * 2654435761::UBIGINT) & 4294967295)"
    for shift, by in ((16, 2146121005), (15, 2221713035)):
        x = f"list_transform([{x}], lambda x: (xor(x, x >> {shift}) * {by}::UBIGINT) & 4294967295)[1]"
    x = f"list_transform([{x}], lambda x: xor(x, x >> 16))[1]"
    return f"list_transform([{x}], lambda x: len(list_filter({[int(s) for s in _STEPS]}, lambda s: x >= s)))[1]"


def unit_hash(unit: Column, arm: Column | None = None) -> Column:
    """The 32-bit hash that a unit's weights come from; with an arm, each arm has its own."""
    named = unit.cast("string") if arm is None else F.concat(arm.cast("string"), F.lit(":"), unit.cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")


# -- vectors -------------------------------------------------------------------

_VECTOR = "group_key string, n array<long>, sums array<double>, weights array<double>"


def _partial(resamples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        step = max(1, CELLS // resamples)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                coded = part.column(0).dictionary_encode()
                code, arm = np.asarray(coded.indices), np.asarray(part.column(1)).astype(np.int64)
                unit, value = np.asarray(part.column(2)), np.asarray(part.column(3))
                w = weights(unit, resamples, seed).astype(np.float64)
                for g in np.unique(code):
                    n, sums, total = held.setdefault(coded.dictionary[int(g)].as_py(), (np.zeros(2, np.int64), np.zeros((2, resamples)), np.zeros((2, resamples))))
                    for a in (0, 1):
                        rows = (code == g) & (arm == a)
                        n[a] += rows.sum()
                        sums[a] += value[rows] @ w[rows]
                        total[a] += w[rows].sum(axis=0)
                if len(held) * resamples > CELLS:
                    yield _batch(held)
                    held = {}
        if held:
            yield _batch(held)

    return run


def _batch(held: dict) -> pa.RecordBatch:
    lists = lambda i, kind: pa.array([v[i].ravel() for v in held.values()], pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array(list(held)), lists(0, pa.int64()), lists(1, pa.float64()), lists(2, pa.float64())], names=["group_key", "n", "sums", "weights"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the vectors of equal groups of one partition."""
    held: dict[str, tuple] = {}
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("n", "sums", "weights")]
        for i, key in enumerate(batch.column(0).to_pylist()):
            new = [c[i].values.to_numpy(zero_copy_only=False) for c in columns]
            held[key] = tuple(a + b for a, b in zip(held[key], new)) if key in held else tuple(new)
    if held:
        yield _batch(held)


def replicates(rows: DataFrame, keys: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``keys, n, diffs``: for each group the number of rows of each arm and the replicates of the difference of means.

    ``rows`` has the keys, ``arm`` (0 or 1), ``unit`` (as of ``unit_hash``) and
    ``value``; the difference is arm 1's mean less arm 0's.  A replicate in
    which an arm has no weight is left out.  Null values are no rows.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    flat = rows.dropna(subset=["value"]).select(key.alias("group_key"), F.col("arm").cast("int").alias("arm"), "unit", F.col("value").cast("double").alias("value"))
    parts = flat.mapInArrow(_partial(resamples, seed), _VECTOR).withColumn("salt", F.spark_partition_id() % SALTS)
    merged = parts.repartition("group_key", "salt").select("group_key", "n", "sums", "weights").mapInArrow(_merge, _VECTOR).repartition("group_key").mapInArrow(_merge, _VECTOR)
    mean = lambda at: F.try_divide(F.element_at("sums", at), F.element_at("weights", at))
    diffs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: mean(b + resamples) - mean(b)), lambda d: d.isNotNull())
    return merged.select(F.from_json("group_key", kinds).alias("k"), "n", F.array_sort(diffs).alias("diffs")).select("k.*", "n", "diffs")


def _quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation between the two nearest of a sorted array."""
    place = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    at = lambda i: F.get(sorted_values, i)
    return at(low) + (place - low) * (at(F.least(low + 1, F.size(sorted_values) - 1)) - at(low))


def with_interval(found: DataFrame, level: float = 0.95) -> DataFrame:
    """``ci_lo, ci_hi, p_gt_zero`` of replicates; undefined where an arm has fewer than two rows."""
    lo, hi = bounds(level)
    enough = (F.get("n", F.lit(0)) >= 2) & (F.get("n", F.lit(1)) >= 2) & (F.size("diffs") > 0)
    above = F.size(F.filter("diffs", lambda d: d > 0)) / F.size("diffs")
    return found.withColumns({"ci_lo": F.when(enough, _quantile(F.col("diffs"), lo / 100)), "ci_hi": F.when(enough, _quantile(F.col("diffs"), hi / 100)), "p_gt_zero": F.when(enough, above)}).drop("n", "diffs")


# -- small arrays --------------------------------------------------------------


def paired(deltas, level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float | None, ...]:
    """Interval and P(lift > 0) of a mean paired difference of one small group; undefined under two pairs."""
    deltas = np.asarray(deltas, dtype=float)
    return (None, None, None) if len(deltas) < 2 else interval(_means(deltas, np.random.default_rng(seed), resamples), level)


def unpaired(target, base, level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float | None, ...]:
    target, base = np.asarray(target, dtype=float), np.asarray(base, dtype=float)
    if len(target) < 2 or len(base) < 2:
        return None, None, None
    rng = np.random.default_rng(seed)
    return interval(_means(target, rng, resamples) - _means(base, rng, resamples), level)


def _means(values: np.ndarray, rng: np.random.Generator, resamples: int) -> np.ndarray:
    out, step = [], max(1, CELLS // len(values))
    for at in range(0, resamples, step):
        n = min(step, resamples - at)
        out.append(values[rng.integers(0, len(values), (n, len(values)))].mean(axis=1))
    return np.concatenate(out)


# -- on effects ----------------------------------------------------------------

KEYS = ["canonical_id", "predicate_name", "predicate_value"]


def paired_arms(cube: Cube, base: int, model: str, scorer: str, configs: DataFrame | None = None) -> DataFrame:
    """Rows of ``replicates`` for ``lift_simple``: queries that the target and the base share, both arms hashed alike."""
    if configs is None:
        configs = cube.config.where(F.col("kind") == "add_one_feature").select("config_id", "canonical_id")
    scored = cube.scored_executions(model, scorer)
    arm = scored.where(F.col("config_id") == base).select("query_id", "predicate_name", "predicate_value", F.col("score").alias("base_score"))
    pairs = scored.join(configs, "config_id").join(arm, ["query_id", "predicate_name", "predicate_value"])
    both = F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("score").alias("value")), F.struct(F.lit(0).alias("arm"), F.col("base_score").alias("value"))))
    return pairs.select(*KEYS, unit_hash(F.col("query_id")).alias("unit"), both.alias("x")).select(*KEYS, "x.arm", "unit", "x.value")


def unpaired_arms(cube: Cube, base: int, model: str, scorer: str) -> DataFrame:
    """Rows of ``replicates`` for ``lift_simple`` whose arms are all their own queries, shared or not, hashed apart."""
    configs = cube.config.where(F.col("kind") == "add_one_feature").select("config_id", "canonical_id")
    scored = cube.scored_executions(model, scorer)
    arm = lambda rows, a: rows.select(*KEYS, F.lit(a).alias("arm"), unit_hash(F.col("query_id"), F.lit(a)).alias("unit"), F.col("score").alias("value"))
    target = scored.join(configs, "config_id")
    cells = target.select(*KEYS).distinct()
    return arm(target, 1).unionByName(arm(scored.where(F.col("config_id") == base).join(cells, KEYS[1:]), 0))


def marginal_arms(cube: Cube, model: str, scorer: str, predicate: str | None = None) -> DataFrame:
    """Rows of ``replicates`` for ``lift_marginal``: means of configurations with and without a feature, the arms hashed apart."""
    means = cube.per_config_predicate_means(model, scorer, predicate)
    held = cube.config.select("config_id", F.explode_outer("feature_ids").alias("feature_id")).join(cube.feature.select("feature_id", "canonical_id"), "feature_id", "left")
    sets = held.groupBy("config_id").agg(F.collect_set("canonical_id").alias("has"))
    names = cube.feature.agg(F.collect_set("canonical_id").alias("names"))
    with_all = means.join(sets, "config_id").join(names).select("*", F.explode("names").alias("canonical_id"))
    arm = F.array_contains("has", F.col("canonical_id")).cast("int")
    return with_all.select(*KEYS, arm.alias("arm"), unit_hash(F.col("config_id"), arm).alias("unit"), F.col("avg_score").alias("value"))


def attach_ci(effects: DataFrame, cube: Cube, base: int, model: str, scorer: str, level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED, method: str = "simple") -> DataFrame:
    """``effects`` with ci_lo, ci_hi, p_gt_zero and effect_lb, paired over queries (``simple``) or between configurations (``marginal``)."""
    bounds(level)
    if method not in ("simple", "marginal"):
        raise ValueError("method is simple or marginal")
    rows = paired_arms(cube, base, model, scorer) if method == "simple" else marginal_arms(cube, model, scorer)
    found = with_interval(replicates(rows.join(effects.select(*KEYS).distinct(), KEYS, "left_semi"), KEYS, resamples, seed), level)
    return effects.join(found, KEYS, "left").withColumn("effect_lb", F.col("ci_lo"))


def hashed_bootstrap(pairs: DataFrame, keys: list[str], resamples: int = 200, level: float = 0.9, seed: int = SEED) -> DataFrame:
    """Interval of a mean paired difference; ``pairs`` has the keys, query_id and delta."""
    one = pairs.select(*keys, unit_hash(F.col("query_id")).alias("unit"), F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("delta").alias("value")), F.struct(F.lit(0).alias("arm"), F.lit(0.0).alias("value")))).alias("x"))
    return with_interval(replicates(one.select(*keys, "x.arm", "unit", "x.value"), keys, resamples, seed), level)
