"""Replicates that merge, against draws with replacement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import confidence as C


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, arm int, unit string, value double").withColumn("unit", C.unit_hash(F.col("unit")))


def test_weights_are_poisson_and_unlike_between_resamples():
    w = C.weights(np.arange(20_000) * 214_013 % 2**32, 50)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


def test_interval_is_that_of_a_bootstrap(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(1, 2, 400), rng.normal(0, 1, 400)
    paired = [("p", 1, f"q{i}", float(x)) for i, x in enumerate(a)] + [("p", 0, f"q{i}", float(x)) for i, x in enumerate(b)]
    apart = [("u", 1, f"1:q{i}", float(x)) for i, x in enumerate(a)] + [("u", 0, f"0:q{i}", float(x)) for i, x in enumerate(b)]
    got = {r.g: (r.ci_lo, r.ci_hi, r.p_gt_zero) for r in C.with_interval(C.replicates(table(spark, paired + apart), ["g"], 1000)).collect()}
    assert np.allclose(got["p"], C.paired(a - b), atol=0.05)
    assert np.allclose(got["u"], C.unpaired(a, b), atol=0.05)


def test_parts_merge_to_the_same_replicates(spark, monkeypatch):
    rows = table(spark, [(f"g{i % 3}", i % 2, f"q{i // 6}", float(i % 7)) for i in range(300)])
    one = {r.g: r.diffs for r in C.replicates(rows.coalesce(1), ["g"], 64).collect()}
    many = {r.g: r.diffs for r in C.replicates(rows.repartition(7), ["g"], 64).collect()}
    assert one.keys() == many.keys() == {"g0", "g1", "g2"} and all(np.allclose(one[g], many[g]) for g in one)


def test_too_few_rows_nulls_and_no_rows(spark):
    rows = table(spark, [("one", 1, "a", 1.0), ("one", 0, "a", 0.0), ("two", 1, "a", 1.0), ("two", 1, "b", 1.0), ("two", 0, "a", 0.0), ("two", 0, "b", 0.0), (None, 1, "a", 1.0), ("nothing", 1, "a", None)])
    got = {r.g: r.ci_lo for r in C.with_interval(C.replicates(rows, ["g"], 50)).collect()}
    assert got == {"one": None, "two": 1.0, None: None}
    assert C.replicates(rows.limit(0), ["g"], 50).count() == 0
    with pytest.raises(ValueError):
        C.with_interval(C.replicates(rows, ["g"], 50), 1.0)
