"""Running sums, nearest vectors in blocks, and scoring as executions arrive."""

import numpy as np
from pyspark.sql import functions as F

from cubeloom.functions import scorers
from cubeloom.operators import adaptive, prefix, retrieval
from cubeloom.streaming import scoring


def test_running_sums_and_numbers(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 11).alias("size")).repartition(5)
    want, total = {}, 0
    for k in range(1000):
        want[k], total = total, total + k * 7 % 11
    assert {r.k: r.before for r in prefix.sum_before(rows, ["k"], "size", "before").collect()} == want
    assert {r.k: r.place for r in prefix.numbered(rows, ["k"], "place", 5).collect()} == {k: k + 5 for k in range(1000)}
    got = {r.k: r.granted for r in adaptive.trim_plan(rows, "k", "size", 100).collect()}
    assert got == {k: min(k * 7 % 11, 100 - b) for k, b in want.items() if b < 100} and sum(got.values()) == 100
    assert prefix.numbered(rows.limit(0), ["k"], "place").count() == 0


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (70, 4)).astype(float)
    rows = [(i, v[i].tolist(), f"t{i % 60}") for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, text string")
    got = {}
    for r in retrieval.knn_blocks(df, df.where("vec_id % 3 = 0"), 4, block=16, text="text").collect():
        got.setdefault(r.probe, []).append((r.rank, r.neighbour))
    for p in range(0, 70, 3):
        best = sorted((-float(v[p] @ v[i]), i) for i in range(60) if i != p)[:4]
        assert [i for _, i in sorted(got[p])] == [i for _, i in best]
    assert retrieval.knn_blocks(df.limit(0), df, 3).count() == 0


def nearest(rows, probe, k):
    """By plain Python: rows of (id, numbers or None); null scores last, ties by id."""
    of = dict(rows)[probe]
    score = lambda v: None if v is None or of is None or len(v) != len(of) else round(sum(map(float.__mul__, of, v)), 6)
    found = sorted(((score(v) is None, -(score(v) or 0.0), i) for i, v in rows if i != probe))
    return [i for _, _, i in found[:k]]


def odd_vectors(n=180):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5, 1.0] if i % 3 == 0 else rng.normal(size=4).round(3).tolist()) for i in range(n)]
    return rows[:-4] + [(n - 4, None), (n - 3, [1.0]), (n - 2, [1.0, 2.0]), (n - 1, [])]


def ranked(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.probe, []).append((r.rank, r.neighbour))
    return {p: [i for _, i in sorted(v)] for p, v in got.items()}


def test_knn_blocks_by_tiles_sends_a_vector_once_for_each_tile(spark, monkeypatch):
    for name, size in (("ASKED", 50), ("AGAINST", 40), ("CHUNK", 16)):
        monkeypatch.setattr(retrieval, name, size)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ranked(retrieval.knn_blocks(df, df, 4, block=2)) == {i: nearest(rows, i, 4) for i, _ in rows}
    plan = retrieval.knn_blocks(df, df, 4, block=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan, "pairs of blocks are not rows of a shuffle"


def test_streamed_scores_survive_restarts(spark, tmp_path):
    arrived, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    gold = spark.createDataFrame([(f"q{i}", str(i)) for i in range(4)], "query_id string, gold string")

    def deliver(*rows):
        df = spark.createDataFrame([(e, 1, q, "m", p, err) for e, q, p, err in rows], "execution_id long, config_id long, query_id string, model string, prediction string, error string")
        df.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("execution_id") * 60)).coalesce(1).write.mode("append").parquet(arrived)

    def run():
        scoring.run_available(scoring.scored(scoring.execution_stream(spark, arrived), gold, scorers.exact_match, "em"), out, checkpoint)
        return sorted((r.execution_id, r.score) for r in spark.read.parquet(out).collect())

    deliver((1, "q1", "1", None), (2, "q2", "no", None), (2, "q2", "no", None))
    assert run() == [(1, 1.0), (2, 0.0)]
    assert run() == [(1, 1.0), (2, 0.0)], "a restart without new files scores nothing twice"
    deliver((2, "q2", "2", None), (3, "q3", "3", "timeout"), (4, "unknown", "x", None))
    assert run() == [(1, 1.0), (2, 0.0), (3, 0.0), (4, None)], "what is delivered again keeps its first score"
    batch = scoring.scored(spark.read.parquet(arrived).dropDuplicates(["execution_id", "prediction"]), gold, scorers.exact_match, "em")
    assert batch.count() == 4


def test_probes_meet_vectors_in_matrix_products(spark):
    rows = odd_vectors(120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = retrieval.knn(df, df.where("vec_id % 5 = 0"), 3)
    assert ranked(found) == {i: nearest(rows, i, 3) for i, _ in rows if i % 5 == 0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan, "no pair of vectors is a row"


def test_examples_come_from_matrix_products(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 4)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = retrieval.sample_examples(df, df.where("vec_id % 30 = 0"), k=2, diversity=0.0)
    assert ranked(found) == {p: sorted((i for i in range(90) if i != p), key=lambda i: (-round(float(v[p] @ v[i]), 6), i))[:2] for p in (0, 30, 60)}
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
