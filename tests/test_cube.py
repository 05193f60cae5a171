"""Published numbers of a small cube: three configurations, four queries, one predicate."""

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import compare, confidence, effect, inventory, resolve
from cubeloom.plans.cube import Cube
from cubeloom.plans.pipeline import Pipeline
from cubeloom.plans.query import ExecutionQuery

M, SC = "test-model", "exact_match"
SCORES = {1: [0, 0, 1, 1], 2: [1, 1, 1, 1], 3: [0, 0, 0, 0]}


@pytest.fixture(scope="module")
def cube(spark):
    make = spark.createDataFrame
    execution, evaluation = [], []
    for config, scores in SCORES.items():
        for i, score in enumerate(scores):
            key = config * 10 + i
            execution.append((key, config, f"q{i + 1}", M, 100.0, None, ["p1"], "x", "x"))
            evaluation.append((key, key, SC, float(score), "{}"))
    execution.append((91, 3, "q1", "second-model", 100.0, "boom", ["p2"], None, None))
    execution.append((92, 1, "q1", "second-model", 100.0, "", ["p2"], "y", "y"))
    evaluation.append((92, 92, SC, 0.5, "{}"))
    predicate = [(f"q{i}", "has_agg", "true" if i < 3 else "false") for i in (1, 2, 3, 4)]
    return Cube(
        func=make([("fa", "insert_node", "{}"), ("fb", "insert_node", "{}")], "func_id string, func_type string, params string"),
        query=make([(f"q{i}", "wtq", "t", "dev", "x", "en") for i in (1, 2, 3, 4)], "query_id string, dataset string, content string, split string, qtype string, lang string"),
        config=make([(1, "", "base", [], []), (2, "feat_a", "add_one_feature", ["fa"], ["ha"]), (3, "feat_b", "add_one_feature", ["fb"], ["hb"])], "config_id bigint, canonical_id string, kind string, func_ids array<string>, feature_ids array<string>"),
        execution=make(execution, "execution_id bigint, config_id bigint, query_id string, model string, latency_ms double, error string, phase_ids array<string>, prediction string, raw_response string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")),
        evaluation=make(evaluation, "eval_id bigint, execution_id bigint, scorer string, score double, metrics string"),
        predicate=make(predicate, "query_id string, name string, value string"),
        feature=make([("ha", "feat_a", "table_qa", ["fa"]), ("hb", "feat_b", "table_qa", ["fb"])], "feature_id string, canonical_id string, task string, func_ids array<string>"),
        config_feature=make([(2, "ha", "feature"), (3, "hb", "feature")], "config_id bigint, feature_id string, role string"),
        label_membership=make([("ha", "l", "implements")], "feature_id string, label_id string, role string"),
    )


def test_score_diff(cube):
    r = compare.score_diff(cube, 1, 2, M, SC).first()
    assert (r.n_shared, r.avg_delta, r.n_up, r.n_down) == (4, 0.5, 2, 0)
    r = compare.score_diff(cube, 1, 3, M, SC).first()
    assert (r.avg_delta, r.n_up, r.n_down) == (-0.5, 0, 2)


def test_score_diff_without_shared_queries(cube):
    r = compare.score_diff(cube, 1, 99, M, SC).first()
    assert (r.n_a, r.n_b, r.n_shared, r.avg_a, r.avg_delta) == (4, 0, 0, 0.0, 0.0)


def test_flips(cube):
    assert {r.query_id for r in compare.help_cases(cube, 1, 2, M, SC).collect()} == {"q1", "q2"}
    assert {r.query_id for r in compare.harm_cases(cube, 1, 3, M, SC).collect()} == {"q3", "q4"}


def test_add_one_deltas_order(cube):
    assert [r.canonical_id for r in compare.add_one_deltas(cube, 1, M, SC).collect()] == ["feat_a", "feat_b"]


def test_feature_ranking(cube):
    assert [(r.canonical_id, r.avg_score) for r in compare.feature_effect_ranking(cube, M, SC).collect()] == [("feat_a", 1.0), ("feat_b", 0.0)]


def test_predicate_slice(cube):
    assert compare.predicate_slice(cube, M, SC, "has_agg").count() == 6


def lifts(cube):
    return effect.did(effect.lift_simple(cube, 1, M, SC))


def test_lift_and_did(cube):
    got = {(r.canonical_id, r.predicate_value): (r.lift, r.did) for r in lifts(cube).collect()}
    assert got == {("feat_a", "true"): (1.0, 1.0), ("feat_a", "false"): (0.0, 0.0), ("feat_b", "true"): (0.0, 1.0), ("feat_b", "false"): (-1.0, 0.0)}


def test_marginal_lift(cube):
    got = {(r.canonical_id, r.predicate_value): (r.lift, r.did) for r in effect.did(effect.lift_marginal(cube, M, SC)).collect()}
    assert got == {("feat_a", "true"): (1.0, 0.5), ("feat_a", "false"): (0.5, 0.0), ("feat_b", "true"): (-0.5, 0.5), ("feat_b", "false"): (-1.0, 0.0)}


def test_bootstrap(cube):
    got = {(r.canonical_id, r.predicate_value): (r.ci_lo, r.ci_hi, r.p_gt_zero) for r in confidence.attach_ci(lifts(cube), cube, 1, M, SC).collect()}
    assert got[("feat_a", "true")] == (1.0, 1.0, 1.0)
    assert got[("feat_a", "false")] == (0.0, 0.0, 0.0)
    assert got[("feat_b", "false")] == (-1.0, -1.0, 0.0)


def test_bootstrap_needs_two_pairs():
    assert confidence.paired([1.0]) == (None, None, None)
    assert confidence.unpaired([1.0, 2.0], [1.0]) == (None, None, None)
    with pytest.raises(ValueError):
        confidence.bounds(1.0)


def test_profile_is_selective(cube):
    row = next(r for r in effect.feature_profile(lifts(cube)).collect() if r.canonical_id == "feat_a")
    assert row.classification == "selective" and row.max_abs_did > 0.5


def test_overlap_of_a_copied_predicate(cube, spark):
    from dataclasses import replace

    copy = cube.predicate.withColumn("name", F.lit("z_copy"))
    found = effect.predicate_overlap(replace(cube, predicate=cube.predicate.unionByName(copy))).collect()
    assert len(found) == 2 and all(r.jaccard == 1.0 for r in found)


def test_errors_have_two_populations(cube):
    assert cube.query_scores("second-model").count() == 1
    assert inventory.unevaluated(cube, SC).count() == 1


def test_simple_effect_configs(cube):
    assert {(r.canonical_id, r.config_id) for r in resolve.simple_effect_configs(cube, 1).collect()} == {("feat_a", 2), ("feat_b", 3)}


def test_query_builder_is_immutable_and_empty_lists_do_not_filter(cube):
    q = ExecutionQuery(cube)
    assert q.model(M).count() == 12 and q.count() == 14
    assert q.configs([]).count() == 14
    assert q.with_error().count() == 1
    assert q.phase("p2").count() == 2
    with pytest.raises(ValueError):
        q.where_score("~", 1)


def test_rank_arguments(cube):
    rows = lifts(cube)
    for bad in ({"metric": "nope"}, {"top_k": -1}, {"require_sign": "up"}, {"confidence_min": 0.5}, {"sort_by": "nope"}):
        with pytest.raises(ValueError):
            effect.rank(rows, **bad)


def test_pipeline_shares_stages_and_renders(cube):
    p = Pipeline(cube).source(M, SC).scope(1).effect()
    text = p.rank("lift", 2).render().run()
    assert "feat_a" in text and len(p.cache) == 5
    assert p.hashes()["effect"] == p.rank("did").hashes()["effect"]
    assert p.rank("lift").render("html").run().startswith("<!doctype html>")


def test_a_missing_configuration_names_its_neighbours(cube):
    from cubeloom.operators import resolve

    assert resolve.config_by_features(cube, ["feat_a"]) == 2
    with pytest.raises(ValueError, match="no such feature: nothing"):
        resolve.config_by_features(cube, ["feat_a", "nothing"])
    with pytest.raises(ValueError, match="nearest: 2 lacks 1 and has 0 more; 3 lacks 1 and has 0 more"):
        resolve.config_by_features(cube, ["feat_a", "feat_b"])
