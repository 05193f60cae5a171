import pytest
from pyspark.sql import functions as F

from cubeloom.functions import scorers
from cubeloom.plans import schema
from cubeloom.sources import runtime
from cubeloom.sources.store import CubeStore, OnConflict


@pytest.fixture()
def store(spark, tmp_path):
    return CubeStore(spark, f"file://{tmp_path}/cube")


def preds(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, name string, value string")


def test_merge_policies(spark, store):
    store.merge("predicate", preds(spark, ("q1", "a", "1"), ("q1", "a", "1")))
    with pytest.raises(ValueError):
        store.merge("predicate", preds(spark, ("q1", "a", "2")))
    store.merge("predicate", preds(spark, ("q1", "a", "2"), ("q2", "a", "3")), OnConflict.SKIP)
    assert {tuple(r) for r in store.table("predicate").collect()} == {("q1", "a", "1"), ("q2", "a", "3")}
    store.merge("predicate", preds(spark, ("q1", "a", "9")), OnConflict.REPLACE)
    assert {tuple(r) for r in store.table("predicate").collect()} == {("q1", "a", "9"), ("q2", "a", "3")}
    with pytest.raises(PermissionError):
        CubeStore(spark, store.root, read_only=True).merge("predicate", preds(spark, ("q3", "a", "1")))


def test_configs_are_content_addressed(spark, store):
    wanted = spark.createDataFrame([(["b", "a"],), (["a", "b"],), (["c"],)], "func_ids array<string>")
    first = {r.key: r.config_id for r in store.get_or_create_configs(wanted).collect()}
    again = {r.key: r.config_id for r in store.get_or_create_configs(wanted).collect()}
    assert len(first) == 2 and first == again and store.table("config").count() == 2


def test_run_and_evaluate(spark, store):
    plan = spark.createDataFrame([(1, "q1", "m"), (1, "q2", "m")], "config_id bigint, query_id string, model string")

    def responder(row):
        if row["query_id"] == "q2":
            raise RuntimeError("no answer")
        return {"text": "Yes", "latency_ms": 5}

    runtime.run_plan(store, plan, responder, phase="p")
    runtime.run_plan(store, plan, responder, phase="p")
    assert store.table("execution").count() == 2
    gold = spark.createDataFrame([("q1", "yes"), ("q2", "no")], "query_id string, gold string")
    for _ in range(2):
        runtime.evaluate(store, "em", scorers.exact_match, gold)
    rows = store.table("evaluation").join(store.table("execution").select("execution_id", "query_id", "error"), "execution_id").collect()
    assert {(r.query_id, r.score) for r in rows} == {("q1", 1.0), ("q2", 0.0)}
    store.tag_phase(store.table("execution").select("execution_id"), "p")
    store.tag_phase(store.table("execution").select("execution_id"), "late")
    assert all(r.phase_ids == ["p", "late"] for r in store.table("execution").collect())


def test_empty_tables(store):
    assert all(store.table(n).count() == 0 for n in schema.TABLES)
    assert store.table("execution").agg(F.max("score") if "score" in store.table("execution").columns else F.count("*")).first()[0] == 0


def files(store, name):
    import pathlib

    root = pathlib.Path(store.root.removeprefix("file://")) / name
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def test_only_what_changes_is_written(spark, store):
    many = [(f"q{i}", "a", str(i)) for i in range(200)]
    store.merge("predicate", preds(spark, *many))
    before = files(store, "predicate")
    store.merge("predicate", preds(spark, ("new", "a", "x")), OnConflict.SKIP)
    assert before < files(store, "predicate") and len(files(store, "predicate")) == len(before) + 1, "a merge appends"
    before = files(store, "predicate")
    store.merge("predicate", preds(spark, ("q7", "a", "seven")), OnConflict.REPLACE)
    left = before & files(store, "predicate")
    assert len(before - left) <= 2, "a replacement writes one folder anew"
    got = {r.query_id: r.value for r in store.table("predicate").collect()}
    assert len(got) == 201 and got["q7"] == "seven" and got["q8"] == "8" and got["new"] == "x"


def test_deletions_empty_a_folder(spark, store):
    store.merge("predicate", preds(spark, ("q1", "a", "1")))
    store.rewrite("predicate", preds(spark, ("q1", "a", "whatever")))
    assert store.table("predicate").count() == 0


def test_warnings_and_features(spark, store):
    store.merge("predicate", preds(spark, ("q1", "a", "1")))
    with pytest.warns(UserWarning, match="1 rows"):
        store.merge("predicate", preds(spark, ("q1", "a", "2"), ("q2", "a", "2")), OnConflict.WARN)
    assert store.table("predicate").where("value = '1'").count() == 1 and store.table("predicate").count() == 2
    features = spark.createDataFrame([("f1", "one"), ("f2", "two")], "feature_id string, canonical_id string")
    labels = lambda *rows: spark.createDataFrame(list(rows), "feature_id string, label_id string, role string")
    store.sync_features(features, labels(("f1", "a", "r"), ("f2", "b", "r")))
    store.sync_features(features.where("feature_id = 'f1'"), labels(("f1", "c", "r")))
    assert {(r.feature_id, r.label_id) for r in store.table("feature_label_membership").collect()} == {("f1", "c"), ("f2", "b")}


def test_ids_go_on(spark, store):
    rows = spark.range(500).select(F.lit(1).alias("config_id"), F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("query_id"), F.lit("m").alias("model")).repartition(7)
    store.merge("execution", store.next_ids("execution", "execution_id", rows, "query_id"))
    assert [r.execution_id for r in store.table("execution").orderBy("query_id").collect()] == list(range(1, 501))
    more = rows.withColumn("model", F.lit("n"))
    store.merge("execution", store.next_ids("execution", "execution_id", more, "query_id"))
    assert sorted(r.execution_id for r in store.table("execution").where("model = 'n'").collect()) == list(range(501, 1001))


def test_predicates_are_seeded(spark, store):
    from cubeloom.functions import predicates as P

    store.merge("query", spark.createDataFrame([("q1", "d", "how many?"), ("q2", "e", None)], "query_id string, dataset string, content string"))
    for _ in range(2):
        store.seed_predicates(P.task_predicates("table", F.col("content")), only=["is_count", "operation_type"])
    got = {(r.query_id, r.name): r.value for r in store.table("predicate").collect()}
    assert got == {("q1", "is_count"): "yes", ("q1", "operation_type"): "count", ("q2", "is_count"): "unknown", ("q2", "operation_type"): "unknown"}
