"""Databases, numbered lines and readers, on files that the tests write."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from cubeloom.sources import benchmarks, databases
from cubeloom.sources.numbered import numbered_lines


@pytest.fixture(scope="module")
def dbs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dbs")
    with sqlite3.connect(root / "zoo.sqlite") as con:
        con.executescript("""
            CREATE TABLE Keeper (id INTEGER PRIMARY KEY, "full name" TEXT NOT NULL, born DATE);
            CREATE TABLE animal (id INTEGER, keeper INT REFERENCES Keeper(id), weight REAL, height REAL, FOREIGN KEY (keeper) REFERENCES cage(id));
            CREATE TABLE cage (id INTEGER, "size-m" NUMERIC);
            INSERT INTO animal VALUES (1, 1, 2.5, 3), (2, 1, 4, 5);""")
    con.close()
    with sqlite3.connect(root / "small.sqlite") as con:
        con.execute("CREATE TABLE t (a TEXT, b)")
    con.close()
    (root / "broken.sqlite").write_bytes(b"no database" * 100)
    return databases.read_sqlite(spark, f"file://{root}/*.sqlite")


def test_databases_are_described(dbs):
    assert {(r.db, r.table, r.n_rows) for r in dbs.sizes.collect()} == {("zoo", "Keeper", 0), ("zoo", "animal", 2), ("zoo", "cage", 0), ("small", "t", 0)}
    assert {(r.table, r.column, r.other_table) for r in dbs.keys.collect()} == {("animal", "keeper", "Keeper"), ("animal", "keeper", "cage")}
    schema = {r.db: r.schema for r in databases.schema_text(dbs).collect()}
    assert schema["small"] == "CREATE TABLE `t` (\n    `a` TEXT,\n    `b` TEXT\n);"
    assert schema["zoo"].startswith("CREATE TABLE `Keeper` (\n    `id` INTEGER PRIMARY KEY,\n    `full name` TEXT NOT NULL,\n    `born` DATE\n);\n\nCREATE TABLE `animal`")


def test_database_flags(dbs):
    got = {r.db: {k for k, v in r.asDict().items() if v == "yes"} for r in databases.flags(dbs).collect()}
    assert got["zoo"] == {"has_date_col", "has_real_col", "has_special_cols", "ambiguous_cols", "col_has_space", "col_has_hyphen"}
    assert got["small"] == {"text_heavy"}


def test_neighbours_by_foreign_key(spark, dbs):
    ask = lambda *ts: {r.table for r in databases.neighbours(dbs, spark.createDataFrame([("zoo", t) for t in ts], "db string, table string")).collect()}
    assert ask("CAGE") == {"cage", "animal"} and ask("animal") == {"Keeper", "animal", "cage"} and ask("nothing") == set()


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\n\nthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in numbered_lines(spark, f"file://{tmp_path}").collect())
            assert got == [("a.txt", i + 1, x) for i, x in enumerate(lines)] + [("b.txt", i + 1, x) for i, x in enumerate(["only", "", "three"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def written(tmp_path, name, rows, array=False):
    (tmp_path / name).write_text(json.dumps(rows) if array else "\n".join(json.dumps(r) for r in rows))
    return f"file://{tmp_path}/{name}"


def metas(df):
    return [(r.query_id, r.content, json.loads(r.meta)) for r in df.collect()]


def test_table_bench_keeps_repeated_rows_apart(spark, tmp_path):
    row = {"id": "x", "qtype": "FactChecking", "qsubtype": "Match", "question": "how many?", "answer": "3", "instruction": "Say it", "instruction_type": "DP", "table": {"columns": ["a"], "data": [["1"]]}}
    path = written(tmp_path, "tb.jsonl", [row, row, row | {"qtype": "Visualization"}, row | {"answer": None, "response": "Final Answer: 1\nFinal Answer: 42", "instruction_type": "TCoT"}])
    got = metas(benchmarks.read_table_bench(spark, path))
    assert len({g[0] for g in got}) == 3 and sorted(m["source_line"] for _, _, m in got) == [1, 2, 4]
    assert {m["source_line"]: m["gold_answer"] for _, _, m in got}[4] == "42" and got[0][2]["_raw"]["table"] == {"header": ["a"], "rows": [["1"]]}
    assert len(metas(benchmarks.read_table_bench(spark, path, instruction_types=(" TCoT ", "")))) == 1
    verbatim = metas(benchmarks.read_verbatim_prompts(spark, path, "DP", plots=True))
    assert len(verbatim) == 4 and {c for _, c, _ in verbatim} == {"how many?"} and verbatim[0][2]["instruction"] == "Say it"
    with pytest.raises(ValueError):
        benchmarks.read_verbatim_prompts(spark, path, "other")


def test_hierarchical_tables_come_as_literals(spark, tmp_path):
    table = {"title": "it's \"so\"", "texts": [["a", None], ["1", True]], "n": 2}
    path = written(tmp_path, "h.jsonl", [{"question": "which?", "answer": "1", "table_content": repr(table), "linked_cells": "{}", "aggregation": None, "table_source": "statcan"}])
    (_, _, meta), = metas(benchmarks.read_hierarchical(spark, path))
    assert json.loads(meta["_raw"]["table_content"]) == table and meta["aggregation"] == "none" and meta["table_source"] == "statcan"


def test_claims(spark, tmp_path):
    rows = [{"uid": f"u{i}", "claim": f"claim {i}", "num_hops": 2 + i % 2, "supporting_facts": [["T", 0]], "label": "SUPPORTED"} for i in range(40)] + [{"uid": "e", "claim": "", "num_hops": 3}]
    path = written(tmp_path, "hover.json", rows, array=True)
    got = metas(benchmarks.read_claims(spark, path, n=5))
    assert len(got) == 5 and all(m["num_hops"] == 3 and q == m["source_id"] for q, _, m in got)
    assert [g[0] for g in got] == [g[0] for g in metas(benchmarks.read_claims(spark, path, n=5))]
    assert len(metas(benchmarks.read_claims(spark, path, split="prepared"))) == 40


def test_sql_questions_carry_their_schema(spark, tmp_path, dbs):
    path = written(tmp_path, "dev.json", [{"question_id": 7, "db_id": "small", "question": "what is a?", "SQL": "SELECT a FROM t", "difficulty": "simple", "evidence": ""}, {"question_id": 8, "db_id": "gone", "question": "who?", "SQL": "SELECT 1"}], array=True)
    got = {m["db_id"]: m for _, _, m in metas(benchmarks.read_sql_questions(spark, path, databases.schema_text(dbs)))}
    assert got["small"]["gold_sql"] == "SELECT a FROM t" and got["small"]["_raw"]["schema"].startswith("CREATE TABLE `t`") and got["gone"]["_raw"]["schema"] == ""


def test_multi_hop(spark, tmp_path):
    path = written(tmp_path, "hp.jsonl", [{"id": "1", "question": "who?", "answer": "me", "level": "hard", "type": "bridge", "context": {"title": ["A"], "sentences": [["s"]]}}, {"id": "2", "question": " "}])
    (_, content, meta), = metas(benchmarks.read_multi_hop(spark, path))
    assert content == "who?" and meta["source_id"] == "1" and meta["context"] == {"title": ["A"], "sentences": [["s"]]}


def test_literals(spark):
    cases = {"{'a': None, 'b': [True, 'it\\'s']}": {"a": None, "b": [True, "it's"]}, '{"x": "None"}': {"x": "None"}, "[]": [], "{'q': 'say \"hi\"'}": {"q": 'say "hi"'}}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", benchmarks.literal_json(F.col("t")).alias("j")).collect()
    assert {r.t: json.loads(r.j) for r in rows} == cases
