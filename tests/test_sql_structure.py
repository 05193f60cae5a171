"""Structure of planted statements, nested, quoted and commented."""

import time

import pytest
from pyspark.sql import functions as F

from cubeloom import catalog
from cubeloom.functions import sql_structure as Q

CASES = {
    "SELECT name FROM people": set(),
    "select a, b, c, d, e from t": {"wide_select"},
    "SELECT (SELECT 1, 2, 3, 4, 5), f(a, b, c, d, e) FROM t": {"has_subquery"},
    "SELECT * FROM a JOIN b ON a.id = b.id AND a.x = b.x WHERE a.z = 1": {"has_join", "has_where"},
    "SELECT * FROM a, b AS bb, c cc WHERE a.id = bb.id OR NOT cc.x IS NULL": {"has_join", "multi_join", "multi_table", "has_where", "has_or", "has_not", "has_null_check"},
    "SELECT x FROM t WHERE y LIKE '%not null or (select%' -- union join": {"has_where", "has_like", "has_string_op"},
    "SELECT x FROM t WHERE a BETWEEN 1 AND 2 AND b = 3": {"has_where", "has_between"},
    "SELECT x FROM t WHERE a = 1 AND b = 2 AND c IN (1, 2)": {"has_where", "many_conditions", "has_in"},
    "SELECT x FROM t WHERE a IN (SELECT b FROM u WHERE c = 1 AND d = 2)": {"has_where", "has_in", "has_subquery"},
    "SELECT x FROM t WHERE a IN (SELECT b FROM u WHERE c = (SELECT max(d) FROM v))": {"has_where", "has_in", "has_subquery", "has_nested_subquery", "has_aggregation", "multi_table"},
    "SELECT x FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.a = t.a)": {"has_where", "has_exists"},
    "WITH w AS (SELECT a, b, c, d, e FROM t WHERE x = 1), z AS (SELECT 1) SELECT a FROM w JOIN z ON true": {"has_join", "has_where", "multi_table"},
    "SELECT DISTINCT a * 2, -b FROM t GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3": {"has_distinct", "has_math", "has_group_by", "has_having", "has_aggregation", "has_order_by", "has_limit"},
    "SELECT CASE WHEN a > 1 THEN upper(b) ELSE date(c) END FROM t UNION SELECT 1": {"has_case", "has_string_op", "has_date_func", "has_union"},
    "SELECT t.* , count(*) FROM t": {"has_aggregation"},
    "SELECT \"or\", `union`, [not] FROM t": set(),
    "SELECT a FROM (SELECT b FROM (SELECT c FROM t) x) y": {"has_subquery", "has_nested_subquery"},
    "SELECT a FROM t WHERE (b = 1": set(),
    "SELECT 'open FROM t WHERE a = 1 OR b = 2": set(),
    "hello or not": set(),
    "": set(),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(s,) for s in [*CASES, None]], "sql string").withColumn("w", Q.walked(F.col("sql")))
    return {r.sql: r for r in rows.select("sql", *(c.alias(n) for n, c in Q.flags(F.col("w"), "").items()), Q.tables_of(F.col("w")).alias("tables"), Q.aliases_of(F.col("w")).alias("aliases"), Q.common_tables_of(F.col("w")).alias("ctes"), Q.columns_of(F.col("w")).alias("columns")).collect()}


@pytest.mark.parametrize("sql", list(CASES))
def test_flags(found, sql):
    assert {n for n in Q.FLAGS if found[sql][n] == "yes"} == CASES[sql]


def test_names(found):
    r = found["SELECT * FROM a, b AS bb, c cc WHERE a.id = bb.id OR NOT cc.x IS NULL"]
    assert r.tables == ["a", "b", "c"] and r.aliases == {"bb": "b", "cc": "c"} and r.columns == ["a.id", "b.id", "c.x"]
    r = found["WITH w AS (SELECT a, b, c, d, e FROM t WHERE x = 1), z AS (SELECT 1) SELECT a FROM w JOIN z ON true"]
    assert r.tables == ["t", "w", "z"] and r.ctes == ["w", "z"]
    assert found["SELECT a FROM (SELECT b FROM (SELECT c FROM t) x) y"].tables == ["t"]
    assert found[None].tables == [] and found["SELECT a FROM t WHERE (b = 1"].tables == []


def test_a_long_statement(spark):
    sql = "SELECT a FROM t WHERE x IN (" + ", ".join("'" + "y" * 3000 + "'" for _ in range(30)) + ") /* " + "z" * 20000 + " */"
    r = spark.range(1).select(Q.walked(F.lit(sql)).alias("w")).select(Q.tables_of(F.col("w")).alias("t"), F.size("w").alias("n")).first()
    assert r.t == ["t"] and r.n == 8 + 30 + 29 + 1


def test_closing_semicolon_and_many_parts(spark):
    sql = "SELECT a, b, c, d, e FROM t JOIN u ON t.x = u.x JOIN v ON 1=1 WHERE a IN (SELECT 1) AND b = 2 AND c IS NOT NULL;"
    row = spark.range(1).select(Q.walked(F.lit(sql)).alias("w")).select(*(c.alias(n) for n, c in Q.flags(F.col("w")).items()), Q.tables_of(F.col("w")).alias("t")).first()
    assert row.wrong_has_join == row.wrong_multi_join == row.wrong_has_subquery == row.wrong_wide_select == row.wrong_multi_table == row.wrong_many_conditions == "yes" and row.wrong_has_union == "no"
    assert row.t == ["t", "u", "v"]


def test_a_statement_is_walked_once_a_row(spark):
    df = spark.range(3).select(F.concat(F.lit("SELECT a FROM t"), F.col("id")).alias("sql")).select(Q.walked(F.col("sql")).alias("w"))
    names = df.select(Q.tables_of(F.col("w")).alias("t"), Q.columns_of(F.col("w")).alias("c"), *Q.flags(F.col("w"), "").values())
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "table_next" not in plan, "no fold with a stack of structs is interpreted token by token"
    assert sorted(r.t for r in names.collect()) == [["t0"], ["t1"], ["t2"]]


def test_names_come_without_tokens(spark):
    texts = [*CASES, None, 'SELECT "T".a, x.B FROM s.big AS "T" JOIN (SELECT t.c FROM t) x ON "T".a = x.b AND "T".A > 0']
    both = spark.createDataFrame([(s,) for s in texts], "sql string").select("sql", Q.walked(F.col("sql")).alias("w"), Q.names(F.col("sql")).alias("n"))
    of = {"tables": Q.tables_of, "aliases": Q.aliases_of, "common_tables": Q.common_tables_of, "columns": Q.columns_of}
    for r in both.select("sql", "n", *(make(F.col("w")).alias(n) for n, make in of.items())).collect():
        assert r.n.asDict() == {n: r[n] for n in of}, r.sql
    parts = spark.createDataFrame([(k, k % 7) for k in range(60)], "p_partkey long, p_size int")
    plan = catalog._sql_names(lambda _: parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "names(" in plan and "walked(" not in plan and "where_at" not in plan, "no tokens leave the Python worker for a statement's names"


def test_a_deep_statement_takes_time_in_proportion():
    def deep(n):
        sql = "SELECT a FROM t WHERE " + "(" * n + "a = 1" + ")" * n
        start = time.process_time()
        return Q._walk(sql), time.process_time() - start

    walk = deep(3)[0]
    assert [(x[0], x[7], x[12]) for x in walk if x[0] == "a"] == [("a", 1, -1), ("a", 4, 4)]
    assert deep(8000)[1] < 1.5, "a token does not look through all levels"
